"""DuckDB SQL that returns the rows of a query, for those that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_CTE = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {{docs}}),
win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM (
    SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
  ) GROUP BY doc_id
),
line AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id
),
stats AS (
  SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(string_split(t, chr(10))) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars > 12 * n_words OR word_chars < 2 * n_words OR 100 * n_symbols > 25 * n_words
      OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_upper > 40 * word_chars AS rejected
  FROM stats
)"""

OP6 = f"""WITH {QUALITY_CTE.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged"""

#: Distinct word windows as (id, g): five words, or the whole sequence of a shorter item.
LEAK_CTE = rf"""
lw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM {{docs}}),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
isg AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
),
size AS (SELECT item_id, count(*) AS n FROM isg GROUP BY item_id),
dsg AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lw, (SELECT DISTINCT k FROM isg) WHERE len(w) >= k)
),
leak AS (
  SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared
  FROM dsg JOIN isg USING (k, g) JOIN size USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 80 * n
)"""

OP9 = f"WITH {LEAK_CTE.format(docs='documents')} SELECT doc_id, item_id, n_item, n_shared FROM leak"



def jump_steps(shards: int) -> str:
    """The published walk, one nested query a step; a walk to ``shards`` has that many at most."""
    q = "SELECT *, CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS s, CAST(0 AS BIGINT) AS b, TRUE AS live FROM sized"
    for _ in range(shards):
        q = f"""SELECT * EXCLUDE (s, b, live, j), s, CASE WHEN live AND j < {shards} THEN j ELSE b END AS b, live AND j < {shards} AS live FROM (
          SELECT *, CAST(floor((b + 1) * (CAST(2147483648 AS DOUBLE) / CAST(s // 8589934592 + 1 AS DOUBLE))) AS BIGINT) AS j FROM (
            SELECT * EXCLUDE (s), (s * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM ({q})))"""
    return q


def crc32_of(hexes: str) -> str:
    """The unsigned crc32 of bytes written as hexadecimal digits, byte by byte through ``t``, the table of :data:`CRC_TABLE`."""
    return f"""CAST(xor(list_reduce(
      list_concat([4294967295], list_transform(range(0, length({hexes}), 2), lambda i: CAST(('0x' || {hexes}[i + 1 : i + 2]) AS BIGINT))),
      lambda c, x: xor(t[CAST(xor(c, x) % 256 AS BIGINT) + 1], c // 256)), 4294967295) AS BIGINT)"""


#: The checksum goes byte by byte through a table made from its polynomial.
CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)
  )
)"""

OP1 = f"""WITH {CRC_TABLE},
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, {crc32_of("h")} AS text_crc32 FROM bytes, tab),
a AS ({jump_steps(8)}), b AS ({jump_steps(9)})
SELECT a.doc_id, a.size, a.text_crc32, 'key' AS law, CAST(a.b AS INT) AS shard,
  row_number() OVER (PARTITION BY a.b ORDER BY a.doc_id, a.text_crc32, a.size) - 1 AS slot, CAST(b.b AS INT) AS grown_shard
FROM a JOIN b USING (doc_id)"""

OP2 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP7 = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT y, r FROM reach JOIN edge ON x = doc_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id"""


def cluster_rounds(rounds: int) -> str:
    """The rounds one after another: nearest centroid by squared distance, then exact floors of the means."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (
    SELECT vec_id, rid, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i}
  ) GROUP BY rid, vec_id, v)""")
        if i < rounds:
            out.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(any_value(x.m), any_value(c{i}.m)) AS m FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM (
      SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p
    ) GROUP BY c
  ) x USING (c) GROUP BY c{i}.c)""")
    return ",\n".join(out)


OP12 = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept) ORDER BY h, v LIMIT 8
),
{cluster_rounds(10)},
own AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a10 GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, s AS cluster_inertia, CAST((SELECT sum(s) FROM own) AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a10 JOIN own USING (c) JOIN c10 USING (c)"""

#: Near words as pairs, which the operator never makes; an edit in both words' letters, or one left out of the longer.
OP13 = rf"""WITH RECURSIVE {CRC_TABLE},
run AS (
  SELECT doc_id, r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS r FROM documents
  ) GROUP BY ALL
),
bytes AS (SELECT r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS h FROM run),
sums AS (SELECT r, n, {crc32_of("h")} AS c FROM bytes, tab),
word AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN c % 199 = 0 THEN r[1 : c % length(r)] || r[c % length(r) + 2 :] ELSE r END AS w, n FROM sums)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5
),
place AS (SELECT w, n, unnest(range(length(w))) AS i FROM word),
cut AS (SELECT DISTINCT w, n, w[1 : i] || w[i + 2 :] AS k FROM place),
card AS (SELECT w, n, i, w[1 : i] AS a, w[i + 2 :] AS b FROM place),
near AS (
  SELECT x.w, y.w AS v, y.n AS m FROM card x JOIN card y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION ALL SELECT cut.w, word.w, word.n FROM cut JOIN word ON cut.k = word.w
  UNION ALL SELECT word.w, cut.w, cut.n FROM cut JOIN word ON cut.k = word.w
),
best AS (SELECT w, count(*) AS c, first(v ORDER BY m DESC, encode(v)) AS v, max(m) AS m FROM near GROUP BY w),
form AS MATERIALIZED (SELECT word.w, word.n, coalesce(c, 0) AS c, CASE WHEN m >= 5 * word.n THEN v END AS v, CASE WHEN m >= 5 * word.n THEN m END AS m FROM word LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS r FROM form UNION SELECT walk.w, form.v FROM walk JOIN form ON walk.r = form.w WHERE form.v IS NOT NULL),
root AS (SELECT walk.w, walk.r FROM walk JOIN form ON walk.r = form.w WHERE form.v IS NULL)
SELECT w AS word, v AS form, r AS root, n, CAST(c AS BIGINT) AS n_near, m AS form_n FROM form JOIN root USING (w)"""

ORACLE = {"op1_jump_sharding": OP1, "op2_substring_dedup": OP2, "op7_parity_sketch_join": OP7, "op6_quality_cascade": OP6, "op9_benchmark_containment": OP9, "op12_annulus_clusters": OP12, "op13_spelling_variants": OP13}
