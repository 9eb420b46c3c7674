"""DuckDB SQL that returns the rows of each registered query."""

from __future__ import annotations

from ..functions.text import PARTICLES, STOP_WORDS, tokenize
from ..operators import segment
from .expansion import ALIAS_RULES, LEAD
from .queries import FUZZY_TOKENS, MANY_QUERIES, MANY_TOKENS, RARE_TOKENS, SAID, TOKENS

ARTICLES = """a AS (
  SELECT doc_id AS item_index, lang AS category, source, '' AS revision, '' AS chapter, split_part(text, chr(10), 1) AS article_title, text AS body FROM documents
)"""
ATTACHMENTS = "b AS (SELECT item_id AS item_index, substr(text, 1, 40) AS title, text AS body FROM benchmark)"
EVENTS = """e AS (
  SELECT ts, event_type AS tool, CASE WHEN regexp_matches(props, '[가-힣ᄀ-ᇿ㄰-㆏]') THEN 'ko' WHEN regexp_matches(props, '[A-Za-z]') THEN 'en' WHEN trim(props) = '' THEN NULL ELSE 'other' END AS lang,
    CAST(ts + INTERVAL 9 HOUR AS DATE) AS day
  FROM events
)"""
DAILY = f"{EVENTS}, daily AS (SELECT day, tool, count(*) AS count FROM e GROUP BY day, tool)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count(body: str, token: str) -> str:
    return f"((length({body}) - length(replace({body}, {quoted(token)}, ''))) // {len(token)})"


def weight(tokens: list[str]) -> str:
    """One row of weights w0, w1, ... over all articles."""
    df = [f"count(*) FILTER (WHERE contains(body, {quoted(t)}) OR contains(article_title, {quoted(t)}))" for t in tokens]
    return "idf AS (SELECT " + ", ".join(f"ln((count(*) + 1.0) / ({d} + 1)) + 1 AS w{i}" for i, d in enumerate(df)) + " FROM a)"


def score(title: str, tokens: list[str]) -> tuple[str, str]:
    """(score, position) of exact hits."""
    parts = [f"CASE WHEN contains({title}, {quoted(t)}) THEN 5.0 * w{i} ELSE 0 END + {count('body', t)} * w{i}" for i, t in enumerate(tokens)]
    first = ", ".join(f"CASE WHEN contains(body, {quoted(t)}) THEN strpos(body, {quoted(t)}) - 1 END" for t in tokens)
    return " + ".join(parts), f"coalesce(least({first}), -1)"


def fuzzy_score(tokens: list[str]) -> tuple[str, str]:
    parts, first = [], "-1"
    for i, t in enumerate(tokens):
        pairs = [t[k : k + 2] for k in range(len(t) - 1)]
        present = " + ".join(f"CAST(contains(body, {quoted(p)}) AS INT)" for p in pairs)
        hits = " + ".join(count("body", p) for p in pairs)
        near = f"NOT contains(body, {quoted(t)}) AND ({present}) >= {0.5 * len(pairs)}"
        parts.append(f"CASE WHEN contains(article_title, {quoted(t)}) THEN 5.0 * w{i} ELSE 0 END + CASE WHEN {near} THEN ({hits}) / {len(pairs)}.0 * 0.3 * w{i} ELSE {count('body', t)} * w{i} END")
        at = f"strpos(body, {quoted(t)}) - 1"
        place = "coalesce(" + ", ".join(f"CASE WHEN contains(body, {quoted(p)}) THEN strpos(body, {quoted(p)}) - 1 END" for p in pairs) + ")"
        first = f"(CASE WHEN contains(body, {quoted(t)}) AND (({first}) < 0 OR {at} < ({first})) THEN {at} WHEN {near} AND ({first}) < 0 THEN {place} ELSE ({first}) END)"
    return " + ".join(parts), first


S, P = score("article_title", TOKENS)
BS, BP = score("title", TOKENS)
FS, FP = fuzzy_score(FUZZY_TOKENS)

SCORED = f"""{ARTICLES}, {ATTACHMENTS}, {weight(TOKENS)},
words AS (
  SELECT kind, item_index, score, position, row_number() OVER (ORDER BY score DESC, kind, item_index) AS rank FROM (
    SELECT 'article' AS kind, item_index, {S} AS score, {P} AS position FROM a, idf
  ) WHERE score > 0 QUALIFY rank <= 50
),
c AS (
  SELECT 'article' AS kind, vec_id // 4 AS item_index, CAST(vec_id % 4 AS INT) AS chunk_no, label, embedding,
    round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings
),
best AS (SELECT kind, item_index, score, chunk_no FROM c QUALIFY row_number() OVER (PARTITION BY kind, item_index ORDER BY score DESC, chunk_no) = 1),
near AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, item_index) AS rank FROM best QUALIFY rank <= 50),
r AS (SELECT kind, item_index, row_number() OVER (ORDER BY round(score, 6) DESC, kind, item_index) AS rank FROM words),
fused AS (
  SELECT coalesce(r.kind, near.kind) AS kind, coalesce(r.item_index, near.item_index) AS item_index, r.rank AS kr, near.rank AS sr,
    coalesce(1.0 / (60 + r.rank), 0) + coalesce(1.0 / (60 + near.rank), 0) AS f
  FROM r FULL JOIN near ON r.kind = near.kind AND r.item_index = near.item_index
),
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY f DESC, CASE WHEN kr IS NULL THEN 1 ELSE 0 END, coalesce(kr, sr), kind, item_index) AS INT) AS place FROM fused)"""

#: Unicode's white space, with the separators that Python strips.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK = r"[ \t\x0b\x0c\r]"


def strip_marks(text: str) -> str:
    plain = rf"regexp_replace({text}, '<(?:개정|신설|삭제|단서개정|제목개정|전부개정)[^>]*?>|\[(?:개정|신설|삭제|제목개정|단서개정|전부개정)[^\]]*?\]', '', 'g')"
    return rf"regexp_replace(regexp_replace({plain}, '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def flat(text: str) -> str:
    return strip_marks(f"replace({text}, chr(10), ' ')")


def around(body: str, at: str, span: int) -> str:
    start, end = f"greatest({at} - {span}, 0)", f"least(length({body}), {at} + {span})"
    return f"CASE WHEN {start} > 0 THEN '…' ELSE '' END || {flat(f'substr({body}, {start} + 1, {end} - {start})')} || CASE WHEN {end} < length({body}) THEN '…' ELSE '' END"


MANIFESTS = """old AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, strftime(CAST(o_orderdate AS DATE), '%Y.%m.%d') AS revision FROM orders WHERE o_orderkey % 5 <> 0),
new AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS name, strftime(CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END, '%Y.%m.%d') AS revision
  FROM orders WHERE o_orderkey % 7 <> 0
)"""

NAME = "'제' || {no} || '조' || CASE WHEN {sub} <> 0 THEN '의' || {sub} ELSE '' END"
def grams(token: str) -> list[str]:
    n = min(3, len(token))
    return [token[i : i + n] for i in range(len(token) - n + 1)]


def may_hold(fields: list[str], tokens: list[str], parts) -> str:
    """Whether a row has all ``parts(token)`` of some token, each in any field."""
    return " OR ".join("(" + " AND ".join("(" + " OR ".join(f"contains({f}, {quoted(g)})" for f in fields) + ")" for g in parts(t)) + ")" for t in tokens)


def found(kind: str, table: str, fields: list[str], tokens: list[str]) -> str:
    return f"""SELECT '{kind}' AS kind, count(*) AS rows, count(*) FILTER (WHERE {may_hold(fields, tokens, grams)}) AS candidates,
      count(*) FILTER (WHERE {may_hold(fields, tokens, lambda t: [t])}) AS true_candidates FROM {table}"""


ORACLE: dict[str, str] = {
    "postings_report": f"WITH {ARTICLES}, {ATTACHMENTS} {found('article', 'a', ['body', 'article_title'], RARE_TOKENS)} UNION ALL {found('attachment', 'b', ['body', 'title'], RARE_TOKENS)}",
    "keyword_scores": f"WITH {ARTICLES}, {weight(TOKENS)} SELECT item_index, round({S}, 6) AS score, CAST({P} AS INT) AS position FROM a, idf",
    "fuzzy_bigram_score": f"WITH {ARTICLES}, {weight(FUZZY_TOKENS)} SELECT item_index, round({FS}, 6) AS score, CAST({FP} AS INT) AS position FROM a, idf",
    "attachment_scores": f"WITH {ARTICLES}, {ATTACHMENTS}, {weight(TOKENS)} SELECT item_index, round({BS}, 6) AS score, CAST({BP} AS INT) AS position FROM b, idf",
    "idf_weights": "WITH "
    + ARTICLES
    + " "
    + " UNION ALL ".join(
        f"SELECT {quoted(t)} AS token, count(*) FILTER (WHERE contains(body, {quoted(t)}) OR contains(article_title, {quoted(t)})) AS df, round(ln((count(*) + 1.0) / (df + 1)) + 1, 6) AS idf FROM a"
        for t in TOKENS
    ),
    "keyword_topk": f"""WITH {ARTICLES}, {ATTACHMENTS}, {weight(TOKENS)}, u AS (
      SELECT 'article' AS kind, item_index, {S} AS s, {P} AS p FROM a, idf UNION ALL SELECT 'attachment', item_index, {BS}, {BP} FROM b, idf
    ) SELECT kind, item_index, round(s, 6) AS score, CAST(p AS INT) AS position FROM u WHERE s > 0 ORDER BY s DESC, kind, item_index LIMIT 50""",
    "corpus_union": """SELECT 'article' AS kind, doc_id AS item_index, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents
      UNION ALL SELECT 'attachment', item_id, 'benchmark', CAST(length(text) AS BIGINT) FROM benchmark""",
    "tokenize_text": rf"""WITH t AS (SELECT doc_id, regexp_split_to_array(text, '(?:[,·、]|{WHITE})+') AS parts FROM documents),
    u AS (SELECT doc_id, list_transform(parts, lambda x: trim(x, '().,!?"''·')) AS parts FROM t),
    c AS (SELECT doc_id, list_transform(parts, lambda x: CASE WHEN length(regexp_replace(x, '(?:{"|".join(PARTICLES)})$', '')) >= 2 THEN regexp_replace(x, '(?:{"|".join(PARTICLES)})$', '') ELSE x END) AS parts FROM u),
    k AS (SELECT doc_id, list_filter(parts, lambda x: length(x) >= 2 AND NOT list_contains([{", ".join(map(quoted, sorted(STOP_WORDS)))}], x)) AS parts FROM c),
    n AS (SELECT doc_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS i FROM k),
    f AS (SELECT doc_id, token, min(i) AS i FROM n GROUP BY doc_id, token)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, token FROM f""",
    "bigram_jaccard": """WITH g AS (
      SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))) AS x,
        list_distinct(list_transform(range(1, length(p_type)), lambda i: substr(p_type, i, 2))) AS y FROM part
    ) SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM g""",
    "snippets": f"""WITH s AS (SELECT doc_id, text, strpos(text, 'the') - 1 AS place FROM documents)
      SELECT doc_id, CASE WHEN length(text) = 0 THEN '' WHEN place < 0 THEN {flat("substr(text, 1, 160)")} || CASE WHEN length(text) > 160 THEN '…' ELSE '' END ELSE {around("text", "place", 80)} END AS snippet,
        {around("text", "greatest(place, 0)", 60)} AS context FROM s""",
    "strip_markup": f"SELECT doc_id, {strip_marks(quoted('<개정 2018.12.28.>  ') + ' || text || ' + quoted(' [신설 2022.07.12.]<other>'))} AS plain FROM documents".replace("regexp_replace('<개", "regexp_replace(('<개").replace("<other>',", "<other>'),"),
    "chunk_documents": """WITH n AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 80) / 320.0) AS BIGINT)))) AS k FROM documents)
      SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(k * 320 AS INT) AS start, CAST(least(k * 320 + 400, length(text)) AS INT) AS "end", substr(text, k * 320 + 1, 400) AS chunk FROM n""",
    "reflow_text": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
      t AS (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM l),
      m AS (SELECT *, s = '' AS blank, regexp_matches(s, '^([①-⑳]|\d+(\s*의\s*\d+)?[\.\)]\s|[가-힣]\.\s|\[(별표|별지|서식))') AS opens, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t),
      g AS (SELECT *, sum(CASE WHEN blank OR opens OR prev IS NULL OR prev = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m),
      j AS (SELECT doc_id, p, bool_or(blank) AS blank, regexp_replace(string_agg(s, ' ' ORDER BY i), '[ \t]+', ' ', 'g') AS s FROM g GROUP BY doc_id, p),
      k AS (SELECT *, lag(blank, 1, TRUE) OVER (PARTITION BY doc_id ORDER BY p) AS after_blank, max(CASE WHEN NOT blank THEN p END) OVER (PARTITION BY doc_id) AS last FROM j)
      SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY p) FILTER (WHERE NOT (blank AND after_blank) AND p <= last), '') AS text FROM k GROUP BY doc_id""",
    "segment_documents": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
      s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS segment FROM l)
      SELECT CAST(doc_id AS VARCHAR) AS file, min(i) - 1 AS line_no, '제1조' AS article, CAST(sum(length(regexp_replace(line, '{WHITE}+', '', 'g'))) AS BIGINT) AS n_chars
      FROM s WHERE segment > 0 GROUP BY doc_id, segment""",
    "item_chunks": f"""WITH {ARTICLES}, {ATTACHMENTS}, h AS (
        SELECT 'article' AS kind, item_index, concat_ws(' · ', source, nullif(article_title, '')) AS header, body FROM a
        UNION ALL SELECT 'attachment', item_index, concat_ws(' · ', 'benchmark', '별표', '[별표 ' || item_index || ']', nullif(title, '')), body FROM b
      ), n AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(body) - 80) / 320.0) AS BIGINT)))) AS k FROM h)
      SELECT kind, item_index, CAST(k AS INT) AS chunk_no, CAST(k * 320 AS INT) AS start, CAST(least(k * 320 + 400, length(body)) AS INT) AS "end", header || chr(10) || substr(body, k * 320 + 1, 400) AS text FROM n""",
    "script_label": rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '^{WHITE}*$') THEN NULL WHEN regexp_matches(text, '[가-힣ᄀ-ᇿ㄰-㆏]') THEN 'ko' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END AS label FROM documents""",
    "classify_suffix": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '시행세칙' WHEN 1 THEN '지침' ELSE '기타' END AS kind FROM part""",
    "safe_names": r"SELECT page_id, trim(regexp_replace(translate(url, '/\:', '---'), '\s+', ' ', 'g')) AS name FROM pages",
    "source_match_filter": "SELECT doc_id, source FROM documents WHERE contains(source, 'src1')",
    "exact_first_filter": "SELECT doc_id, source FROM documents WHERE CASE WHEN (SELECT bool_or(source = 'src1') FROM documents) THEN source = 'src1' ELSE contains(source, 'src1') END",
    "list_sources": f"WITH {ARTICLES} SELECT arg_min(category, item_index) AS category, source, arg_min(revision, item_index) AS revision, count(*) AS articles FROM a GROUP BY source",
    "prefer_main": """WITH m AS (SELECT doc_id, source, doc_id % 3 = 0 AS is_supplementary FROM documents)
      SELECT * FROM m WHERE is_supplementary = (SELECT min(is_supplementary) FROM m)""",
    "dense_topk": f"WITH {SCORED} SELECT kind, item_index, score, chunk_no FROM near",
    "dense_maxpool": f"WITH {SCORED} SELECT kind, item_index, score, chunk_no, CAST(chunk_no * 320 AS INT) AS start, CAST(chunk_no * 320 + 400 AS INT) AS \"end\" FROM best",
    "allowed_chunks_semi": f"WITH {SCORED} SELECT kind, item_index, chunk_no, CAST(label AS BIGINT) AS label FROM c WHERE item_index IN (SELECT item_index FROM c WHERE label < 3 AND chunk_no = 0)",
    "rrf_fusion": f"WITH {SCORED} SELECT kind, item_index, round(f, 6) AS fused, place FROM placed",
    "channel_heads": f"WITH {SCORED} SELECT kind, item_index, place FROM placed ORDER BY CASE WHEN kr = 1 OR sr = 1 THEN 0 ELSE 1 END, place LIMIT 2",
    "hybrid_search": f"""WITH {SCORED}, top AS (SELECT * FROM placed ORDER BY CASE WHEN kr = 1 OR sr = 1 THEN 0 ELSE 1 END, place LIMIT 10)
      SELECT top.kind AS type, top.item_index, source, round(f, 6) AS score, 'hybrid' AS search_mode,
        CASE WHEN kr IS NOT NULL AND sr IS NOT NULL THEN 'hybrid' WHEN kr IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS matched_by
      FROM top JOIN a ON top.item_index = a.item_index""",
    "recall_gate": f"""WITH {SCORED}, m AS (SELECT 'keyword' AS mode, item_index, rank FROM r UNION ALL SELECT 'hybrid', item_index, place FROM placed)
      SELECT mode, CAST(max(CASE WHEN rank <= 50 AND item_index IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(1 AS BIGINT) AS queries FROM m GROUP BY mode""",
    "late_parents": """WITH x AS (SELECT l_orderkey AS k, CAST(o_orderdate AS DATE) AS p, CAST(min(l_shipdate) AS DATE) AS c FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
      SELECT k || ' 시행세칙' AS source, CASE WHEN p IS NOT NULL THEN CAST(k AS VARCHAR) END AS parent, CASE WHEN p IS NULL THEN 'no_parent' WHEN p > c THEN 'review_needed' ELSE 'ok' END AS status,
        CAST(CASE WHEN p > c THEN greatest((year(p) - year(c)) * 12 + month(p) - month(c), 1) ELSE 0 END AS BIGINT) AS months FROM x""",
    "contained_names": """WITH n AS (SELECT DISTINCT regexp_extract(p_name, '^[^ ]+') AS name FROM part), t AS (SELECT DISTINCT p_name FROM part)
      SELECT p_name, name, CAST(length(p_name) - strpos(reverse(p_name), reverse(name)) - length(name) + 1 AS BIGINT) AS at FROM t JOIN n ON contains(p_name, name)""",
    "names_in_documents": """WITH n AS (SELECT DISTINCT regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+') AS name FROM benchmark)
      SELECT doc_id, name, CAST(length(text) - strpos(reverse(text), reverse(name)) - length(name) + 1 AS BIGINT) AS at FROM documents JOIN n ON contains(text, name) WHERE name <> ''""",
    "manifest_removed": f"WITH {MANIFESTS} SELECT name FROM old EXCEPT SELECT name FROM new",
    "manifest_common": f"WITH {MANIFESTS} SELECT name FROM old INTERSECT SELECT name FROM new",
    "manifest_regressed": f"WITH {MANIFESTS} SELECT name, old.revision AS old_revision, new.revision AS new_revision FROM old JOIN new USING (name) WHERE new.revision < old.revision",
    "manifest_duplicates": "SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "dedupe_names": """WITH r AS (SELECT c_mktsegment AS name, c_custkey AS position, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS n FROM customer)
      SELECT name, position, name || CASE WHEN n = 0 THEN '.md' ELSE ' (' || n || ').md' END AS file FROM r""",
    "collection_gate": f"""WITH {MANIFESTS}, x AS (SELECT (SELECT count(*) FROM new) AS listed, (SELECT count(*) FROM new WHERE name LIKE '1%') AS resolved, (SELECT count(*) FROM old) AS previous),
      y AS (SELECT *, CAST(CASE WHEN previous > 0 THEN greatest(100, floor(previous * 0.9)) ELSE 100 END AS BIGINT) AS least FROM x) SELECT *, listed >= least AND resolved >= least AS ok FROM y""",
    "usage_totals": f"WITH {EVENTS} SELECT tool, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM e GROUP BY tool",
    "usage_daily": f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, tool, count FROM daily",
    "usage_weekly": f"WITH {DAILY} SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, tool, CAST(sum(count) AS BIGINT) AS count FROM daily GROUP BY ALL",
    "usage_week_view": f"WITH {DAILY} SELECT tool, CAST(sum(count) AS BIGINT) AS count FROM daily WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY tool",
    "backfill_missing_days": f"""WITH {DAILY}, d AS (SELECT * FROM daily WHERE day < DATE '2024-01-20'), t AS (SELECT CAST(max(ts) + INTERVAL 9 HOUR AS DATE) AS day, tool, count(*) AS count FROM e GROUP BY tool)
      SELECT CAST(day AS VARCHAR) AS day, tool, count FROM d UNION ALL SELECT CAST(day AS VARCHAR), tool, count FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.day = t.day AND d.tool = t.tool)""",
    "metrics_lines": f"""WITH {DAILY}, w AS (SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, tool, CAST(sum(count) AS BIGINT) AS count FROM daily GROUP BY ALL)
      SELECT 0 AS section, 'lexspark_calls_total ' || count(*) AS line FROM e
      UNION ALL SELECT 1, 'lexspark_tool_calls_total{{tool="' || tool || '"}} ' || count(*) FROM e GROUP BY tool
      UNION ALL SELECT 2, 'lexspark_weekly_calls{{week_start="' || week || '"}} ' || CAST(sum(count) AS BIGINT) FROM w GROUP BY week
      UNION ALL SELECT 3, 'lexspark_weekly_tool_calls{{week_start="' || week || '",tool="' || tool || '"}} ' || count FROM w""",
    "current_file_per_page": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)"[^>]*>([^<]+)', 1) AS links, regexp_extract_all(html, 'href="/([^"]+)"[^>]*>([^<]+)', 2) AS names FROM pages)
      SELECT page_id, links[len(links)] AS link, trim(names[len(names)]) AS file_name, lower(regexp_extract(trim(names[len(names)]), '\.([^.]+)$', 1)) AS ext FROM l WHERE len(links) > 0""",
    "daily_breakdown": f"""WITH {EVENTS}, t AS (SELECT day, count(*) AS total FROM e GROUP BY day)
      SELECT CAST(day AS VARCHAR) AS day, total, 'tool' AS kind, tool AS key, count(*) AS count FROM e JOIN t USING (day) GROUP BY ALL
      UNION ALL SELECT CAST(day AS VARCHAR) AS day, total, 'lang' AS kind, lang AS key, count(*) AS count FROM e JOIN t USING (day) WHERE lang IS NOT NULL GROUP BY ALL""",
    "usage_stream_daily": f"WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, tool, count FROM daily",
    "staged_documents": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_custkey % 3 <> 0)
      SELECT c_mktsegment AS name, '규정' AS type, '규정_' || c_mktsegment || CASE WHEN n = 0 THEN '' ELSE ' (' || n || ')' END || '.md' AS file, '2026.01.01' AS revision, CAST(c_custkey AS VARCHAR) AS file_no, 'alio' AS origin,
        '# ' || c_mktsegment || ' (2026.01.01 개정)' || chr(10) || '### 제1조(가) ' || c_name AS text FROM r""",
    "keyword_many_tokens": f"""WITH {ARTICLES}, {ATTACHMENTS}, {weight(MANY_TOKENS)}, u AS (
      SELECT 'article' AS kind, item_index, {score("article_title", MANY_TOKENS)[0]} AS s, {score("article_title", MANY_TOKENS)[1]} AS p FROM a, idf
      UNION ALL SELECT 'attachment', item_index, {score("title", MANY_TOKENS)[0]}, {score("title", MANY_TOKENS)[1]} FROM b, idf
    ) SELECT kind, item_index, round(s, 6) AS score, CAST(p AS INT) AS position FROM u WHERE s > 0 ORDER BY s DESC, kind, item_index LIMIT 50""",
    "search_filtered": f"""WITH {ARTICLES}, {weight(TOKENS)}, k AS (SELECT item_index, source, {S} AS score FROM a, idf WHERE category = 'en' AND contains(source, 'src1'))
      SELECT CAST(row_number() OVER (ORDER BY score DESC, item_index) AS INT) AS place, 'article' AS type, item_index, source, round(score, 2) AS score, 'keyword' AS search_mode, 'keyword' AS matched_by
      FROM k WHERE score > 0 QUALIFY place <= 20""",
    "search_fallback": f"""WITH {ARTICLES}, {weight(TOKENS)}, k AS (SELECT item_index, source, {S} AS score FROM a, idf)
      SELECT CAST(row_number() OVER (ORDER BY score DESC, item_index) AS INT) AS place, 'article' AS type, item_index, source, round(score, 2) AS score, 'keyword_fallback' AS search_mode, 'keyword' AS matched_by
      FROM k WHERE score > 0 QUALIFY place <= 10""",
    "search_semantic": f"""WITH {SCORED} SELECT CAST(rank AS INT) AS place, 'article' AS type, near.item_index, source, round(near.score, 4) AS score, 'semantic' AS search_mode, 'semantic' AS matched_by
      FROM near JOIN a ON near.item_index = a.item_index WHERE rank <= 10""",
}
ORACLE["keyword_postings"] = ORACLE["keyword_many_tokens"]


def one_ranking(number: int, tokens: list[str]) -> str:
    s, p = score("article_title", tokens)
    return f"""SELECT {number} AS query, item_index, round(s, 6) AS score, CAST(p AS INT) AS position, CAST(row_number() OVER (ORDER BY s DESC, item_index) AS INT) AS rank
      FROM (WITH {weight(tokens)} SELECT item_index, {s} AS s, {p} AS p FROM a, idf) WHERE s > 0 QUALIFY rank <= 10"""


ORACLE["many_keyword_queries"] = f"WITH {ARTICLES} " + " UNION ALL ".join(one_ranking(i, tokenize(q)) for i, q in enumerate(MANY_QUERIES))
ORACLE["many_dense_queries"] = f"""WITH q AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < {len(MANY_QUERIES)}),
  s AS (SELECT query, vec_id // 4 AS item_index, CAST(vec_id % 4 AS INT) AS chunk_no, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, q),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, item_index ORDER BY score DESC, chunk_no) = 1)
  SELECT CAST(query AS INT) AS query, 'article' AS kind, item_index, round(score, 6) AS score, chunk_no, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_index) AS INT) AS rank
  FROM b QUALIFY rank <= 10"""

NUMBER = "'제' || ((doc_id + {shift}) % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN '조의2 ' ELSE '조 ' END"
EDGES = f"""c AS (
  SELECT doc_id AS item_index, source, CAST(doc_id % 9 + 1 AS INT) AS no, CAST(doc_id % 3 AS INT) AS sub,
    replace(replace(text, ' the ', ' src' || (doc_id % 4) || ' ' || {NUMBER.format(shift=3)}), ' que ', ' ' || {NUMBER.format(shift=5)}) AS body FROM documents
),
target AS (SELECT source AS t_source, no AS t_no, sub AS t_sub, count(*) AS n, ' 제' || no || '조' || CASE WHEN sub > 0 THEN '의' || sub ELSE '' END || ' ' AS name FROM c GROUP BY ALL),
edge AS (
  SELECT t_source, t_no, t_sub, item_index, 'same_regulation' AS scope, strpos(body, name) AS place, body
  FROM c JOIN target ON source = t_source WHERE contains(body, name) AND (no <> t_no OR sub <> t_sub OR n > 1)
  UNION ALL SELECT t_source, t_no, t_sub, item_index, 'cross_regulation', strpos(body, t_source || name) - 1, body
  FROM c JOIN target ON source <> t_source WHERE contains(body, t_source || name)
)"""
ORACLE["reference_edges"] = f'WITH {EDGES} SELECT t_source, t_no, t_sub, item_index, scope, place AS "at" FROM edge'
ORACLE["reference_edges_of_one"] = f"""WITH {EDGES}
  SELECT item_index, scope, source || ' 제' || no || '조' AS citation, {around('edge.body', 'place', 60)} AS snippet FROM edge JOIN c USING (item_index) WHERE t_source = 'src1' AND t_no = 7 AND t_sub = 0"""
ORACLE["usage_stream_totals"] = ORACLE["usage_totals"]


# numbered articles, their citations, attachments and files

NTH = "'제' || ((doc_id + {shift}) % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN '조의2' ELSE '조' END"


def rules(name: str = "fa", left: str = "", right: str = "") -> str:
    """The documents as numbered articles that cite, under ``name``."""
    title = "CASE doc_id % 4 WHEN 0 THEN '(rule ' || ((doc_id + 3) % 9 + 1) || ') ' WHEN 1 THEN '(이하 x) ' ELSE '(zzzz) ' END"
    named = f"' {left}src' || (doc_id % 25) || '{right}' || CASE WHEN doc_id % 5 = 0 THEN ' 부칙 ' ELSE ' ' END || {NTH.format(shift=3)} || {title}"
    return f"""{name} AS (
  SELECT doc_id AS item_index, lang AS category, source, CAST(doc_id % 9 + 1 AS INT) AS article_no, CAST(doc_id % 3 AS INT) AS article_sub, doc_id % 4 = 1 AS is_supplementary,
    {NAME.format(no="(doc_id % 9 + 1)", sub="(doc_id % 3)")} AS article, 'rule ' || (doc_id % 9 + 1) || ' of ' || source AS article_title,
    replace(replace(text, ' the ', {named}), ' que ', ' ' || {NTH.format(shift=5)} || ' ') AS body FROM documents
)"""


FORMS = """fb AS (
  SELECT doc_id AS item_index, lang AS category, source, CASE WHEN doc_id % 2 = 1 THEN '별지' ELSE '별표' END AS kind, doc_id % 6 AS number, 'form ' || (doc_id % 6) AS title, text AS body, doc_id % 7 = 0 AS deleted,
    CASE WHEN doc_id % 2 = 1 THEN '[별지 제' || (doc_id % 6) || '호 서식]' ELSE '[별표 ' || (doc_id % 6) || ']' END AS label FROM documents
)"""
RANGES = f"""rg AS (
  SELECT s.source, min((article_no, article_sub)) AS lo, max((article_no, article_sub)) AS hi, count(DISTINCT (article_no, article_sub)) AS n
  FROM (SELECT DISTINCT source FROM fa) s JOIN fa ON contains(fa.source, s.source) GROUP BY s.source
),
rt AS (SELECT source, {NAME.format(no="lo[1]", sub="lo[2]")} AS first, {NAME.format(no="hi[1]", sub="hi[2]")} AS last, n FROM rg)"""

CITE = r"제(\d+)조(?:의(\d+))?(?:\s*제\d+항)?(?:\s*제\d+호)?(?:\s*\(([^)]{2,40})\))?"
CITE_CUT = CITE.replace(r"(\d+)", r"\d+").replace("([^)]{2,40})", "[^)]{2,40}")


def cited(body: str) -> str:
    """Every citation in ``body`` of fa with its source, the known one in the 80 characters ahead of it that starts last."""
    ends = "(coalesce(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(raws[1:i], lambda x: length(x))), 0))"
    return f"""m AS (
  SELECT item_index, {body} AS t, regexp_extract_all({body}, '{CITE}') AS raws, regexp_extract_all({body}, '{CITE}', 1) AS nos, regexp_extract_all({body}, '{CITE}', 2) AS subs,
    regexp_extract_all({body}, '{CITE}', 3) AS titles, regexp_split_to_array({body}, '{CITE_CUT}') AS gaps FROM fa
),
p AS (SELECT *, CAST({ends} AS BIGINT) AS start FROM (SELECT *, unnest(range(len(raws))) AS i FROM m)),
ct AS (
  SELECT item_index, CAST(i AS INT) AS cite_no, raws[i + 1] AS raw, CAST(nos[i + 1] AS INT) AS no, CAST(coalesce(nullif(subs[i + 1], ''), '0') AS INT) AS sub, trim(coalesce(titles[i + 1], '')) AS title,
    substr(t, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0)) AS prefix FROM p
),
ns AS (
  SELECT item_index, cite_no, source FROM ct, (SELECT DISTINCT source FROM fa) WHERE contains(prefix, source)
  QUALIFY row_number() OVER (PARTITION BY item_index, cite_no ORDER BY length(prefix) - strpos(reverse(prefix), reverse(source)) - length(source) DESC, length(source) DESC) = 1
)"""


def fixed(pattern: str) -> str:
    return quoted(pattern.removeprefix("(?U)"))


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def pairs(text: str) -> str:
    return f"list_distinct(list_transform(range(1, length({text})), lambda i: substr({text}, i, 2)))"


FIRST = "SELECT source, article_no, article_sub, arg_min(struct_pack(item_index, article, article_title, body), item_index) AS f FROM fa GROUP BY ALL"
TITLE_KEY = r"regexp_replace({}, '[\s·․.,''\"()\[\]「」]', '', 'g')"
ORACLE["get_item"] = f"""WITH {rules()}, m AS (SELECT * FROM fa WHERE source = 'src1' AND article_no = 7 AND article_sub = 0)
  SELECT item_index, source, article, source || ' ' || article AS citation, body, is_supplementary FROM m WHERE is_supplementary = (SELECT min(is_supplementary) FROM m)"""
ORACLE["article_range"] = f"WITH {rules()}, {RANGES} SELECT source, first, last, n FROM rt"
ORACLE["attachment_list"] = f"""WITH {FORMS} SELECT category, source, kind, label, title, deleted, source || ' ' || label AS citation, substr({flat("substr(body, 1, 200)")}, 1, 150) AS body_excerpt
  FROM fb WHERE NOT deleted AND kind = '별표' AND contains(source, 'src1')"""
ORACLE["attachment_get"] = f"WITH {FORMS} SELECT item_index, source || ' ' || label AS citation, title, body, deleted FROM fb WHERE source = 'src1' AND kind = '별지' AND number = 3"
ORACLE["verify_equi_lookup"] = f"""WITH {rules()}, q AS (
    SELECT doc_id AS asked_by, 'src' || (doc_id % 25) AS source, CAST((doc_id + 3) % 9 + 1 AS INT) AS article_no, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS article_sub FROM documents
  ), f AS (SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY source, article_no, article_sub ORDER BY is_supplementary, item_index) = 1)
  SELECT asked_by, q.source, q.article_no, q.article_sub, coalesce(f.item_index, -1) AS item_index, f.article_title FROM q LEFT JOIN f USING (source, article_no, article_sub)"""
ORACLE["nearest_entity"] = f"WITH {rules()}, {cited('body')} SELECT item_index, cite_no, raw, title AS cited_title, source FROM ct LEFT JOIN ns USING (item_index, cite_no)"
ORACLE["verify_refs"] = rf"""WITH {rules()}, {cited("substr(body, 1, 20000)")}, {RANGES},
  f AS (SELECT source, article_no AS no, article_sub AS sub, is_supplementary AS s, arg_min(struct_pack(title := article_title, body := substr({flat("substr(body, 1, 250)")}, 1, 150)), item_index) AS r FROM fa GROUP BY ALL),
  h AS (
    SELECT ct.*, ns.source, CASE WHEN contains(right(prefix, 15), '부칙') THEN coalesce(b.r, a.r) ELSE coalesce(a.r, b.r) END AS hit, title <> '' AND NOT regexp_matches(title, '이하|약칭|[''"‘’“”]|이?라\s*(한다|칭한다)') AS checks,
      ns.source || ' ' || {NAME.format(no="ct.no", sub="ct.sub")} AS cite
    FROM ct LEFT JOIN ns USING (item_index, cite_no) LEFT JOIN f a ON a.source = ns.source AND a.no = ct.no AND a.sub = ct.sub AND NOT a.s LEFT JOIN f b ON b.source = ns.source AND b.no = ct.no AND b.sub = ct.sub AND b.s
    WHERE cite_no < 200
  ),
  k AS (SELECT *, {TITLE_KEY.format("title")} AS ck, {TITLE_KEY.format("hit.title")} AS ak FROM h),
  j AS (
    SELECT *, CASE WHEN source IS NULL THEN 'unknown_source' WHEN hit IS NULL THEN 'not_found'
      WHEN checks AND NOT (length(ck) < 2 OR length(ak) < 2 OR contains(ak, ck) OR len(list_intersect({pairs('ck')}, {pairs('ak')})) / len(list_distinct(list_concat({pairs('ck')}, {pairs('ak')}))) >= 0.4) THEN 'content_mismatch'
      ELSE 'ok' END AS status FROM k
  ),
  c AS (SELECT fa.item_index, length(body) AS n_chars, len(raws) AS n FROM fa JOIN m USING (item_index))
  SELECT item_index, cite_no, coalesce(cite, raw) AS citation, status, hit.title AS article_title, CASE WHEN status = 'ok' THEN checks END AS title_verified, CASE WHEN status = 'ok' THEN hit.body END AS body_excerpt,
    CASE WHEN status = 'not_found' THEN cite || ' 없음 (실재: ' || first || ' ~ ' || last || ', 총 ' || n || '개)' END AS message
  FROM j LEFT JOIN rt USING (source)
  UNION ALL SELECT item_index, CAST(least(n, 200) AS INT), NULL, 'truncated', NULL, NULL, NULL, 'verified ' || least(n, 200) || ', skipped ' || greatest(n - 200, 0) FROM c WHERE n_chars > 20000 OR n > 200"""

NAMED = r"(?:「([^」\n]{2,40}?)」\s*)?제(\d+)조(?:의(\d+))?"
ORACLE["outgoing_refs"] = f"""WITH {rules(left="「", right="」")}, f AS ({FIRST}),
  m AS (SELECT item_index, source, article_no, article_sub, regexp_extract_all(body, '{NAMED}', 1) AS names, regexp_extract_all(body, '{NAMED}', 2) AS nos, regexp_extract_all(body, '{NAMED}', 3) AS subs FROM fa),
  u AS (SELECT *, unnest(range(len(nos))) AS i FROM m),
  x AS (SELECT item_index, source, article_no, article_sub, i, nullif(names[i + 1], '') AS name, CAST(nos[i + 1] AS INT) AS no, CAST(coalesce(nullif(subs[i + 1], ''), '0') AS INT) AS sub FROM u),
  y AS (SELECT *, row_number() OVER (PARTITION BY item_index, name, no, sub ORDER BY i) AS nth FROM x),
  s AS (SELECT DISTINCT source AS known FROM fa),
  z AS (SELECT item_index, i, name, no, sub, arg_max(known, (length(known), known)) AS known FROM y LEFT JOIN s ON contains(known, name) OR contains(name, known) WHERE name IS NOT NULL AND nth = 1 GROUP BY ALL),
  b AS (SELECT DISTINCT item_index, source, no, sub FROM y WHERE (name IS NULL OR nth > 1) AND (no <> article_no OR sub <> article_sub))
  SELECT item_index, CASE WHEN f IS NULL THEN 'external' ELSE 'cross_regulation' END AS scope, CASE WHEN f IS NULL THEN name || ' ' || {NAME.format(no="no", sub="sub")} ELSE known || ' ' || f.article END AS citation,
    f.article_title AS article_title, substr({flat("substr(f.body, 1, 200)")}, 1, 120) AS snippet FROM z LEFT JOIN f ON known = f.source AND no = f.article_no AND sub = f.article_sub
  UNION ALL SELECT b.item_index, 'same_regulation', b.source || ' ' || f.article, f.article_title, substr({flat("substr(f.body, 1, 200)")}, 1, 120)
  FROM b JOIN f ON b.source = f.source AND no = f.article_no AND sub = f.article_sub"""
ORACLE["incoming_refs"] = rf"""WITH {rules()}, t AS (SELECT item_index AS target FROM fa WHERE source = 'src1' AND article_no = 7 AND article_sub = 0 ORDER BY is_supplementary, item_index LIMIT 1)
  SELECT item_index, CASE WHEN source = 'src1' THEN 'same_regulation' ELSE 'cross_regulation' END AS scope, source || ' ' || article AS citation FROM fa, t
  WHERE item_index <> target AND CASE WHEN source = 'src1' THEN regexp_matches(body, '(^|[^가-힣\pL\pN_])제0*7조([^의]|의[^0-9]|의?$)') ELSE regexp_matches(body, 'src1\s*제0*7조([^의]|의[^0-9]|의?$)') END"""

MARK = r"\[\s*(별표|별지)\s+((?:제\s*)?[\d\-]+(?:호)?\s*(?:서식)?)\s*\]\s*"
MARK_CUT = MARK.replace("(별표|별지)", "(?:별표|별지)").replace("((?:제", "(?:(?:제")
ORACLE["attachment_headers"] = rf"""WITH d AS (SELECT doc_id, replace(replace(text, ' the ', ' [별표 ' || (doc_id % 7 + 1) || '-1] '), ' que ', ' [ 별지  제' || (doc_id % 7 + 1) || '호  서식 ]') AS text FROM documents),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM d),
  k AS (SELECT doc_id, line_no, regexp_extract_all(line, '{MARK}', 1) AS kinds, regexp_extract_all(line, '{MARK}', 2) AS numbers, regexp_split_to_array(line, '{MARK_CUT}') AS pieces FROM l),
  u AS (SELECT *, unnest(range(len(kinds))) AS i FROM k)
  SELECT doc_id, line_no, CAST(i AS INT) AS mark_no, kinds[i + 1] AS kind, regexp_replace(numbers[i + 1], '\s+', '', 'g') AS number,
    '[' || regexp_replace(trim(kinds[i + 1] || ' ' || numbers[i + 1]), '\s+', ' ', 'g') || ']' AS label, {stripped("pieces[i + 2]")} AS title, CASE WHEN i = 0 THEN {stripped("pieces[1]")} END AS before FROM u"""


def line_cases(cases: list[tuple[str, str]]) -> str:
    """What is put in the place of line x, the i-th from 0, of a document."""
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + " ELSE x END"


K8 = "((doc_id + i) % 8)"
WRITTEN = line_cases(
    [
        ("NOT regexp_matches(x, '^[A-Z]')", "x"), (f"{K8} = 0", "'### 제' || (i % 9 + 1) || '조(가나) ' || x"), (f"{K8} = 2", "'제' || (i % 9 + 1) || '조의2(다) ' || x"),
        (f"{K8} = 3 AND i % 3 = 0", "'앞말 [별표 ' || (i % 4 + 1) || '] 삭제'"), (f"{K8} = 3", "'[별지 제' || (i % 4 + 1) || '호 서식] ' || x"), (f"{K8} = 4", "'## 제' || (i % 5 + 1) || '장 ' || x"),
        (f"{K8} = 5", "'제' || (i % 5 + 1) || '절 총칙' || chr(10) || x"), (f"{K8} = 6 AND i % 2 = 0", "'부칙 <2024.01.01.>' || chr(10) || x"),
    ]
)
SENTENCE = " OR ".join(f"ends_with(bare, '{end}')" for end in segment.SENTENCE_ENDS)
ENDED = "ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
ORACLE["parse_regulations"] = rf"""WITH w AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  d AS (
    SELECT doc_id, '# ' || any_value(source) || ' 규정' || CASE WHEN doc_id % 2 = 0 THEN ' (2025.03.01 개정)' ELSE '' END || chr(10) || string_agg({WRITTEN}, chr(10) ORDER BY i) AS text FROM w GROUP BY doc_id
  ),
  c AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM d),
  l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM c),
  a AS (SELECT *, {stripped("line")} AS bare FROM l),
  b AS (
    SELECT *, CASE WHEN starts_with(line, '# ') THEN 'title' WHEN regexp_matches(bare, {fixed(segment.SUPPLEMENT)}) THEN 'supplement' WHEN regexp_matches(line, '{MARK}') THEN 'attachment'
      WHEN regexp_matches(line, {fixed(segment.ARTICLE_HEADING)}) THEN 'heading' WHEN starts_with(line, '## ') THEN 'chapter' WHEN starts_with(line, '### ') THEN 'close'
      WHEN regexp_matches(line, {fixed(segment.CHAPTER_LINE)}) AND length(bare) <= 30 AND NOT ({SENTENCE}) THEN 'chapter line'
      WHEN regexp_matches(line, {fixed(segment.ARTICLE_LINE)}) AND length(line) - length(regexp_replace(line, '^{WHITE}+', '')) <= 2 THEN 'article line' ELSE 'body' END AS what FROM a
  ),
  e AS (
    SELECT doc_id, line_no, 0 AS mark_no, line, what, NULL AS label, NULL AS title FROM b WHERE what <> 'attachment'
    UNION ALL SELECT doc_id, line_no, -1, {stripped("regexp_split_to_array(line, '" + MARK_CUT + "')[1]")}, 'ahead', NULL, NULL FROM b WHERE what = 'attachment' AND NOT starts_with(bare, '[')
    UNION ALL SELECT doc_id, line_no, 0, line, 'attachment', '[' || trim(regexp_extract(line, '{MARK}', 1) || ' ' || regexp_extract(line, '{MARK}', 2)) || ']',
      {stripped("regexp_split_to_array(line, '" + MARK_CUT + "')[2]")} FROM b WHERE what = 'attachment'
  ),
  f AS (
    SELECT *, what IN ('heading', 'article line') AS is_article, what IN ('heading', 'article line', 'attachment', 'chapter', 'close') AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, mark_no) AS pos,
      CASE WHEN what = 'chapter' AND regexp_matches(line, {fixed(segment.CHAPTER_HEADING)}) THEN {stripped(f"regexp_extract(line, {fixed(segment.CHAPTER_HEADING)}, 1)")} WHEN what = 'chapter' THEN {stripped("substr(line, 4)")}
        WHEN what = 'chapter line' THEN regexp_extract(line, {fixed(segment.CHAPTER_LINE)}, 1) || ' ' || {stripped(f"regexp_extract(line, {fixed(segment.CHAPTER_LINE)}, 2)")} END AS chapter,
      what = 'title' AND regexp_matches(line, {fixed(segment.TITLE)}) AS named FROM e
  ),
  g AS (
    SELECT *, sum(CAST(opens AS INT)) OVER so_far AS segment, max(CAST(what = 'supplement' AS INT)) OVER so_far = 1 AS supplementary, coalesce(last_value(chapter IGNORE NULLS) OVER so_far, '') AS chapter_now,
      coalesce(last_value(CASE WHEN named THEN {stripped(f"regexp_extract(line, {fixed(segment.TITLE)}, 1)")} END IGNORE NULLS) OVER so_far, CAST(doc_id AS VARCHAR)) AS source_now,
      coalesce(last_value(CASE WHEN named THEN {stripped(f"regexp_extract(line, {fixed(segment.TITLE)}, 2)")} END IGNORE NULLS) OVER so_far, '') AS revision_now,
      min(CASE WHEN opens THEN pos END) OVER (PARTITION BY doc_id {ENDED}) AS next_open, min(CASE WHEN opens AND what <> 'attachment' THEN pos END) OVER (PARTITION BY doc_id {ENDED}) AS next_close,
      max(pos) OVER (PARTITION BY doc_id) AS last_pos
    FROM f WINDOW so_far AS (PARTITION BY doc_id ORDER BY pos)
  ),
  o AS (SELECT *, coalesce(CASE WHEN is_article THEN next_close ELSE next_open END - 1, last_pos) AS closed FROM g WHERE is_article OR what = 'attachment'),
  t AS (
    SELECT doc_id, segment, pos, CASE WHEN what = 'body' THEN bare_of WHEN what = 'ahead' THEN line WHEN what = 'heading' THEN regexp_extract(line, {fixed(segment.ARTICLE_HEADING)}, 5)
      WHEN what = 'article line' THEN regexp_extract(line, {fixed(segment.ARTICLE_LINE)}, 4) END AS s, what = 'ahead' AS is_ahead FROM (SELECT *, {stripped("line")} AS bare_of FROM g)
  ),
  h AS (SELECT doc_id, segment, coalesce(string_agg(s, ' ' ORDER BY pos) FILTER (WHERE NOT is_ahead), '') AS own, coalesce(string_agg(s, ' ' ORDER BY pos), '') AS every FROM t GROUP BY doc_id, segment)
  SELECT CAST(o.doc_id AS VARCHAR) AS file, o.line_no, g.source_now AS source, g.revision_now AS revision, CASE WHEN o.is_article THEN g.chapter_now ELSE '' END AS chapter,
    CASE WHEN NOT o.is_article THEN o.label WHEN o.what = 'heading' THEN regexp_extract(o.line, {fixed(segment.ARTICLE_HEADING)}, 1) ELSE regexp_extract(o.line, '제\d+조(의\d+)?') END AS label,
    CASE WHEN NOT o.is_article THEN o.title WHEN o.what = 'heading' THEN {stripped(f"regexp_extract(o.line, {fixed(segment.ARTICLE_HEADING)}, 4)")} ELSE {stripped(f"regexp_extract(o.line, {fixed(segment.ARTICLE_LINE)}, 3)")} END AS title,
    md5(regexp_replace(CASE WHEN o.is_article THEN own ELSE every END, '{WHITE}+', '', 'g')) AS letters, CASE WHEN o.is_article THEN o.supplementary ELSE contains(o.title, '삭제') END AS flag
  FROM o JOIN g ON g.doc_id = o.doc_id AND g.pos = o.closed JOIN h ON h.doc_id = o.doc_id AND h.segment = o.segment"""

K6 = "((doc_id + i) % 6)"
MARKED = line_cases(
    [
        (f"{K6} = 0", "'# 제' || (i % 9 + 1) || '조 (가) ' || x"), (f"{K6} = 1", "'# 제' || (i % 9 + 1) || '장 ' || x"), (f"{K6} = 2", "'##### ' || x"), (f"{K6} = 3", "'## [별표 1] ' || x"),
        (f"{K6} = 4", "'### ' || source || chr(10) || x"),
    ]
)
ORACLE["normalized_headings"] = rf"""WITH w AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  d AS (SELECT doc_id, source, string_agg({MARKED}, chr(10) ORDER BY i) AS text FROM w GROUP BY doc_id, source),
  l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
  s AS (SELECT *, regexp_replace(line, '{WHITE}+$', '') AS r FROM l),
  o AS (
    SELECT doc_id, source, n, CASE WHEN contains(r, '[별표') OR contains(r, '[별지') THEN line WHEN regexp_matches(r, '^#{{1,4}}\s+제\d+조(의\d+)?\s*\(.+$') THEN '### ' || regexp_replace(r, '^#+\s+', '')
      WHEN regexp_matches(r, '^#{{1,4}}\s+제\d+[편장절]( .*)?$') THEN '## ' || regexp_replace(r, '^#+\s+', '') WHEN NOT regexp_matches(r, '^#{{1,6}}\s+') THEN line
      WHEN regexp_replace(r, '^#+\s+', '') = source THEN NULL WHEN regexp_matches(r, '^#+\s+$') THEN '' ELSE '**' || regexp_replace(r, '^#+\s+', '') || '**' END AS out FROM s
  )
  SELECT doc_id, '# ' || source || CASE WHEN doc_id % 2 = 0 THEN ' (2025.01.01 개정)' ELSE '' END || chr(10) || string_agg(out, chr(10) ORDER BY n) AS markdown FROM o GROUP BY doc_id, source"""
ORACLE["question_score"] = f"""WITH {rules()}, q AS (
    SELECT conv_id || ':' || turn AS id, 'src' || (conv_id % 25) AS name, CAST((conv_id + turn) % 9 + 1 AS INT) AS no, CAST((conv_id + turn) % 3 AS INT) AS sub, text FROM conversations
  ),
  s AS (SELECT id, name, no, sub, text || ' ' || ' ' || '근거: ' || name || ' ' || {NAME.format(no="no", sub="sub")} AS blob FROM q),
  t AS (SELECT *, CAST({" + ".join(count("blob", t) for t in tokenize(" ".join(TOKENS)))} AS BIGINT) AS score FROM s),
  f AS (SELECT source, article_no, article_sub, arg_min(struct_pack(article_title, body), (is_supplementary, item_index)) AS r FROM fa GROUP BY ALL)
  SELECT id, score, name || ' ' || {NAME.format(no="no", sub="sub")} AS citation, r.article_title AS article_title, substr({flat("substr(r.body, 1, 350)")}, 1, 200) AS body_excerpt
  FROM (SELECT * FROM t WHERE score > 0 ORDER BY score DESC, id LIMIT 20) LEFT JOIN f ON name = source AND no = article_no AND sub = article_sub"""


def called(pattern: str) -> str:
    """Whether a rule's pattern fits; one with several conditions ahead is all of them."""
    parts = pattern[len("(?=.*") : -1].split(")(?=.*") if pattern.startswith("(?=") else [pattern]
    return " AND ".join(f"regexp_matches(query, {quoted(p)})" for p in parts)


TERMS = ", ".join(f"CASE WHEN {called(p)} THEN {quoted(t)} END" for p, t in ALIAS_RULES)
ORACLE["expanded_queries"] = f"""WITH q AS (SELECT conv_id, turn, concat_ws(' ', text, [{", ".join(map(quoted, SAID))}][CAST((conv_id + turn) % {len(SAID)} AS INT) + 1]) AS query FROM conversations),
  t AS (SELECT *, list_filter([{TERMS}], lambda x: x IS NOT NULL) AS terms FROM q)
  SELECT conv_id, turn, query, CASE WHEN len(terms) > 0 THEN query || {quoted(LEAD)} || array_to_string(terms, ' ') ELSE query END AS expanded FROM t"""
ORACLE["parent_radar"] = """WITH x AS (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN c_custkey END AS parent, DATE '1995-01-01' + CAST(c_custkey % 1500 AS INT) AS p, CAST(o_orderdate AS DATE) AS c FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  )
  SELECT '주문 ' || k AS source, '규정 C' || lpad(CAST(parent AS VARCHAR), 9, '0') AS parent, CASE WHEN parent IS NULL THEN 'no_parent' WHEN p > c THEN 'review_needed' ELSE 'ok' END AS status,
    CAST(CASE WHEN parent IS NOT NULL AND p > c THEN greatest((year(p) - year(c)) * 12 + month(p) - month(c), 1) ELSE 0 END AS BIGINT) AS months FROM x"""
ORACLE["json_index"] = f"""WITH {rules()} SELECT CAST(item_index AS VARCHAR) AS file, unnest(range(item_index % 3 + 1)) AS item_index, source, article, article_no, article_sub, article_title, body, is_supplementary FROM fa"""
