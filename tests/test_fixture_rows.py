"""Operators on the hand-written fixture against SQL on the same rows, or rows written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lexspark.operators import citations, graph, lookup, questions, radar, segment
from lexspark.operators.headings import normalize_headings
from lexspark.plans import fixture
from lexspark.plans.expansion import ALIAS_RULES, LEAD, expand_queries
from lexspark.plans.oracle import NAME, RANGES, count, flat, quoted
from lexspark.sources import corpus

PLANS = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


@plan
def get_item(spark):
    rows = lookup.get_article(fixture.articles(spark), "시험규정", "1")
    return lookup.with_citation(rows).select("item_index", "source", "article", "citation", "body", "is_supplementary")


@plan
def article_range(spark):
    return lookup.article_ranges(fixture.articles(spark))


@plan
def attachment_list(spark):
    return lookup.list_attachments(fixture.attachments(spark), source="시험규정")


@plan
def attachment_get(spark):
    return lookup.get_attachment(fixture.attachments(spark), "시험규정", "별표 1").select("item_index", "citation", "title", "body")


@plan
def verify_equi_lookup(spark):
    asked = spark.createDataFrame([("시험규정", 1, 0), ("시험규정", 2, 2), ("시험규정", 9, 0), ("계약지침", 1, 0)], "source string, article_no int, article_sub int")
    found = citations.lookup_by_key(asked, fixture.articles(spark))
    return found.withColumn("item_index", F.coalesce("item_index", F.lit(-1)))


@plan
def nearest_entity(spark):
    cites = citations.extract_citations(fixture.texts(spark))
    found = citations.nearest_source(cites, fixture.articles(spark).select("source").distinct(), ["text_id", "cite_no"])
    return found.select("text_id", "raw", "source")


@plan
def verify_refs(spark):
    return citations.verify_citations(fixture.texts(spark), fixture.articles(spark)).select("text_id", "citation", "status", "article_title", "title_verified", "message")


@plan
def outgoing_refs(spark):
    return graph.outgoing_references(fixture.articles(spark)).select("item_index", "scope", "citation", "article_title")


@plan
def incoming_refs(spark):
    a = fixture.articles(spark)
    return graph.incoming_references(a, graph.reference_target(a, "시험규정", 2, 2)).select("item_index", "scope", "citation")


@plan
def attachment_headers(spark):
    lines = spark.createDataFrame([(0, "앞말 [별표 1] 처분 기준 [별지 제2호 서식] 신청서"), (1, "[ 별표  1-1 ] 표"), (2, "없음")], "line_id long, line string")
    return segment.attachment_headers(lines).select("line_id", "mark_no", "kind", "number", "label", "title", "before")


@plan
def parse_regulations(spark):
    a, b = segment.parse_regulations(fixture.files(spark))
    first = a.select("file", "source", "revision", "chapter", F.col("article").alias("label"), F.col("article_title").alias("title"), "body", F.col("is_supplementary").alias("flag"))
    second = b.select("file", "source", "revision", F.lit("").alias("chapter"), "label", "title", "body", F.col("deleted").alias("flag"))
    return first.unionByName(second)


@plan
def normalized_headings(spark):
    rows = spark.createDataFrame([(0, "# 시험 규정\n# 제1장 총칙\n## 제1조 (목적) 본문\n##### 머리\n[별표 1] 표\n본문", "시험규정", "2025.01.01"), (1, "본문", "다른", "")], "id long, markdown string, title string, revision string")
    return rows.select("id", normalize_headings(F.col("markdown"), F.col("title"), F.col("revision")).alias("markdown"))


@plan
def question_score(spark):
    found = questions.find_questions(fixture.questions(spark), fixture.articles(spark), "위원회 업무")
    return found.select("id", "score", "citation", "article_title")


@plan
def expanded_queries(spark):
    rows = spark.createDataFrame([(0, "주말에 일하면"), (1, "피를 뽑으면 주말에"), (2, "아무것도")], "id long, query string")
    return expand_queries(rows)


@plan
def parent_radar(spark):
    return radar.compliance_radar(fixture.articles(spark)).select("source", "parent", "status", F.coalesce("months", F.lit(0)).cast("long").alias("months"))


@plan
def json_index(spark):
    """The fixture's articles as JSON of either form, read back."""
    rows = [dict(zip([c.split()[0] for c in fixture.ARTICLE_FIELDS.split(", ")], r, strict=True)) for r in fixture.ARTICLES]
    both = [(json.dumps(rows, ensure_ascii=False),), (json.dumps({"version": 2, "articles": rows, "attachments": []}, ensure_ascii=False),)]
    a, b = (corpus.json_tables(spark.createDataFrame([x], "value string"))[0] for x in both)
    fields = ["item_index", "source", "article", "article_no", "article_sub", "article_title", "body", "is_supplementary"]
    return a.select(F.lit(1).alias("version"), *fields).unionByName(b.select(F.lit(2).alias("version"), *fields))


FA, FB = f"fa AS {fixture.sql_articles()}", f"fb AS {fixture.sql_attachments()}"
FT = "ft AS " + fixture.sql_rows(fixture.TEXTS, "text_id, text")
CITE = r"제(\d+)조(?:의(\d+))?(?:\s*제\d+항)?(?:\s*제\d+호)?(?:\s*\(([^)]{2,40})\))?"
#: the fixture's texts hold one citation at most
CITED = rf"""ct AS (
  SELECT text_id, regexp_extract(text, '{CITE}') AS raw, CAST(regexp_extract(text, '{CITE}', 1) AS INT) AS no,
    CAST(coalesce(nullif(regexp_extract(text, '{CITE}', 2), ''), '0') AS INT) AS sub, regexp_extract(text, '{CITE}', 3) AS title,
    substr(text, 1, strpos(text, regexp_extract(text, '{CITE}')) - 1) AS prefix
  FROM ft WHERE regexp_matches(text, '{CITE}')
),
ns AS (
  SELECT text_id, source FROM ct, (SELECT DISTINCT source FROM fa) WHERE contains(prefix, source)
  QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY length(prefix) - strpos(reverse(prefix), reverse(source)) - length(source) + 1 DESC, length(source) DESC) = 1
)"""

# three are written out by hand: the longest source that holds a cited name is the one looked in
ROWS = {
    "get_item": f"""WITH {FA}, m AS (SELECT * FROM fa WHERE source = '시험규정' AND article_no = 1 AND article_sub = 0)
      SELECT CAST(item_index AS BIGINT) AS item_index, source, article, source || ' ' || article AS citation, body, is_supplementary FROM m WHERE is_supplementary = (SELECT min(is_supplementary) FROM m)""",
    "article_range": f"WITH {FA}, {RANGES} SELECT source, first, last, n FROM rt",
    "attachment_list": f"""WITH {FB} SELECT category, source, kind, label, title, deleted, source || ' ' || label AS citation, substr({flat("substr(body, 1, 200)")}, 1, 150) AS body_excerpt
      FROM fb WHERE NOT deleted AND contains(source, '시험규정')""",
    "attachment_get": f"WITH {FB} SELECT CAST(item_index AS BIGINT) AS item_index, source || ' ' || label AS citation, title, body FROM fb WHERE source = '시험규정' AND kind = '별표' AND number = '1'",
    "verify_equi_lookup": f"""WITH {FA}, q AS (SELECT * FROM (VALUES ('시험규정', 1, 0), ('시험규정', 2, 2), ('시험규정', 9, 0), ('계약지침', 1, 0)) v(source, article_no, article_sub)),
      f AS (SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY source, article_no, article_sub ORDER BY is_supplementary, item_index) = 1)
      SELECT q.source, q.article_no, q.article_sub, CAST(coalesce(f.item_index, -1) AS BIGINT) AS item_index, f.article_title FROM q LEFT JOIN f USING (source, article_no, article_sub)""",
    "nearest_entity": f"WITH {FA}, {FT}, {CITED} SELECT CAST(ct.text_id AS BIGINT) AS text_id, raw, source FROM ct LEFT JOIN ns USING (text_id)",
    "verify_refs": f"""WITH {FA}, {FT}, {CITED}, {RANGES}, h AS (
        SELECT ct.*, ns.source, (SELECT arg_min(article_title, CAST(is_supplementary <> contains(right(prefix, 15), '부칙') AS INT) * 1000 + item_index) FROM fa WHERE fa.source = ns.source AND article_no = no AND article_sub = sub) AS actual
        FROM ct LEFT JOIN ns USING (text_id)
      ), j AS (SELECT *, title <> '' AND NOT regexp_matches(title, '이하|약칭|[''"‘’“”]') AS checks, source || ' ' || {NAME.format(no="no", sub="sub")} AS cite FROM h)
      SELECT CAST(text_id AS BIGINT) AS text_id, coalesce(cite, raw) AS citation,
        CASE WHEN source IS NULL THEN 'unknown_source' WHEN actual IS NULL THEN 'not_found' WHEN checks AND NOT contains(actual, title) THEN 'content_mismatch' ELSE 'ok' END AS status,
        actual AS article_title, CASE WHEN status = 'ok' THEN checks END AS title_verified,
        CASE WHEN status = 'not_found' THEN cite || ' 없음 (실재: ' || first || ' ~ ' || last || ', 총 ' || n || '개)' END AS message
      FROM j LEFT JOIN rt USING (source)""",
    "outgoing_refs": """SELECT CAST(item_index AS BIGINT) AS item_index, scope, citation, article_title FROM (VALUES
      (1, 'same_regulation', '시험규정 제1조', '목적'), (2, 'external', '다른규정 제3조', NULL), (4, 'external', '시험규정 제2조', NULL),
      (5, 'external', '시험규정 제2조의2', NULL), (6, 'external', '없는법 제5조', NULL)) v(item_index, scope, citation, article_title)""",
    "incoming_refs": f"""WITH {FA} SELECT CAST(item_index AS BIGINT) AS item_index, CASE WHEN source = '시험규정' THEN 'same_regulation' ELSE 'cross_regulation' END AS scope, source || ' ' || article AS citation
      FROM fa WHERE item_index <> 2 AND CASE WHEN source = '시험규정' THEN regexp_matches(body, '(^|[^가-힣A-Za-z0-9_])제2조의2([^0-9]|$)') ELSE regexp_matches(body, '시험규정\\s*제2조의2([^0-9]|$)') END""",
    "attachment_headers": r"""WITH l AS (SELECT * FROM (VALUES (0, '앞말 [별표 1] 처분 기준 [별지 제2호 서식] 신청서'), (1, '[ 별표  1-1 ] 표'), (2, '없음')) v(line_id, line)),
      k AS (SELECT line_id, regexp_extract_all(line, '\[\s*(별표|별지)\s+((?:제\s*)?[\d\-]+(?:호)?\s*(?:서식)?)\s*\]', 1) AS kinds,
        regexp_extract_all(line, '\[\s*(별표|별지)\s+((?:제\s*)?[\d\-]+(?:호)?\s*(?:서식)?)\s*\]', 2) AS numbers,
        regexp_split_to_array(line, '\[\s*(?:별표|별지)\s+(?:제\s*)?[\d\-]+(?:호)?\s*(?:서식)?\s*\]\s*') AS pieces FROM l),
      u AS (SELECT line_id, unnest(range(0, len(kinds))) AS i, kinds, numbers, pieces FROM k)
      SELECT CAST(line_id AS BIGINT) AS line_id, CAST(i AS INT) AS mark_no, kinds[i + 1] AS kind, regexp_replace(numbers[i + 1], '\s+', '', 'g') AS number,
        '[' || regexp_replace(trim(kinds[i + 1] || ' ' || numbers[i + 1]), '\s+', ' ', 'g') || ']' AS label, trim(pieces[i + 2]) AS title, trim(pieces[1]) AS before FROM u""",
    "parse_regulations": "SELECT * FROM "
    + fixture.sql_rows(
        tuple(("규정_시험규정.md", r[2], r[3], r[4], r[5], r[8], r[9], r[10]) for r in fixture.ARTICLES[:4])
        + (("시행세칙_시험규정 시행세칙.md", "시험규정 시행세칙", "2024.01.15 개정", "", "제1조", "목적", "이 세칙은 「시험규정」에서 위임한 사항을 정한다.", False),)
        + tuple(("규정_시험규정.md", r[2], r[3], "", r[5], r[7], r[8], r[9]) for r in fixture.ATTACHMENTS[:2]),
        "file, source, revision, chapter, label, title, body, flag",
    ),
    "normalized_headings": "SELECT CAST(id AS BIGINT) AS id, markdown FROM (VALUES (0, '# 시험규정 (2025.01.01 개정)' || chr(10) || '## 제1장 총칙' || chr(10) || '### 제1조 (목적) 본문' || chr(10) || '**머리**' || chr(10) || '[별표 1] 표' || chr(10) || '본문'), (1, '# 다른' || chr(10) || '본문')) v(id, markdown)",
    "question_score": f"""WITH q AS {fixture.sql_rows(fixture.QUESTIONS, "id, category, source, question, options, answer, explanation")}, {FA},
      s AS (SELECT id, explanation, question || ' ' || array_to_string(options, ' ') || ' ' || explanation AS blob FROM q),
      t AS (SELECT id, CAST({count("blob", "위원회")} + {count("blob", "업무")} AS BIGINT) AS score, regexp_extract(explanation, '근거:\\s*([^제\\n]+?)\\s*(제\\d+조(?:의\\d+)?)', 1) AS name,
        regexp_extract(explanation, '근거:\\s*([^제\\n]+?)\\s*(제\\d+조(?:의\\d+)?)', 2) AS label FROM s)
      SELECT id, score, name || ' ' || label AS citation, (SELECT arg_min(article_title, CAST(is_supplementary AS INT) * 1000 + item_index) FROM fa WHERE fa.source = name AND fa.article = label) AS article_title
      FROM t WHERE score > 0 ORDER BY score DESC, id LIMIT 5""",
    "expanded_queries": f"""SELECT CAST(id AS BIGINT) AS id, query, expanded FROM (VALUES (0, '주말에 일하면', '주말에 일하면' || {quoted(LEAD)} || {quoted(ALIAS_RULES[1][1])}),
      (1, '피를 뽑으면 주말에', '피를 뽑으면 주말에' || {quoted(LEAD)} || {quoted(ALIAS_RULES[1][1])} || ' ' || {quoted(ALIAS_RULES[2][1])}), (2, '아무것도', '아무것도')) v(id, query, expanded)""",
    "parent_radar": """SELECT source, parent, status, CAST(months AS BIGINT) AS months FROM (VALUES ('시험규정 시행세칙', '시험규정', 'review_needed', 14), ('계약지침', '시험규정', 'ok', 0),
      ('외딴지침', NULL, 'no_parent', 0)) v(source, parent, status, months)""",
    "json_index": f"""WITH {FA} SELECT version, CAST(item_index AS BIGINT) AS item_index, source, article, article_no, article_sub, article_title, body, is_supplementary FROM fa, (SELECT unnest([1, 2]) AS version)""",
}


def same(value):
    return value if isinstance(value, bool | int | type(None)) else round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_fixture_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got, want = PLANS[name](spark), duckdb.connect().sql(ROWS[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [tuple(same(r[c]) for c in columns) for r in got.collect()]
    place = {c: i for i, c in enumerate(want.columns)}
    other = [tuple(same(r[place[c]]) for c in columns) for r in want.fetchall()]
    assert rows and sorted(rows, key=repr) == sorted(other, key=repr)


def test_citations_are_read_once_and_whole(spark):
    long = "src 제1조 " * 70_000 + "제99999999999조의3 " + "\x1c제2조\u3000제3항 ( 가나 )"
    rows = spark.createDataFrame([(0, long), (1, None), (2, ""), (None, "제3조의2"), (0, "제4조")], "text_id long, text string")
    got = citations.extract_citations(rows).collect()
    first = [r for r in got if r.text_id == 0 and r.article_no != 4]
    assert [r.cite_no for r in first] == list(range(70_002)) and all(len(r.prefix) <= citations.SOURCE_WINDOW for r in first)
    assert [(r.article_no, r.article_sub, r.cited_title) for r in first[-2:]] == [(None, 3, ""), (2, 0, "가나")]
    assert sorted((r.text_id is None, r.article_no, r.article_sub) for r in got if r.text_id is None or r.article_no == 4) == [(False, 4, 0), (True, 3, 2)]


def test_many_marks_in_one_line(spark):
    line = "앞 " + "[별표 1] 가 " * 5_000
    got = segment.attachment_headers(spark.createDataFrame([(line,), (None,), ("",)], "line string")).select("mark_no", "title", "before")
    assert got.count() == 5_000 and [tuple(r) for r in got.distinct().groupBy("title", "before").count().collect()] == [("가", "앞", 5_000)]


def test_rules_with_conditions_ahead_take_one_pass(spark):
    long = "마감 " + "a" * 60_000
    rows = spark.createDataFrame([(long,), ("x\n납품이 늦으면 위약금",), ("납품\n위약금",), (None,), ("",)], "query string")
    got = {r.query: r.expanded for r in expand_queries(rows).collect()}
    assert got[long] == long and got[""] == "" and got["납품\n위약금"] == "납품\n위약금"
    assert "지체상금" in got["x\n납품이 늦으면 위약금"]
