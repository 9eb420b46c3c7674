"""Text functions against plain Python restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.unicode import nfc, unescape_html
from lexspark.operators.chunking import chunk_text
from lexspark.operators.headings import normalize_headings
from lexspark.plans.expansion import expand_queries, expand_query


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


def random_texts(letters, n=300, longest=40, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]


def test_positions_and_counts(spark):
    texts = random_texts("aab \n")
    assert column(spark, texts, lambda t: T.count_of(t, "aa")) == [t.count("aa") for t in texts]
    assert column(spark, texts, lambda t: T.find(t, "ab")) == [t.find("ab") for t in texts]
    assert column(spark, texts, lambda t: T.rfind(t, F.lit("ab"))) == [t.rfind("ab") for t in texts]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]


def strip_meta(t):
    marks = "개정|신설|삭제|단서개정|제목개정|전부개정"
    return re.sub(r"\s{2,}", " ", re.sub(rf"<(?:{marks})[^>]*?>|\[(?:{marks})[^\]]*?\]", "", t)).strip()


def test_snippets(spark):
    texts = random_texts("abc \n", 200, 400) + ["", "<개정 2018.1.1> 말 [신설 x]  끝"]
    def snippet(b, pos, span=80):
        if not b:
            return ""
        if pos < 0:
            return strip_meta(b[: 2 * span].replace("\n", " ")) + ("…" if len(b) > 2 * span else "")
        lo, hi = max(0, pos - span), min(len(b), pos + span)
        return ("…" if lo else "") + strip_meta(b[lo:hi].replace("\n", " ")) + ("…" if hi < len(b) else "")
    assert column(spark, texts, lambda t: T.snippet(t, T.find(t, "abc"))) == [snippet(t, t.find("abc")) for t in texts]
    assert column(spark, texts, T.strip_markup) == [strip_meta(t) for t in texts]


def reflow(text):
    start = re.compile(r"^([①-⑳]|\d+(?:\s*의\s*\d+)?[\.\)]\s|[가-힣]\.\s|\[(?:별표|별지|서식))")
    out = []
    for line in [x.strip() for x in text.split("\n")]:
        if not line:
            if out and out[-1] != "":
                out.append("")
        elif start.match(line) or not out or out[-1] == "":
            out.append(line)
        else:
            out[-1] += " " + line
    while out and out[-1] == "":
        out.pop()
    return "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in out)


def test_reflow(spark):
    texts = random_texts(["①", "1. ", "1.", "2) ", "3의2. ", "가. ", "가.", "[별표", "말", "끝", " ", "\t", "\n", "\n", "\n\n"], 600, 25)
    assert column(spark, texts, T.reflow) == [reflow(t) for t in texts]
    assert reflow("a\nb\n\n\n① c\nd\n") == "a b\n\n① c d"


def test_tokenize(spark):
    assert T.tokenize("시험 업무를 정한다") == ["시험", "업무", "정한다"]
    assert T.tokenize("다음 중 옳은 것은") == []
    assert T.tokenize("") == [] and T.tokenize("휴가 휴가는, (휴가)") == ["휴가"]
    queries = ["시험 업무를 정한다", "휴가 휴가는, (휴가)", "다음 중", "a bb·cc、dd"]
    assert column(spark, queries, T.token_array) == [T.tokenize(q) for q in queries]


@pytest.mark.parametrize(
    ("query", "name", "fits"),
    [
        ("", "무엇", True), ("인사규정", "인사규정 시행세칙", True), ("공공기관 운영", "공공기관의 운영에 관한 법률", True), ("공공기관운영", "공공기관의 운영에 관한 법률", True),
        ("설치·운영", "설치․운영 지침", True), ("계약", "인사규정", False),
    ],
)
def test_source_match(spark, query, name, fits):
    assert column(spark, [name], lambda t: T.source_match(query, t)) == [fits]


def test_titles(spark):
    pairs = [("정의", "용어의 정의", True), ("육아휴직", "휴직", False), ("", "휴직", True), ("위원회", "위원회", True), ("위원회 구성", "위원회의 구성", True), ("예산", "목적", False)]
    rows = spark.createDataFrame(pairs, "c string, a string, want boolean")
    assert all(r.got == r.want for r in rows.select(T.title_matches(F.col("c"), F.col("a")).alias("got"), "want").collect())


def test_small_functions(spark):
    assert column(spark, ["2025. 3.1 개정", "2024.13.45", "없음"], T.revision_date) == [(2025, 3, 1), (2024, 13, 45), None]
    assert column(spark, ["승진 가점", "promotion", "123 !!", " ", None, "KOREA 승진"], T.script_label) == ["ko", "en", "other", None, None, "ko"]
    assert column(spark, ["가 시행세칙", "나세칙 ", "다규정", "라"], T.ending_label) == ["시행세칙", "세칙", "규정", "기타"]
    assert column(spark, ["a/b\\c:d   e "], T.safe_filename) == ["a-b-c-d e"]
    assert column(spark, ["제 2호 서식", "1 - 1"], T.number_key) == ["제2호", "1-1"]
    assert column(spark, ["가"], nfc) == ["가"] and column(spark, ["a &amp; b", None], unescape_html) == ["a & b", None]
    assert [T.parse_article_token(x) for x in ("제11조", "11", "15의2", "제15조의2", "어디 제3조 안", "x")] == [(11, 0), (11, 0), (15, 2), (15, 2), (3, 0), None]


def test_chunks(spark):
    def chunks(text, size, overlap):
        start, out = 0, []
        while True:
            end = min(start + size, len(text))
            out.append((start, end, text[start:end]))
            if end == len(text):
                return out
            start = end - overlap

    texts = ["", "0123456789XYZ", "x" * 6, "x" * 7, "x" * 10, "x" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, body string")
    rows = chunk_text(df, "body", 6, 2).orderBy("i", "chunk_no").collect()
    for i, t in enumerate(texts):
        assert [(r.start, r.end, r.chunk) for r in rows if r.i == i] == chunks(t, 6, 2)
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunk_text(df, "body", size, overlap)


def test_expansion(spark):
    queries = ["주말에 일하면", "마감이 늦었는데 업체 잘못이 없으면 위약금", "아무것도", "아이를 돌보려고 쉬면"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i long, query string")
    assert [r.expanded for r in expand_queries(df).orderBy("i").collect()] == [expand_query(q) for q in queries]
    assert expand_query("아무것도") == "아무것도" and "지체상금" in expand_query(queries[1])


def test_headings(spark):
    rows = spark.createDataFrame([("# 시험 규정\n## 제1조(목적) 본문\n#### 제2장 끝\n# 머리\n#\n[별표 1] # 표\n본문", "시험규정", "")], "m string, t string, r string")
    got = rows.select(normalize_headings(F.col("m"), F.col("t"), F.col("r"))).first()[0]
    assert got == "# 시험규정\n### 제1조(목적) 본문\n## 제2장 끝\n**머리**\n#\n[별표 1] # 표\n본문"
