"""Operators on the fixture and on small random tables."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import citations, dense, fusion, graph, keyword, lookup, manifest, radar, segment, usage
from lexspark.plans import fixture
from lexspark.plans.api import Corpus
from lexspark.plans.search import search
from lexspark.streaming import usage_stream


@pytest.fixture(scope="module")
def articles(spark):
    return fixture.articles(spark).cache()


@pytest.fixture(scope="module")
def attachments(spark):
    return fixture.attachments(spark).cache()


# parsing


def parse(spark, text):
    files = spark.createDataFrame([("규정", "규정_x.md", "규정_x", text)], "category string, file string, stem string, text string")
    a, b = segment.parse_regulations(files)
    return [r.asDict() for r in a.orderBy("order").collect()], [r.asDict() for r in b.orderBy("order").collect()]


def test_fixture_files(spark):
    a, b = segment.parse_regulations(fixture.files(spark))
    rows = segment.numbered(a).orderBy("item_index").collect()
    assert [(r.source, r.article, r.article_title, r.chapter, r.is_supplementary) for r in rows] == [
        ("시험규정", "제1조", "목적", "제1장 총칙", False), ("시험규정", "제2조", "용어의 정의", "제1장 총칙", False), ("시험규정", "제2조의2", "위원회", "제1장 총칙", False),
        ("시험규정", "제1조", "시행일", "제1장 총칙", True), ("시험규정 시행세칙", "제1조", "목적", "", False),
    ]
    assert rows[1].body == "① 이 규정에서 쓰는 말의 뜻은 다음과 같다.\n② 자세한 것은 제1조를 따른다."
    assert [(r.label, r.number, r.title, r.body, r.deleted) for r in segment.numbered(b).orderBy("item_index").collect()] == [
        ("[별표 1]", "1", "처분 기준", "", False), ("[별지 제2호 서식]", "제2호서식", "신청서", "표 내용", False),
    ]


def test_plain_chapter_names_the_open_article(spark):
    a, _ = parse(spark, "제1조(가) 본문\n  제2장 둘째\n제2조(나) 본문\n")
    assert [(r["article"], r["chapter"]) for r in a] == [("제1조", "제2장 둘째"), ("제2조", "제2장 둘째")]


def test_heading_chapter_closes_first(spark):
    a, _ = parse(spark, "## 제1장 하나\n### 제1조(가) 본문\n## 제2장 둘\n버린 줄\n### 제2조(나)\n본문")
    assert [(r["article"], r["chapter"], r["body"]) for r in a] == [("제1조", "제1장 하나", "본문"), ("제2조", "제2장 둘", "본문")]


def test_text_after_an_attachment_is_its(spark):
    a, b = parse(spark, "### 제1조(가) 본문\n[별표 1] 표\n표의 줄\n끝말 [별표 2] 둘\n### 제2조(나) 본문")
    assert [(r["article"], r["body"]) for r in a] == [("제1조", "본문"), ("제2조", "본문")]
    assert [(r["label"], r["body"]) for r in b] == [("[별표 1]", "표의 줄 끝말"), ("[별표 2]", "")]


def test_text_ahead_of_the_first_mark_is_dropped(spark):
    a, b = parse(spark, "### 제1조(가) 본문\n앞말 [별표 1] 표 <삭제 2020.1.1>\n<삭제 2021>")
    assert a[0]["body"] == "본문" and b[0]["deleted"] and b[0]["title"] == "표 <삭제 2020.1.1>"


def test_other_lines(spark):
    a, _ = parse(spark, "머리말\n    제9조(인용) 들여쓴 줄\n### 제1조(가) 본문\n   제2조(들여씀) 본문의 줄\n**부 칙 <2020>**\n### 제1조(시행)\n날")
    assert [(r["article"], r["is_supplementary"]) for r in a] == [("제1조", False), ("제1조", True)]
    assert a[0]["body"] == "본문 제2조(들여씀) 본문의 줄" and a[0]["source"] == "규정_x" and a[0]["revision"] == ""
    a, b = parse(spark, "")
    assert a == [] and b == []


# ranking


def test_keyword_fixture(spark, articles):
    five = articles.filter("item_index < 5")
    weights = keyword.weights_of(five, ["위원회"])
    assert weights["위원회"] == pytest.approx(math.log(3) + 1)
    rows = [r for r in keyword.score_articles(five, ["위원회"], weights).collect() if r.score]
    assert [(r.item_index, round(r.score, 2), r.position) for r in rows] == [(2, 10.49, -1)]


def test_fuzzy_position_is_folded_in_order(spark):
    df = spark.createDataFrame([(0, "", "", "사례금 그리고 통역비")], "item_index long, article_title string, chapter string, body string")
    ones = {"통역비": 1.0, "사례비": 1.0}
    assert keyword.score_articles(df, ["통역비", "사례비"], ones, True).first().position == 8
    assert keyword.score_articles(df, ["사례비", "통역비"], ones, True).first().position == 0
    assert keyword.score_articles(df, ["사례비"], ones, True).first().score == pytest.approx(0.5 * 0.3)


def folded(body, tokens, fuzzy):
    """The rule, token by token: (score with unit weights, position)."""
    score, first = 0.0, -1
    for t in tokens:
        n, at = body.count(t), body.find(t)
        if n:
            score += n
            first = at if first < 0 or at < first else first
        elif fuzzy and len(t) >= 3:
            pairs = [t[i : i + 2] for i in range(len(t) - 1)]
            seen = [p for p in pairs if p in body]
            if len(seen) >= 0.5 * len(pairs):
                score += sum(body.count(p) for p in pairs) / len(pairs) * 0.3
                first = body.find(seen[0]) if first < 0 else first
    return score, first


@pytest.mark.parametrize("fuzzy", [False, True])
def test_keyword_scores_of_many_tokens(spark, fuzzy):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    tokens = list(dict.fromkeys(word(rng.randint(2, 6)) for _ in range(40)))[:30]
    bodies = [" ".join(word(rng.randint(1, 7)) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame([(i, "", "", b) for i, b in enumerate(bodies)] + [(99, "", "", None)], "item_index long, article_title string, chapter string, body string")
    got = {r.item_index: (round(r.score, 9), r.position) for r in keyword.score_articles(df, tokens, {}, fuzzy).collect()}
    want = {i: folded(b, tokens, fuzzy) for i, b in enumerate(bodies)} | {99: (0.0, -1)}
    assert got == {i: (round(s, 9), p) for i, (s, p) in want.items()}


def test_keyword_plan_grows_in_proportion(spark, articles):
    size = lambda n: len(keyword.score_articles(articles, [f"낱말{i}" for i in range(n)], {}, True)._jdf.queryExecution().optimizedPlan().toString())
    size(1)
    assert size(20) < 3 * size(10)


def test_names_in_texts(spark):
    from lexspark.operators.names import contained

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("가나") for _ in range(n))
    texts, names = [word(rng.randint(0, 14)) for _ in range(60)] + [None], [word(rng.randint(0, 7)) for _ in range(40)] + [None]
    found = contained(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    want = {(t, n, t.rfind(n)) for t in texts if t for n in names if n and n in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_numbers_across_ranges(spark):
    rows = [(f"파일{i:03d}", place, place) for i in range(300) for place in range(i % 3)]
    got = segment.numbered(spark.createDataFrame(rows, "file string, order int, place int").repartition(7)).orderBy("item_index").collect()
    assert [(r.file, r.place) for r in got] == [r[:2] for r in rows] and [r.item_index for r in got] == list(range(len(rows)))
    assert segment.numbered(spark.createDataFrame([], "file string, order int")).count() == 0


def ranking(spark, keys):
    return spark.createDataFrame([(k, i, r + 1) for r, (k, i) in enumerate(keys)], "kind string, item_index long, rank int")


def fuse(a, b):
    score, seen = {}, {}
    for channel, keys in enumerate((a, b)):
        for rank, key in enumerate(keys, 1):
            score[key] = score.get(key, 0) + 1 / (60 + rank)
            seen.setdefault(key, (channel, rank))
    return sorted(score.items(), key=lambda r: (-r[1], seen[r[0]], r[0]))


def heads(ranked, a, b, limit):
    chosen = [k for k, _ in ranked[:limit]]
    if limit >= 2 and a and b and a[0] != b[0]:
        for key in (a[0], b[0]):
            if key not in chosen:
                for i in range(len(chosen) - 1, -1, -1):
                    if chosen[i] not in (a[0], b[0]):
                        chosen[i] = key
                        break
    order = [k for k, _ in ranked]
    return sorted(chosen, key=order.index)


def test_fusion(spark):
    rng = random.Random(3)
    keys = [(k, i) for k in ("article", "attachment") for i in range(8)]
    for _ in range(6):
        a, b = rng.sample(keys, rng.randint(0, 8)), rng.sample(keys, rng.randint(0, 8))
        fused = fusion.rrf_fusion(ranking(spark, a), ranking(spark, b)).cache()
        want = fuse(a, b)
        assert [((r.kind, r.item_index), round(r.fused, 12)) for r in fused.orderBy("place").collect()] == [(k, round(s, 12)) for k, s in want]
        for limit in (0, 1, 2, 3, 5):
            got = [(r.kind, r.item_index) for r in fusion.keep_channel_heads(fused, limit).orderBy("place").collect()]
            assert got == heads(want, a, b, limit)


def test_dense(spark):
    rng = random.Random(1)
    rows = [("article", i // 3, i % 3, 0, 9, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    rows += [("article", 50, 0, 0, 4, rows[0][5]), ("article", 50, 1, 4, 8, rows[0][5])]
    chunks = spark.createDataFrame(rows, "kind string, item_index long, chunk_no int, start int, end int, embedding array<float>")
    got = dense.dense_ranking(chunks, rows[0][5], 5).collect()
    best = {}
    for kind, item, no, _, _, v in rows:
        s = sum(x * y for x, y in zip(v, rows[0][5], strict=True))
        if item not in best or s > best[item][0]:
            best[item] = (s, no)
    assert [r.item_index for r in got] == sorted(best, key=lambda i: (-round(best[i][0], 4), i))[:5]
    assert next(r.chunk_no for r in got if r.item_index == 50) == 0
    assert dense.dense_ranking(chunks, rows[0][5], 0).count() == 0
    allowed = spark.createDataFrame([("article", 1)], "kind string, item_index long")
    assert {r.item_index for r in dense.allowed_chunks(chunks, allowed).collect()} == {1}
    key = ["kind", "item_index", "chunk_no"]
    blas = dense.block_scores(chunks, [rows[0][5]], None).withColumnRenamed("score", "s").join(chunks.select(*key, dense.dot(F.col("embedding"), rows[0][5]).alias("t")), key).collect()
    assert len(blas) == len(rows)
    assert all(abs(r.s - r.t) < 1e-4 for r in blas)
    with pytest.raises(dense.SemanticUnavailable):
        dense.check_index(chunks, chunks, {"schema_version": 1, "index_sha256": "old"}, "new", 8)
    dense.check_index(chunks, chunks, {"schema_version": 1, "index_sha256": "x", "vector_count": 62}, "x", 8)


def test_pause(tmp_path):
    marker = tmp_path / "pause"
    assert not dense.runtime_paused(None, 0) and not dense.runtime_paused(str(marker), 0)
    marker.write_text("")
    at = marker.stat().st_mtime
    assert dense.runtime_paused(str(marker), at + 30, 60) and not dense.runtime_paused(str(marker), at + 61, 60)


def test_search_modes(spark, articles, attachments):
    with pytest.raises(ValueError):
        search(articles, attachments, "위원회", mode="other")
    assert search(articles, attachments, " ").count() == 0 and search(articles, attachments, "위원회", limit=0).count() == 0
    first = search(articles, attachments, "위원회", mode="keyword").first()
    assert (first.citation, first.score, first.search_mode, first.matched_by) == ("시험규정 제2조의2", round(5 * (math.log(8 / 2) + 1), 2), "keyword", "keyword")
    assert search(articles, attachments, "위원회").first().search_mode == "keyword_fallback"
    assert search(articles, attachments, "위원회", source="계약지침").count() == 0
    assert search(articles, attachments, "신청서", include_attachments=True, mode="keyword").first().type == "attachment"
    encode = dense.hashed_encoder()
    from lexspark.operators.chunking import item_chunks

    chunks = dense.embed_chunks(item_chunks(articles, attachments), encode).cache()
    one = lambda q: encode([f"query: {q}"])[0].tolist()
    found = search(articles, attachments, "위원회", chunks=chunks, encode=one).collect()
    assert found[0].search_mode == "hybrid" and "시험규정 제2조의2" in [r.citation for r in found]
    assert search(articles, attachments, "다음 중", chunks=chunks, encode=one, mode="semantic").first().search_mode == "semantic"
    assert chunks.filter("kind = 'attachment'").select("item_index").distinct().count() == 2


# lookups, citations, graph


def test_lookup(articles, attachments):
    assert [r.item_index for r in lookup.get_article(articles, "시험규정", "1").collect()] == [0]
    assert {r.item_index for r in lookup.get_article(articles, "시험", "1").collect()} == {0, 4}
    assert lookup.get_article(articles, "시험규정", "x").count() == 0
    assert [r.citation for r in lookup.get_attachment(attachments, "시험규정", "별지 제2호 서식").collect()] == ["시험규정 [별지 제2호 서식]"]
    assert [r.number for r in lookup.get_attachment(attachments, "시험규정", "별표 1").collect()] == ["1"]
    assert lookup.get_attachment(attachments, "시험규정", "").count() == 0
    assert lookup.list_attachments(attachments, include_deleted=True).count() == 3
    ranges = {r.source: (r["first"], r["last"], r.n) for r in lookup.article_ranges(articles).collect()}
    assert ranges["시험규정"] == ("제1조", "제2조의2", 3)


def test_verify(spark, articles):
    rows = {r.text_id: r for r in citations.verify_citations(fixture.texts(spark), articles).collect()}
    want = {0: "ok", 1: "ok", 2: "content_mismatch", 3: "ok", 4: "not_found", 5: "unknown_source", 6: "ok", 7: "ok"}
    assert {k: r.status for k, r in rows.items()} == want
    assert rows[3].article_title == "시행일" and rows[0].title_verified and not rows[7].title_verified
    assert "제1조 ~ 제2조의2, 총 3개" in rows[4].message and rows[6].citation == "시험규정 시행세칙 제1조"


def test_limits_of_a_request(spark, articles):
    many = spark.createDataFrame([(0, "시험규정 제1조 " * 200), (1, "시험규정 제1조 " * 225), (2, "가" * 20_001)], "text_id long, text string")
    rows = citations.verify_citations(many, articles).collect()
    of = lambda i: [r.status for r in rows if r.text_id == i]
    assert of(0) == ["ok"] * 200
    assert sorted(of(1)) == ["ok"] * 200 + ["truncated"]
    assert of(2) == ["truncated"]
    assert next(r.message for r in rows if r.text_id == 1 and r.status == "truncated") == "verified 200, skipped 25"


def test_mentions():
    names = lambda t: [(no, sub, name) for *_, no, sub, name in graph.mentions(t)]
    assert names("「다른규정」 제3조와 제4조의2, 인사 관리 규정 제5조") == [(3, 0, "다른규정"), (4, 2, None), (5, 0, "인사관리규정")]
    assert names("하나 둘 셋 넷 다섯 여섯 일곱 여덟 규정 제1조")[0][2] == "셋넷다섯여섯일곱여덟규정"
    assert names("하나 둘 셋 넷 다섯 여섯 일곱 여덟규정 제1조")[0][2] == "셋넷다섯여섯일곱여덟규정"
    assert names("규정 제1조") == [(1, 0, None)] and names("가" * 3000 + " 제1조") == [(1, 0, None)]
    assert names(f"「{'가' * 40}」{' ' * 60}제1조") == [(1, 0, "가" * 40)] and names(f"「{'가' * 41}」 제1조") == [(1, 0, None)]
    assert names("긴" * 900 + "규정 제2조") == [(2, 0, "긴" * 900 + "규정")]
    assert names("") == []


def test_graph(spark, articles):
    c = Corpus(articles, fixture.attachments(spark))
    refs = c.find_references("시험규정", "제2조의2", include_mermaid=True)
    assert refs["status"] == "ok" and refs["outgoing"][0]["citation"] == "다른규정 제3조" and refs["outgoing"][0]["scope"] == "external"
    assert [r["citation"] for r in refs["incoming"]] == ["계약지침 제1조"]
    assert refs["mermaid"].splitlines()[1] == '  n0["시험규정 제2조의2"]' and "n1 --> n0" in refs["mermaid"]
    first = c.find_references("시험규정", "1")
    assert first["outgoing"] == [] and [r["scope"] for r in first["incoming"]] == ["same_regulation"]
    assert c.find_references("시험규정", "99")["status"] == "not_found" and c.find_references("시험규정", "x")["status"] == "invalid_article"
    assert c.find_references("시험규정", "1", limit=0)["counts"] == {"outgoing": 0, "incoming": 1}
    with pytest.raises(ValueError):
        c.find_references("시험규정", "1", limit=-1)


def test_repeated_external_citation(spark):
    rows = [(0, "규정", "가규정", "", "", "제1조", 1, 0, "t", "「나법」 제2조, 「나법」 제2조", False), (1, "규정", "가규정", "", "", "제2조", 2, 0, "u", "본문", False)]
    df = spark.createDataFrame(rows, fixture.ARTICLE_FIELDS)
    scopes = lambda strict: sorted(r.scope for r in graph.outgoing_references(df, strict).collect())
    assert scopes(False) == ["external", "same_regulation"] and scopes(True) == ["external"]


def test_radar(articles):
    rows = [(r.source, r.parent, r.status, r.months) for r in radar.compliance_radar(articles).collect()]
    assert rows == [("시험규정 시행세칙", "시험규정", "review_needed", 14), ("계약지침", "시험규정", "ok", None), ("외딴지침", None, "no_parent", None)]
    assert radar.compliance_radar(articles, "시험규정").count() == 2


def test_api(spark, articles, attachments):
    c = Corpus(articles, attachments, question_bank=fixture.questions(spark))
    assert c.get_article("시험규정", "2의2")[0]["citation"] == "시험규정 제2조의2"
    assert c.get_attachment("시험규정", "[별표 1]")[0]["title"] == "처분 기준" and c.get_attachment("시험규정", "별표") == []
    assert [r["status"] for r in c.verify_citation("시험규정 제1조(목적)와 모를 제3조")] == ["ok", "not_found"]
    assert [r["source"] for r in c.list_sources("규정")] == ["시험규정"]
    assert "label" not in c.search_regulation("위원회", mode="keyword")[0]
    found = c.find_questions("위원회 업무")
    assert [(r["id"], r["citation"], r["article_title"]) for r in found] == [("q1", "시험규정 제2조의2", "위원회"), ("q2", "시험규정 제1조", "목적")]
    assert c.find_questions(question_id="q3")[0]["article_title"] is None and c.find_questions("다음 중") == []


def test_grounds_of_questions(spark, articles):
    from lexspark.operators import questions

    rows = [(k, "", "", "q", ["o"], "1", f"근거: {name} {label}", place) for place, (k, name, label) in enumerate((("b", "시험 규정", "제1조"), ("a", "시행세칙 시험규정", "제1조"), ("c", "시험규정", "제99조"), ("d", "계약", "제1조")))]
    bank = spark.createDataFrame(rows, "id string, category string, source string, question string, options array<string>, answer string, explanation string, place long")
    found = {r.id: r.citation for r in questions.find_questions(bank, articles, "근거 업무", limit=9).collect()}
    assert found == {"b": "시험규정 제1조", "a": "시험규정 시행세칙 제1조", "c": "시험규정 제99조", "d": "계약지침 제1조"}
    assert [r.id for r in questions.find_questions(bank, articles, "근거", limit=2).orderBy("place").collect()] == ["b", "a"]


# manifest and usage


def manifest_rows(spark, rows):
    return spark.createDataFrame([(*r, "alio") for r in rows], "name string, revision string, origin string")


def test_manifest(spark):
    old = manifest_rows(spark, [("가", "2026.01.01"), ("나", "2026.01.01")])
    manifest.validate_update(old, manifest_rows(spark, [("가", "2026.01.01"), ("나", "2026.02.01"), ("다", "")]))
    for bad, why in (([("가", "x"), ("가", "x"), ("나", "x")], "duplicate"), ([("가", "2026.01.01")], "removed"), ([("가", "2025.12.31"), ("나", "")], "back")):
        with pytest.raises(manifest.UnsafeUpdate, match=why):
            manifest.validate_update(old, manifest_rows(spark, bad))
    local = old.withColumn("origin", F.lit("local"))
    manifest.validate_update(local, manifest_rows(spark, [("다", "x")]))
    assert [manifest.least_count(n) for n in (0, 50, 149)] == [100, 100, 134]
    n = lambda k: spark.range(k).select(F.col("id").cast("string").alias("name"), F.lit("alio").alias("origin"))
    manifest.validate_collection(n(149), n(149), n(149))
    with pytest.raises(manifest.UnsafeUpdate):
        manifest.validate_collection(n(149), n(20), n(149))
    named = manifest.numbered_names(spark.createDataFrame([("x", i) for i in range(3)], "name string, position int"))
    assert [r.file for r in named.orderBy("position").collect()] == ["x.md", "x (1).md", "x (2).md"]


def usage_events(spark):
    t = datetime.datetime
    rows = [(t(2026, 8, 2, 14, 59), "search", "ko"), (t(2026, 8, 2, 15, 30), "search", "en"), (t(2026, 8, 3, 1), 'quote"tool', None), (t(2026, 8, 9, 14), "search", "ko")]
    return spark.createDataFrame(rows, "ts timestamp, tool string, lang string")


def test_usage(spark):
    events = usage_events(spark)
    daily = {(str(r.day), r.tool): r["count"] for r in usage.usage_daily(events).collect()}
    assert daily == {("2026-08-02", "search"): 1, ("2026-08-03", "search"): 1, ("2026-08-03", 'quote"tool'): 1, ("2026-08-09", "search"): 1}
    weekly = {(str(r.week), r.tool): r["count"] for r in usage.usage_weekly(usage.usage_daily(events)).collect()}
    assert weekly == {("2026-07-27", "search"): 1, ("2026-08-03", "search"): 2, ("2026-08-03", 'quote"tool'): 1}
    days = usage.daily_breakdown(events).collect()
    assert [str(r.day) for r in days] == ["2026-08-09", "2026-08-03", "2026-08-02"] and days[1].total == 2 and days[1].by_language == {"en": 1}
    text = usage.render_metrics(events)
    assert 'tool="quote\\"tool"} 1' in text and text.endswith("# EOF\n") and "lexspark_stats_enabled 1" in text
    assert "lexspark_stats_enabled 0" in usage.render_metrics(None)
    late = usage.backfill_missing_days(usage.usage_daily(events).filter("day < DATE '2026-08-09'"), usage.usage_totals(events))
    assert {(str(r.day), r.tool): r["count"] for r in late.collect()}[("2026-08-09", "search")] == 3


def test_stream(spark, tmp_path):
    events = usage_events(spark)
    log = str(tmp_path / "log")
    events.write.parquet(log)
    seen = {}

    def update(batch, number):
        seen.update({(str(r.day), r.tool): r["count"] for r in batch.collect()})

    usage_stream.run_live_counts(usage_stream.read_events(spark, log), update, str(tmp_path / "c1")).awaitTermination()
    assert seen == {(str(r.day), r.tool): r["count"] for r in usage.usage_daily(events).collect()}
    usage_stream.run_daily_counts(usage_stream.read_events(spark, log), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    done = {(str(r.day), r.tool) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("2026-08-03", "search") in done and ("2026-08-09", "search") not in done
    from lexspark.streaming import usage_log

    assert not usage_log.record(spark, None, "t") and not usage_log.snapshot(spark, None)["enabled"] and usage_log.week(spark, None)["total"] == 0
    assert usage_log.snapshot(spark, str(tmp_path / "none"))["error"]
    mine = str(tmp_path / "mine")
    at = datetime.datetime(2026, 8, 2, 15, 30)
    assert usage_log.record(spark, mine, "search", "승진", at) and usage_log.record(spark, mine, "search", "leave", at) and usage_log.record(spark, mine, "get", None, at)
    snap = usage_log.snapshot(spark, mine)
    assert (snap["total"], [t["tool"] for t in snap["tools"]], {r["lang"] for r in snap["by_language"]}) == (3, ["search", "get"], {"ko", "en"})
    assert [(d["day"], d["total"]) for d in snap["daily"]] == [("2026-08-03", 3)]
    assert usage_log.week(spark, mine, datetime.date(2026, 8, 9))["tools"] == {"search": 2, "get": 1} and usage_log.week(spark, mine, datetime.date(2026, 8, 10))["total"] == 0
    daily, added = usage_log.backfill(spark, usage.usage_totals(events), usage.usage_daily(events).filter("day < DATE '2026-08-03'"))
    assert added == 2 and usage_log.backfill(spark, usage.usage_totals(events), daily)[1] == 0
    calls = spark.createDataFrame([(datetime.datetime(2026, 1, 1), "t", "승진")], "ts timestamp, tool string, text string")
    assert usage_stream.label_events(calls).columns == ["ts", "tool", "lang"]


def test_calls_are_held_and_compacted(spark, tmp_path):
    """No file for each call; a compaction that is cut off counts nothing twice."""
    from lexspark.streaming import usage_log

    log = str(tmp_path / "log")
    at = datetime.datetime(2026, 8, 2, 15, 30)
    with pytest.raises(FileNotFoundError):
        usage_log.read_log(spark, log)
    writer = usage_log.UsageWriter(spark, log, most=10, seconds=1e9)
    for i in range(25):
        writer.add(f"t{i % 3}", ["승진", "leave", None, " ", "12"][i % 5], at + datetime.timedelta(seconds=i))
    files = lambda: sorted(p.name for p in (tmp_path / "log" / "pending").iterdir() if p.suffix == ".parquet")
    assert len(files()) == 2 and usage_log.read_log(spark, log).count() == 20
    writer.flush()
    counts = lambda: sorted(((r.tool, r.lang, r["count"]) for r in usage_log.read_log(spark, log).groupBy("tool", "lang").count().collect()), key=str)
    want = counts()
    assert sum(c for *_, c in want) == 25 and {lang for _, lang, _ in want} == {"ko", "en", "other", None}
    kept = {name: (tmp_path / "log" / "pending" / name).read_bytes() for name in files()}
    assert usage_log.compact(spark, log) == 3 and files() == [] and counts() == want
    for name, body in kept.items():  # as if the files had not been deleted
        (tmp_path / "log" / "pending" / name).write_bytes(body)
    assert counts() == want
    writer.add("t0", "late", at)
    writer.flush()
    assert usage_log.compact(spark, log) == 1 and sum(c for *_, c in counts()) == 26 and files() == []
    assert usage_log.snapshot(spark, log)["total"] == 26


def test_streamed_totals_count_each_event_once(spark, tmp_path, monkeypatch):
    from lexspark.sources import tables
    from lexspark.streaming import usage_totals

    rows = [(datetime.datetime(2026, 8, 1 + i % 5, 14, 59 if i % 2 else 30) + datetime.timedelta(minutes=i), f"t{i % 4}" if i % 9 else None, ["ko", None][i % 2]) for i in range(200)]
    events = spark.createDataFrame(rows, "ts timestamp, tool string, lang string")
    path, check = str(tmp_path / "counts"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    events.filter("day(ts) < 4").repartition(3).write.parquet(str(tmp_path / "events"))
    usage_totals.run_totals(stream(), path, check).awaitTermination()
    # a merge that dies before the pointer moves, and the same batch again
    events.filter("day(ts) >= 4").repartition(2).write.mode("append").parquet(str(tmp_path / "events"))
    with monkeypatch.context() as m:
        m.setattr(tables, "_point", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(Exception, match="cut off"):
            usage_totals.run_totals(stream(), path, check).awaitTermination()
    usage_totals.run_totals(stream(), path, check).awaitTermination()
    (name, number), = tables.read_pointer(spark, path)["batches"].items()
    assert not usage_totals.merge_batch(events, path, name, number)
    for kind in ("tool", "lang"):
        assert usage_totals.totals(spark, path, kind).collect() == usage.usage_totals(events, kind).collect()
        assert sorted(usage_totals.daily(spark, path, kind).collect()) == sorted(usage.usage_daily(events, kind).collect())
    assert usage_totals.totals(spark, str(tmp_path / "none")).collect() == []


def test_radar_of_many_names(spark, monkeypatch):
    """Names taken from parts of names, by their ending, from a later quote and not at all, with names beyond an automaton's."""
    from lexspark.operators import names

    monkeypatch.setattr(names, "PART_CHARACTERS", 1)
    row = lambda i, kind, source, body: (i, kind, source, "2024.01.01", "", "제1조", 1, 0, "t", body, False)
    rows = [row(0, "규정", "인사 규정", ""), row(1, "규정", "인사규정 본칙", ""), row(2, "정관", "정관", ""), row(3, "규정", "복무규정", "")]
    rows += [
        row(4, "지침", "가지침", "「없는 법」과 「인사 규정」"), row(5, "지침", "나지침", "「신 인사규정 본칙 해설」"), row(6, "지침", "다지침", "「복무」 「정관」"), row(7, "지침", "라지침", "「없는 법」"),
        row(8, "시행세칙", "복무규정 시행세칙", "「정관」"), row(9, "세칙", "다른규정 세칙", "「정관」"), row(10, "지침", "마지침", None), row(11, "세칙", "정관외 세칙", "정관"),
    ]
    found = radar.compliance_radar(spark.createDataFrame(rows, fixture.ARTICLE_FIELDS))
    assert {r.source: r.parent for r in found.collect()} == {
        "가지침": "인사 규정", "나지침": "인사규정 본칙", "다지침": "복무규정", "라지침": None, "복무규정 시행세칙": "복무규정", "다른규정 세칙": "정관", "마지침": None, "정관외 세칙": None,
    }


def test_citations_are_searched_once(spark, articles):
    """Names, articles and counts read one table of citations, not the texts again."""
    from lexspark.operators import citations

    texts = spark.createDataFrame([(1, "시험규정 제1조 " * 3)], "text_id long, text string")
    found = citations.verify_citations(texts, articles)
    assert "find(text_id" not in found._jdf.queryExecution().analyzed().toString()
    assert [r.status for r in found.collect()] == ["ok"] * 3
