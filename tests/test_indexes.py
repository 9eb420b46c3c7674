"""The index of n-grams and the name automata, each against a scan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexspark.operators import keyword, names, postings

ARTICLES = "item_index long, category string, source string, chapter string, article_title string, body string"
ATTACHMENTS = "item_index long, category string, source string, title string, body string, label int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abé가나🙂", weights=[5, 5, 2, 3, 2, 1], k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    articles = [(i * 7, rng.choice(["x", "y"]), f"s{i % 3}", text(2), text(3), text(40)) for i in range(200)]
    articles += [(9_000, "x", "s0", None, None, None), (9_001, "x", "s1", "", "", ""), (9_002, None, None, "a", "b", "long " * 5000 + "needle")]
    attachments = [(i, "x", "s1", text(3), text(20), i) for i in range(50)]
    return spark.createDataFrame(articles, ARTICLES).repartition(4), spark.createDataFrame(attachments, ATTACHMENTS)


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    old, postings.BLOCK = postings.BLOCK, 64
    postings.build_postings(*tables, path)
    yield path
    postings.BLOCK = old


def rounded(rows):
    return [(r.kind, r.item_index, round(r.score, 9), r.position) for r in rows.collect()]


@pytest.mark.parametrize("fuzzy", [False, True])
@pytest.mark.parametrize("tokens", [["ab", "가나", "é"], ["needle"], ["zz", "absent"], ["abab", "가나가", "ba ab", "🙂a"], ["a"]])
def test_same_rows_as_a_scan(spark, tables, index, tokens, fuzzy):
    articles, attachments = tables
    weights = keyword.weights_of(articles, tokens)
    want = keyword.keyword_ranking(articles, attachments, tokens, weights, 300, fuzzy)
    assert rounded(postings.ranking_by_postings(spark, index, tokens, 300, fuzzy)) == rounded(want)
    some = articles.filter("category = 'x' AND source <> 's1'")
    want = keyword.keyword_ranking(some, None, tokens, weights, 20, fuzzy)
    assert rounded(postings.ranking_by_postings(spark, index, tokens, 20, fuzzy, False, "x", F.col("source") != "s1")) == rounded(want)


def test_candidates_hold_every_true_row(spark, tables, index):
    articles, _ = tables
    for tokens in (["abab"], ["가나가나"], ["needle", "ab é"]):
        found = {r.item_index for r in postings.candidates(spark, index, tokens).filter("kind = 'article'").collect()}
        texts = {r.item_index: (r.body or "", r.article_title or "", r.chapter or "") for r in articles.collect()}
        true = {i for i, t in texts.items() if any(x in f for x in tokens for f in t)}
        possible = {i for i, t in texts.items() if any(all(any(x[k : k + 3] in f for f in t) for k in range(len(x) - 2)) for x in tokens)}
        assert true <= found == possible
        report = {r.kind: r for r in postings.postings_report(spark, index, tokens).collect()}
        assert (report["article"].candidates, report["article"].true_candidates) == (len(found), len(true))


def test_only_blocks_with_candidates_are_read(spark, index):
    rows = postings.candidate_rows(spark, index, ["needle"])
    assert [r.item_index for r in rows.collect()] == [9_002]
    plan = rows._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    report = postings.postings_report(spark, index, ["needle"]).filter("kind = 'article'").first()
    assert report.candidate_blocks == 1 and report.blocks > 10
    lists = spark.read.parquet(f"{index}/postings").filter(F.col("gram") == postings.grams_of("needle")[0])
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram," in lists._jdf.queryExecution().executedPlan().toString()


def test_no_tokens_and_no_rows(spark, tables, tmp_path):
    articles, attachments = tables
    path = f"{tmp_path}/none"
    postings.build_postings(articles.limit(0), attachments.limit(0), path)
    assert postings.ranking_by_postings(spark, path, ["ab"]).collect() == []
    assert postings.candidates(spark, path, []).collect() == []
    with pytest.raises(ValueError, match="at least one"):
        postings.candidates(spark, path, [""])


def texts_and_names():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("가나🙂") for _ in range(n))
    texts = [(i, word(rng.randint(0, 40))) for i in range(80)] + [(80, None), (81, ""), (81, "가나가나"), (None, "나나가")]
    return texts, [word(rng.randint(0, 7)) for _ in range(200)] + ["가", "가나" * 30, None]


@pytest.mark.parametrize(("part", "chunk"), [(1 << 20, 1 << 20), (50, 100), (1, 1 << 20)])
def test_names_in_rows(spark, monkeypatch, part, chunk):
    """One automaton, and parts that texts are routed to."""
    monkeypatch.setattr(names, "PART_CHARACTERS", part)
    monkeypatch.setattr(names, "SLICE_CHARACTERS", chunk)
    texts, known = texts_and_names()
    found = names.name_places(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(n,) for n in known], "n string"), "n")
    assert found.columns == ["id", "n", "at"]
    want = sorted((str(i), n, t.rfind(n)) for i, t in texts if t for n in set(known) if n and n in t)
    assert sorted((str(r[0]), r[1], r[2]) for r in found.collect()) == want
    none = spark.createDataFrame([], "n string")
    assert names.name_places(spark.createDataFrame(texts, "id long, t string"), "id", "t", none, "n").collect() == []


def test_names_of_one_beginning_cost_no_more(spark):
    """Very many names that share their first letters are found about as fast as distinct ones."""

    def seconds(start):
        all_names = spark.createDataFrame([(f"{start(i)}{i:06d}",) for i in range(16_000)], "n string")
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            assert names.contained(all_names, "n", all_names.withColumnRenamed("n", "m"), "m").count() == 16_000
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(lambda i: "한국국제협력") < 2 * seconds(lambda i: f"{i % 7919:05d}이") + 0.5


# references of all articles at once


def test_edges_are_those_of_each_target(spark, tmp_path):
    """The bulk table against the query for one target, on texts of names, marks, spaces and numbers."""
    from lexspark.operators import graph

    rng = random.Random(6)
    sources = ["가규정", "큰가규정", "나 지침", "규정"]
    pieces = [*sources, "제1조", "제2조", "제2조의3", "제02조", "제1조의", " ", "  ", "\u3000", "\n", "A", "「가규정」", ".", "제1 조", "🙂", "x" * 90]
    rows = []
    for i in range(120):
        body = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        rows.append((i, sources[i % 4], f"제{i % 3}조", i % 3, 3 * (i % 2), f"t{i}", body, i % 5 == 0))
    rows += [(500, "가규정", "제1조", 1, 0, "t", None, False), (501, "", "제1조", 1, 0, "t", "제2조", False)]
    articles = spark.createDataFrame(rows, "item_index long, source string, article string, article_no int, article_sub int, article_title string, body string, is_supplementary boolean")
    path = f"{tmp_path}/edges"
    graph.write_edges(graph.edge_table(articles), path)
    shown = lambda df: sorted(tuple(r) for r in df.select("item_index", "scope", "citation", "article_title", "snippet").collect())
    some = 0
    for source in sources:
        for no, sub in ((1, 0), (2, 0), (2, 3)):
            target = graph.reference_target(articles.filter(F.col("source") == source), source, no, sub)
            row = target.first()
            found = graph.edges_of(spark, path, source, no, sub)
            if row is None:
                assert found.count() == 0
                continue
            want = shown(graph.incoming_references(articles, spark.createDataFrame([row], articles.schema)))
            assert shown(found.filter(F.col("item_index") != row["item_index"])) == want
            some += len(want)
    assert some > 50
    one = graph.edges_of(spark, path, "가규정", 1, 0)
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


# many queries, blocks of vectors


def test_many_keyword_queries(spark, tables):
    articles, _ = tables
    asked = [["ab", "가나"], ["needle"], ["é", "ab", "zz"], [], ["none"]]
    found = keyword.keyword_rankings(articles, asked, 7).collect()
    for number, tokens in enumerate(asked):
        want = keyword.keyword_ranking(articles, None, tokens, keyword.weights_of(articles, tokens), 7).collect()
        own = sorted((r for r in found if r["query"] == number), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(r["item_index"], r["score"], r["position"]) for r in own] == [(r["item_index"], r["score"], r["position"]) for r in want]
    assert keyword.keyword_rankings(articles, [], 7).collect() == []


def test_many_dense_queries(spark, monkeypatch):
    import numpy as np

    from lexspark.operators import dense

    monkeypatch.setattr(dense, "BLOCK_CELLS", 40)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        v = rng.integers(-3, 4, 5).astype(float).tolist()  # many ties
        rows.append(("article" if i % 3 else "attachment", i // 4, i % 4, i, i + 1, v))
    rows += [("article", 900, 0, 0, 1, None), ("article", 901, 0, 0, 1, [1.0]), ("article", 902, 0, 0, 1, [None, 1.0, 1.0, 1.0, 1.0]), ("article", 903, 0, 0, 1, [float("nan")] * 5), ("article", 904, 0, 0, 1, [float("inf")] * 5)]
    chunks = spark.createDataFrame(rows, "kind string, item_index long, chunk_no int, start int, end int, embedding array<double>").repartition(5)
    queries = [rng.integers(-3, 4, 5).astype(float).tolist() for _ in range(4)]

    def plain(query, allowed):
        best = {}
        for kind, item, no, start, end, v in rows[:300]:
            if (kind, item) in allowed:
                score = sum(a * b for a, b in zip(v, query, strict=True))
                best[kind, item] = max(best.get((kind, item), (-1e9,)), (score, -no, start, end))
        return sorted((-s, kind, item, -no, start, end) for (kind, item), (s, no, start, end) in best.items())

    every = {(r[0], r[1]) for r in rows}
    some = {k for k in every if k[1] % 3 == 0}
    allowed = spark.createDataFrame(sorted(some), "kind string, item_index long")
    for limit in (1, 7, 50, 500):
        for keys, table in ((every, None), (some, allowed)):
            found = dense.dense_rankings(chunks, queries, limit, allowed=table).collect()
            for q, query in enumerate(queries):
                own = sorted((r for r in found if r["query"] == q), key=lambda r: r["rank"])
                want = plain(query, keys)[:limit]
                assert [(-r.score, r.kind, r.item_index, r.chunk_no, r.start, r.end) for r in own] == want
                if q == 0:
                    one = dense.dense_ranking(chunks, query, limit, allowed=table).collect()
                    assert [(-r.score, r.kind, r.item_index, r.chunk_no, r.start, r.end) for r in one] == want
    assert dense.dense_rankings(chunks, queries, 0).collect() == []


def test_no_vector_in_an_exchange(spark):
    from lexspark.operators import dense

    chunks = spark.createDataFrame([("article", 1, 0, 0, 1, [1.0, 2.0])], "kind string, item_index long, chunk_no int, start int, end int, embedding array<double>")
    allowed = spark.createDataFrame([("article", 1)], "kind string, item_index long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = dense.dense_ranking(chunks, [1.0, 1.0], 5, allowed=allowed)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert len(ranked.collect()) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in plan and plan.index("MapInArrow") > plan.index("Exchange")  # the product is below every exchange
    assert all("embedding" not in line.split("plan_id")[0] for line in plan.split("\n") if "Exchange" in line)


def test_many_names_are_sent_once(spark, monkeypatch):
    """Rows sent grow with the names and texts, not with their product, however alike the names are."""
    monkeypatch.setattr(names, "PART_CHARACTERS", 500)
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows_sent() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows_sent()
    known = spark.range(2_000).selectExpr("concat('규정C', lpad(id, 9, '0')) AS n")
    texts = spark.range(2_000).selectExpr("id", "concat('「', '규정C', lpad(id, 9, '0'), ' 본칙」') AS t")
    found = names.name_places(texts, "id", "t", known, "n")
    assert sorted(found.collect()) == [(i, f"규정C{i:09d}", 1) for i in range(2_000)]
    assert rows_sent() - before < 6 * 4_000


def test_windows_across_slices(spark, monkeypatch):
    """Texts longer than a slice, names at its edges, and windows that would span two texts."""
    monkeypatch.setattr(names, "PART_CHARACTERS", 1)
    monkeypatch.setattr(names, "SLICE_CHARACTERS", 7)
    texts = [(0, "가나다라마바사아자차카타파하" * 3), (1, "하가"), (2, "나🙂다"), (3, "🙂"), (4, "라" * 20)]
    known = ["사아", "파하가나", "하가나", "나다라마바사아자차", "하", "🙂다", "라라라", "하" * 50]
    found = names.name_places(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(n,) for n in known], "n string"), "n")
    assert sorted(found.collect()) == sorted((i, n, t.rfind(n)) for i, t in texts for n in known if n in t)
