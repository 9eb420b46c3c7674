"""Operators that compare documents: substring removal, the language model, the similarity join, benchmark search, the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions

from lexspark.llm import components, decontamination, exchange, jaccard_join, pitman_yor, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def in_order(texts):
    return sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def test_word_hashes_and_windows(corpus_texts, odd_texts):
    texts = [t for _, t in [*corpus_texts, *odd_texts]]
    hashes, bounds = words.word_hashes(words.as_bytes(texts))
    every = [w for t in texts for w in WORD.findall(t or "")]
    assert len(hashes) == len(every) and np.diff(bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert len(set(zip(every, hashes.tolist(), strict=True))) == len(set(every)) == len(set(hashes.tolist()))
    for size in (3, 10, 20):
        found = words.windows(hashes, size)
        pairs = {(tuple(every[i : i + size]), h) for i, h in enumerate(found.tolist())}
        assert len(pairs) == len({p for p, _ in pairs}) == len({h for _, h in pairs})


def test_messages_round_trip():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**48, 1000).astype(np.uint64))
    sent = [a, a > 5, np.arange(5, dtype=np.int32), np.zeros(0, np.uint64), rng.integers(-5, 5, 9)]
    for x, y in zip(exchange.unpack(exchange.pack(*sent)), sent, strict=True):
        assert x.dtype == y.dtype and x.tolist() == y.tolist()


def removed(texts):
    first, out = set(), []
    for key, text in in_order(texts):
        w = WORD.findall(text or "")
        drop = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in first:
                drop[i : i + 20] = [True] * 20
            first.add(window)
        kept = " ".join(x for x, d in zip(w, drop, strict=True) if not d)
        out.append((str(key), len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings(odd, odd_texts, corpus, corpus_texts, nothing):
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        rows = substring.repeated_words(df).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed(texts)
    assert sum(r.n_removed for r in rows) > 0
    assert substring.repeated_words(nothing).count() == 0
    texts = substring.deduplicated_texts(corpus).collect()
    digests = {(str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in texts}
    assert digests == {(k, d) for k, _, _, d in removed(corpus_texts)}


def test_language_model(odd, odd_texts, corpus, corpus_texts, nothing):
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
        tokens = [(k, [*WORD.findall((t or "").translate(LOWER)), None]) for k, t in texts]
        c = collections.Counter(w for k, t in tokens if not held(k) for w in t)
        n, v = sum(c.values()), len(c)
        rows = pitman_yor.score_documents(df).collect()
        base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want = sorted((str(k), held(k), len(t), sum(c[w] > 0 for w in t), round(base(t), 4)) for k, t in tokens)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
        assert {r.train_tokens for r in rows} == {n}
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    # training texts are likelier than under the base
    seen = [r for r in rows if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert pitman_yor.score_documents(nothing).count() == 0


def test_probabilities_sum_to_one(spark):
    """A model of few words: the probabilities of all words after a context, and of one unknown, sum to one."""
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][:12]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    vocabulary = ["a", "b", "c", "d"]
    rows = [(i, "a b a c a b d") for i in train] + [(k, w) for k, w in zip(held, [*vocabulary, "unknown", ""], strict=False)]
    found = {r.doc_id: r for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    after = {r: 10 ** found[k].score for r, k in zip([*vocabulary, "unknown", ""], held, strict=False)}
    # P(word after start) = P("word", end) / P(end after word); the last is read off texts that repeat nothing else
    assert 0 < after[""] < 1 and sum(after[w] for w in vocabulary) + after["unknown"] + after[""] < 1


def test_tables_follow_the_conditional():
    """Sampled numbers of tables have the mean of the exact conditional."""
    d, s, p = 0.75, 2.0, 0.05
    stirling = pitman_yor.log_stirling(d, pitman_yor.EXACT)
    for c in (2, 5, 12):
        t = np.arange(1, c + 1)
        logs = stirling[c, 1 : c + 1] + np.cumsum(np.log((s + d * np.arange(c)) * p))
        weight = np.exp(logs - logs.max())
        want = (t * weight).sum() / weight.sum()
        n = 20_000
        got = pitman_yor.sample_tables(np.full(n, c), np.arange(n), np.zeros(n), np.zeros(n), np.full(n, p), d, s, stirling, np.random.default_rng(c))
        assert abs(got.mean() - want) < 0.05


def similar(texts, size, percent):
    sets = []
    for key, text in in_order(texts):
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((key, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    # rows of one id are one name, but only links join them
    out = []
    for i, (key, own) in enumerate(sets):
        out.append((str(key), len(own), str(sets[find(i)][0]) if own else str(key)))
    return sorted(out)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_similarity_join(odd, odd_texts, corpus, corpus_texts, nothing, size, percent):
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        rows = jaccard_join.similar_documents(df, size, percent).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == similar(texts, size, percent)
    assert jaccard_join.similar_documents(nothing, size, percent).count() == 0
    left = jaccard_join.keep_one_of_each(corpus, size, percent)
    assert left.columns == corpus.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({c for _, _, c in similar(corpus_texts, size, percent)})


def test_large_bucket(spark, monkeypatch):
    """Many near copies of one text, most linked only through others, in one block or many."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        w = list(base)
        for _ in range(1 + i % 2):
            w[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = similar(texts, 3, 90)
    for block in (jaccard_join.BLOCK, 16):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        rows = jaccard_join.similar_documents(df, 3, 90).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == want


def test_sketches_never_lose_a_link():
    """Random pairs at the threshold share as many keys as either asks for."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for n in (5, 10, 23, 60, 150, 700):
            for _ in range(30):
                a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
                keep = -(-percent * n // 100)
                for b in (a[rng.permutation(n)[:keep]], np.concatenate([a, rng.integers(0, 2**63, n * 100 // percent - n).astype(np.uint64)])):
                    if len(b) == n:
                        continue
                    ka, kb = jaccard_join.sketches(a, percent), jaccard_join.sketches(np.sort(b), percent)
                    met = {g: (need, set(keys.tolist()), words) for g, need, keys, words in ka}
                    common = [(met[g], (need, set(keys.tolist()), words)) for g, need, keys, words in kb if g in met]
                    assert any(len(x[1] & y[1]) >= max(x[0], y[0]) for x, y in common)
                    assert all(np.bitwise_count(x[2] ^ y[2]).sum() <= abs(len(b) - n) for x, y in common)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 3), (7, 8), *((i, i + 1) for i in range(100, 140))]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**dict.fromkeys((1, 2, 3, 10), 1), 7: 7, 8: 7, **dict.fromkeys(range(100, 141), 100)}
    assert {r.node: r.comp for r in found} == want


def leaks(texts, items):
    def shingles(text, width):
        w = WORD.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    out = set()
    for item, text in items:
        n = len(WORD.findall(text or ""))
        own = shingles(text, min(5, n)) if n else set()
        for key, t in texts:
            if own and 100 * len(own & shingles(t, min(5, n))) >= 80 * len(own):
                out.add((str(key), item))
    return out


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_SHINGLES, 0])
def test_benchmark_search(spark, odd, odd_texts, corpus, corpus_texts, nothing, limit):
    some = corpus_texts[3][1].split()
    broken = [*some[:12], "zzz", *some[13:26]]
    items = [(0, " ".join(some[2:30])), (1, " ".join(broken)), (2, "one two"), (3, None), (4, ""), (5, "of the"), (6, " ".join(some[2:30]).upper()), (7, "never there at all in any text")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        rows = decontamination.contained_items(df, table, broadcast_limit=limit).collect()
        assert {(str(r.doc_id), r.item_id) for r in rows} == leaks(texts, items)
        left = decontamination.drop_contaminated(df, table)
        assert left.columns == df.columns
        # each row by its own text, where the search takes the rows of one id together
        gone = {int(k) for k, _ in leaks(list(enumerate(t for _, t in texts)), items)}
        assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(k), t or "") for i, (k, t) in enumerate(texts) if i not in gone)
    assert decontamination.contained_items(nothing, table).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(odd, empty).count() == 0


def test_leaks_come_through_the_sketch(spark, corpus, corpus_texts, monkeypatch):
    """Sketches are small, find every leak, and nothing is found without them."""
    some = corpus_texts[3][1].split()
    table = spark.createDataFrame([(0, " ".join(some[:30])), (1, " ".join(some[5:9]))], "item_id long, text string")
    index = decontamination.item_shingles(table)
    sizes = {r.item_id: (r.n, r.sketch) for r in index.groupBy("item_id", "n").agg({"h": "count"}).join(index.filter("in_sketch").groupBy("item_id").count().withColumnRenamed("count", "sketch"), "item_id").collect()}
    assert sizes == {0: (26, 6), 1: (1, 1)}
    found = {(r.doc_id, r.item_id) for r in decontamination.contained_items(corpus, table).collect()}
    assert (3, 0) in found or any(i == 0 for _, i in found)
    met = {(r.doc_id, r.item_id) for r in decontamination.candidates(corpus.select("doc_id", "text"), index, [4, 5]).collect()}
    assert found <= met
    real = decontamination.item_shingles
    monkeypatch.setattr(decontamination, "item_shingles", lambda *a: real(*a).withColumn("in_sketch", functions.lit(False)))
    assert decontamination.contained_items(corpus, table).count() == 0


def test_rows_of_one_id_are_judged_apart(spark):
    item = " ".join(f"i{k}" for k in range(20))
    words = item.split()
    rows = [(1, " ".join(words[:11]), 0), (1, " ".join(words[9:]), 0), (1, item, 0), (None, item, 0), (None, "other words", 0), (None, None, 0), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _leak int")
    left = decontamination.drop_contaminated(df, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([r for r in rows if r[1] != item], key=repr)
    once = decontamination.drop_contaminated(df.filter("doc_id = 2 OR text LIKE '%other%'"), spark.createDataFrame([(0, "other words")], "item_id long, text string"))
    assert [tuple(r) for r in once.collect()] == [(2, "", 0)]


def test_pipeline(spark, corpus, odd, nothing, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "personal_data", "packing"]
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (corpus, odd, nothing):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == df.columns
            docs = after
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns) >= {"doc_id", "piece", "sequence_id", "offset"}


@pytest.mark.parametrize("c", [100, 1000, 10_000])
def test_tables_of_many_customers_follow_the_conditional(c):
    """Beyond EXACT customers too; the conditional is from the recursion, cut where nothing is left."""
    d, s, most = 0.75, 2.0, 400
    logs = np.full(most + 1, -np.inf)
    logs[1] = 0
    t = np.arange(most + 1)
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            logs = np.logaddexp(np.append(-np.inf, logs[:-1]), np.log(np.maximum(n - t * d, 0)) + logs)
    for others, p in ((50, 0.05), (0, 0.5), (500, 0.05)):
        weight = logs[1:] + np.cumsum(np.log((s + d * (others + np.arange(most))) * p))
        weight = np.exp(weight - weight.max())
        mean = (t[1:] * weight).sum() / weight.sum()
        var = ((t[1:] - mean) ** 2 * weight).sum() / weight.sum()
        n = 20_000
        got = pitman_yor.sample_tables(np.full(n, c), np.arange(n), np.full(n, others), np.zeros(n), np.full(n, p), d, s, pitman_yor.log_stirling(d, pitman_yor.EXACT), np.random.default_rng(c))
        assert abs(got.mean() - mean) < 5 * (var / n) ** 0.5 + 0.002 * mean
        assert abs(got.var() / var - 1) < 0.06


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a, 0), (None, a, 0), (None, b, 1), (3, c, 2), (3, c, 2), (4, c + " tail", 3), (4, d, 4), (5, d + " tail", 5), (5, "", 6), (5, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    left = jaccard_join.keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(None, a, 0), (None, b, 1), (3, c, 2), (4, d, 4), (5, "", 6), (5, None, 7)], key=repr)
    # ids that are in several groups: one row of each group stays, and columns may be called anything
    rows = [(5, a, 0), (10, a, 1), (10, b, 2), (11, b + " tail", 3), (12, a + " tail", 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumns({"_row": functions.col("_gone") + 10, "_number": functions.lit("n")})
    left = jaccard_join.keep_one_of_each(odd)
    assert left.columns == odd.columns and sorted(map(tuple, left.collect())) == [(5, a, 0, 10, "n"), (10, b, 2, 12, "n")]
    assert [r._gone for r in jaccard_join.keep_one_of_each(odd.filter("_gone IN (0, 3)")).orderBy("_gone").collect()] == [0, 3]


@pytest.mark.parametrize("n", [2, 3])
def test_words_of_a_restaurant_see_each_others_tables(n):
    """All tables of small restaurants have the mean and variance of their joint distribution."""
    d, s, c = 0.75, 2.0, 20
    one = np.exp(pitman_yor.log_stirling(d, c)[c] - np.arange(c + 1) * np.log(n))
    weight = np.ones(1)
    for _ in range(n):
        weight = np.convolve(weight, one / one.max())
    weight *= np.exp(np.append(0, np.cumsum(np.log(s + d * np.arange(n * c)))) - 100)
    total = np.arange(n * c + 1)
    mean = (total * weight).sum() / weight.sum()
    var = ((total - mean) ** 2 * weight).sum() / weight.sum()
    many = 20_000
    group = np.repeat(np.arange(many), n)
    _, last = pitman_yor.sample_restaurants(np.full(n * many, c), group, np.full(n * many, 1 / n), seed=1)
    got = np.bincount(group, last)
    assert abs(got.mean() - mean) < 0.25
    assert abs(got.var() / var - 1) < 0.06


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() on a folder of tables: which documents are left, what their texts became, and every packed id."""
    import random

    import corpus_pipeline
    import tokenizers

    from lexspark.llm import tokens

    vocabulary = ["the", "of", "and", *("".join(random.Random(k).choices("abcdefgh", k=2 + k % 6)) for k in range(300))]
    prose = lambda seed, n: " ".join(random.Random(seed).choices(vocabulary, k=n))
    rng = random.Random(8)
    clean = [prose(1000 + i, rng.randint(90, 260)) for i in range(40)]
    item = " ".join(f"item{k}" for k in range(30))
    texts = list(enumerate(clean))
    add = lambda t: texts.append((len(texts), t))
    for i in range(0, 20, 2):
        add(clean[i])  # an exact copy
        w = clean[i].split()
        w[len(w) // 2] = "changed"
        add(" ".join(w))  # a near copy
        add(" ".join([*clean[i].split()[: len(w) // 3], *prose(5000 + i, 200).split()]))  # shares a third only
    add(prose(7000, 60) + " " + item + " " + prose(7001, 60))
    add("too short")
    add(None)
    add("")
    add(" ".join(["again and over"] * 60))
    add(prose(7002, 100) + " write to jo.doe@mail.example or 10.1.2.3 " + prose(7003, 40))
    add(" ".join(prose(8000 + k, 900) for k in range(4)))  # longer than a sequence
    rng.shuffle(texts)
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t else None) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def sound(t):
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    left = sorted((i, t) for i, t in texts if sound(t))
    root = {i: i for i, _ in left}
    sets = {i: shingles(t) for i, t in left}
    for a, _ in left:
        for b, _ in left:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = {i: t for i, t in left if root[i] == i and item not in t}
    assert len(left) == len(texts) - 4 and len(kept) == len(left) - 21  # ten exact copies, ten near ones, one with the item
    kept = {i: t.replace("jo.doe@mail.example", "[EMAIL]").replace("10.1.2.3", "[IP]") for i, t in kept.items()}
    assert sum("[EMAIL]" in t and "[IP]" in t for t in kept.values()) == 1

    library = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in kept.items()}
    pieces, places = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys() and any(len(p) > 1 for p in pieces.values())
    for i, found in pieces.items():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and [s for _, s, _ in found] == [sum(n for *_, n in found[:k]) for k in range(len(found))]
        assert sum(n for *_, n in found) == len(ids[i])
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 2048


def test_sketched_sets_in_slices(spark, monkeypatch):
    """A chunk hands its rows back in slices, and they are the same."""
    from lexspark.llm import jaccard_join

    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)] + [(40, None), (None, "x")], "doc_id long, text string")
    rows = lambda: sorted(map(str, jaccard_join.sketched_sets(docs, 3, 90, "doc_id", "text", 1).collect()))
    whole = rows()
    monkeypatch.setattr(jaccard_join, "KEPT_ROWS", 5)
    assert len(whole) == 42 and rows() == whole


@pytest.mark.parametrize("others", [5, 60])
def test_largest_component_is_not_dealt_to_all_blocks(spark, monkeypatch, others):
    """In the last round each pair of different components meets, once but for those of one block, and few others make few rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    comp = {i: 0 if i < 400 else i for i in range(400 + others)}
    members = spark.createDataFrame([(1, 7, i, len(comp), c) for i, c in comp.items()] + [(1, 8, i, 5, 0) for i in range(5)], "grp int, key long, rep long, size long, comp long")
    split = jaccard_join.split_gatherings(members)
    assert [(r.grp, r.key, r.main, r.mains, r.rests) for r in split.collect()] == [(1, 7, 0, 20, -(-others // 20))]
    dealt = collections.defaultdict(list)
    for r in jaccard_join.dealt_to_all(members.join(split, ["grp", "key"])).collect():
        dealt[r.block].append((r.rep, r.side))
    met = collections.Counter(tuple(sorted((a, b))) for rows in dealt.values() for a, x in rows for b, y in rows if a < b and comp[a] != comp[b] and (x != y or x == 0))
    assert set(met) == {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b]} and set(met.values()) == {1}
    rests = -(-others // 20)
    assert sum(map(len, dealt.values())) == 400 * rests + others * (19 + rests)


def test_rounds_name_the_members_once(spark, monkeypatch):
    """Members of large buckets meet the components once a round, and in the last round only those of gatherings still open."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(1 + i % 3):
            w[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(w)))
    written = []

    def kept(df, name, *rest, **more):
        out = jaccard_materialize(df, name, *rest, **more)
        if name in ("gathered-members", "named-members", "open-members"):
            written.append((name, out.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    jaccard_materialize = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", kept)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = jaccard_join.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == similar(texts, 3, 90)
    named = [n for name, n, _ in written if name == "named-members"]
    gathered, still_open = ([n for name, n, _ in written if name == x] for x in ("gathered-members", "open-members"))
    assert len(named) == 3 and named[1] == gathered[0] and named[2] <= still_open[-1] <= named[1]
    assert all("LeftOuter" not in plan for name, _, plan in written if name == "open-members")


def test_messages_grow_no_faster_than_the_text(spark, nothing, monkeypatch):
    """Many shuffle partitions don't make many small messages, and op3 doesn't ask for its first answers again."""
    from lexspark.llm import common

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (4, 12, 211, 2000):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            for size in (0, 10**6, 54_592_527, 172_961_921, 863_738_755, 6 * 10**9):
                monkeypatch.setattr(common, "text_bytes", lambda *_, size=size: size)
                n = common.chunk_count(nothing, exchange.CHUNK_BYTES)
                assert n * exchange.CHUNK_BYTES >= size and n >= min(partitions, common.FEW)
                assert n * n <= max(common.FEW**2, size / common.MESSAGE_BYTES, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = pitman_yor.score_documents(nothing, n_chunks=2)._jdf.queryExecution().optimizedPlan().toString()
    # first and second answers for the parent's sampling, the same for the score (of equal parts one is run), and the parent's
    assert len(re.findall(r"FlatMapGroupsInArrow \[bucket", plan)) == 5
