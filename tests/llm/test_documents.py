"""Operators that look at one document at a time: sharding, quality, personal data, token counts, token files, packing."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import packing, pii, quality, sharding, token_counts, token_output, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


# sharding


def jump(key, n):
    """The published loop, with Python's whole numbers."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, 2, 12345, 2**63, 2**64 - 1, *range(500)], np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards(odd, odd_texts, nothing):
    rows = sharding.shard_documents(odd, 8).collect()
    assert len(rows) == len(odd_texts)
    for shard in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        key = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own]
        assert key == sorted(key)
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in rows)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in odd_texts)
    assert sharding.shard_documents(nothing).count() == 0


# quality


def base_stats(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + k for at in places.values() if len(at) > 1 for p in at for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, odd_texts, corpus, corpus_texts, nothing):
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        rows = quality.quality_report(df).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(base_stats(t) for _, t in texts)
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality.quality_report(nothing).count() == 0


def test_filter_keeps_what_the_report_keeps(odd, corpus, nothing):
    for df in (odd, corpus):
        kept = sorted(str(r.doc_id) for r in quality.quality_report(df).filter("kept").collect())
        left = quality.quality_filter(df)
        assert left.columns == df.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == kept
    assert quality.quality_filter(nothing).count() == 0


def test_order_of_rules_changes_no_verdict(corpus):
    stats = quality.base_stats(corpus)
    rules = quality.standard_rules()
    ordered = quality.order_rules(quality.base_stats(quality.sample_of(corpus)), rules)
    assert {r.name for r in ordered} == {r.name for r in rules}
    verdicts = [sorted(r.doc_id for r in quality.cascade(stats, x).filter("failed_rule IS NULL").collect()) for x in (rules, ordered, rules[::-1])]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_rules_are_ordered_by_what_they_reject_and_cost(spark, nothing):
    """Rejection counts, then cost; what comes after the first rule that rejects is never computed."""
    from pyspark.sql import functions as F

    sample = spark.range(2000).selectExpr("id", "repeat(cast(id as string), 200) AS text").cache()
    dear = F.col("text")
    for _ in range(12):
        dear = F.regexp_replace(F.concat(dear, F.lit("x")), "([0-9])x?", "$1y")
    rules = [
        quality.Rule("dear", F.length(dear) > 0), quality.Rule("never", F.col("id") < 0), quality.Rule("half", F.col("id") % 2 == 0), quality.Rule("all", F.col("id") >= 0), quality.Rule("null", F.lit(None).cast("boolean")),
    ]
    for given in (rules, rules[::-1]):
        names = [r.name for r in quality.order_rules(sample, given)]
        assert names[0] == "all" and names[1:3] == ["half", "dear"] and set(names[3:]) == {"never", "null"}
    assert quality.order_rules(nothing, rules) == rules
    wrong = quality.Rule("wrong", F.raise_error(F.lit("computed")).cast("boolean"))
    assert {r.failed_rule for r in quality.cascade(sample, [rules[3], wrong]).collect()} == {"all"}
    assert {r.failed_rule for r in quality.cascade(sample, [wrong], when=F.col("id") < 0).collect()} == {None}
    with pytest.raises(Exception, match="computed"):
        quality.cascade(sample, [rules[2], wrong]).collect()


def test_sample_reads_a_few_files(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(20).write.parquet(str(tmp_path / "t"))
    sample = quality.sample_of(spark.read.parquet(str(tmp_path / "t")), rows=50)
    assert sample.count() == 50 and sample.distinct().count() == 50
    whole = quality.sample_of(spark.read.parquet(str(tmp_path / "t")))
    assert 100 < whole.count() < 300  # 8 of 20 files


# personal data


def plain(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_plain_spans():
    rng = random.Random(2)
    for letters in ("ab@.-_12 +", "0123456789 -.", "+12 ().-3", "a@b.c1. "):
        for _ in range(4000):
            t = "".join(rng.choices(letters, k=rng.randint(0, 50)))
            assert pii.plain_spans(t) == plain(t), t


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john.doe [at] mail dot example dot com now", ["john.doe [at] mail dot example dot com"]),
        ("x john(at)example(dot)com y", ["john(at)example(dot)com"]),
        ("call plus four four two zero seven nine four six zero nine now", ["plus four four two zero seven nine four six zero nine"]),
        ("card four one one one one one one one one one one one one one one one.", ["four one one one one one one one one one one one one one one one"]),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", ["ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"]),
        ("jоhn@exаmple.com", ["jоhn@exаmple.com"]),
        ("jo​hn@example.com", ["jo​hn@example.com"]),
        ("ip 10 dot 0 dot 0 dot 1 ok", ["10 dot 0 dot 0 dot 1"]),
        ("+٤٤ ٢٠٧ ٩٤٦ ٠٩٥٨", ["+٤٤ ٢٠٧ ٩٤٦ ٠٩٥٨"]),
        ("one two three. meet at noon, a polka dot dress", []),
        ("", []),
    ],
)
def test_disguises(text, found):
    base, every = pii.all_spans(text)
    assert [text[a:b] for k, a, b in every if (k, a, b) not in base] == found


def test_long_runs_take_linear_time():
    t = "a" * 200_000 + " @ " + "1" * 200_000 + " " + "1." * 50_000 + "+1" * 50_000 + "one " * 50_000 + "[ " * 50_000
    assert sum(k == 1 for k, _, _ in pii.all_spans(t)[0]) == 12_500


def test_personal_data(odd, odd_texts, nothing):
    rows = {r.doc_id: r for r in pii.find_personal_data(odd).collect()}
    assert (rows[16].n_email, rows[16].n_ip, rows[16].n_card, rows[16].n_phone) == (1, 1, 1, 1)
    text = dict(odd_texts)[16]
    for span in rows[16].spans.split(","):
        kind, a, b = span.split(":")
        assert text[int(a) : int(b)]
    assert pii.find_personal_data(odd).count() == len(odd_texts)
    assert pii.find_personal_data(nothing).count() == 0
    assert pii.redacted("a.b@c.org 10.0.0.1") == "[EMAIL] [IP]"
    clean = odd.withColumn("text", pii.redact(odd.text)).collect()
    assert sum(r.text is None for r in clean) == sum(t is None for _, t in odd_texts)


# tokens


def samples(rng):
    letters = list("abstmdrvlle'''  \n\t\x0b 123.!?é漢字ß٣²\x1c\x1f\x85\xa0​　퟿🙂")
    yield from ("", " ", "'", "'r", "x'l", "a'v", "'s's", "!'s", " 's", "\n's", "<|endoftext|>a b<|endoftext|><|endoftext|> c", " <|endoftext|> ")
    for _ in range(3000):
        yield "".join(rng.choices(letters, k=rng.randint(0, 60)))
    for _ in range(60):
        yield "".join(rng.choices(letters, k=rng.randint(500, 900)))
    for _ in range(1000):
        yield "".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(0, 255)])) for _ in range(40))


def test_counts_and_ids_are_the_librarys(tokenizer):
    texts = list(samples(random.Random(3)))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(tokens.tokenizer_path()).counts(texts) == [len(w) for w in want]
    assert [a.tolist() for a in tokens.PieceEncoder(tokens.tokenizer_path()).encode(texts)] == want


def test_states_can_be_forgotten(tokenizer, monkeypatch, corpus_texts):
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 20)
    texts = [t for _, t in corpus_texts]
    assert token_counts.TokenCounter(tokens.tokenizer_path()).counts(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(odd, odd_texts, tokenizer, nothing):
    rows = token_counts.count_tokens(odd).collect()
    want = sorted((len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for _, t in odd_texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_counts.count_tokens(nothing).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for n, kinds in ((0, 5), (1, 5), (5000, 3), (20_000, 60), (20_000, 50_000)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 20))
        arrays = [np.append(a, 0).astype(np.uint32) for a in np.split(ids, cuts)]
        shard = token_output.Payload(token_output.write_payload(list(range(len(arrays))), arrays, 50_257))
        for k, a in enumerate(arrays):
            assert shard.document(k).tolist() == a.tolist()
            lo, hi = len(a) // 3, len(a) // 3 + min(7, len(a) - len(a) // 3)
            assert shard.ids(k, lo, hi).tolist() == a[lo:hi].tolist()
    assert len(token_output.Payload(token_output.write_payload([0], [np.tile(np.arange(4, dtype=np.uint32), 1000)], 50_257)).symbols) < 400
    with pytest.raises(ValueError):
        token_output.Payload(b"x" * 64)


def test_token_files(odd, odd_texts, tokenizer, nothing):
    rows = token_output.token_files(odd).collect()
    want = {}
    for _, t in odd_texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[zlib.crc32(ids.tobytes()), len(ids)] = want.get((zlib.crc32(ids.tobytes()), len(ids)), 0) + 1
    got = {}
    for r in rows:
        got[r.ids_crc32, r.n_tokens] = got.get((r.ids_crc32, r.n_tokens), 0) + 1
    assert got == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    key = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert key == sorted(key) and sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in odd_texts)
    assert token_output.token_files(nothing).count() == 0


def test_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 2049, 300)
        where, offset, fill = packing.best_fit(lengths)
        for b in range(len(fill)):
            at = np.flatnonzero(where == b)
            at = at[np.argsort(offset[at])]
            assert offset[at].tolist() == np.cumsum([0, *lengths[at]])[:-1].tolist()
            assert fill[b] == lengths[at].sum() <= 2048
        assert (fill <= 1024).sum() <= 1


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(odd, odd_texts, corpus, corpus_texts, tokenizer, nothing, capacity):
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        rows = packing.pack_documents(df, capacity=capacity).toPandas()
        want = []
        for key, t in texts:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            for k, (at, n) in enumerate(packing.pieces_of(len(ids), capacity)):
                want.append((-1 if key is None else key, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
        rows["doc_id"] = rows["doc_id"].fillna(-1).astype(int)
        assert sorted(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
        for _, own in rows.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist()
            assert own.length.sum() <= capacity
        assert rows.sequence_id.nunique() <= 1.02 * -(-rows.length.sum() // capacity) + 1
    assert packing.pack_documents(nothing).count() == 0


def test_pairs_are_replaced_until_none_is_frequent():
    """Long passages become single symbols, and no pair is left that occurs often enough."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50_000, 500)
    arrays = [np.concatenate([rng.integers(0, 50_000, 20), passage, rng.integers(0, 50_000, 20)]).astype(np.uint32) for _ in range(60)]
    arrays += [rng.integers(0, 4, 3000).astype(np.uint32), np.zeros(1000, np.uint32)]
    shard = token_output.Payload(token_output.write_payload(list(range(len(arrays))), arrays, 50_257))
    assert all(shard.document(k).tolist() == a.tolist() for k, a in enumerate(arrays))
    assert shard.symbol_counts[:60].max() <= 44 and shard.spans.max() >= 500
    left = collections.Counter()
    for k in range(len(arrays)):
        own = shard.symbols[shard.starts[k] : shard.starts[k + 1]].tolist()
        last = {}
        for i, pair in enumerate(zip(own, own[1:], strict=False)):
            if last.get(pair) != i - 1:
                left[pair] += 1
                last[pair] = i
    assert max(left.values()) < token_output.LEAST_COUNT


def test_ids_at_both_ends(spark, tokenizer):
    """The largest, the least and a missing id are three ids."""
    ids = [2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, 0, None, None]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows = sharding.shard_documents(df, 8).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    assert sorted(map(key, rows)) == sorted((i is not None, i or 0) for i in ids)
    for shard in {r.shard for r in rows}:
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [key(r) for r in own] == sorted(key(r) for r in own)
    for partitions in (1, 3):
        rows = sorted(token_output.token_files(df, partitions=partitions).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == [None, None, *sorted(i for i in ids if i is not None)]
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array([*tokenizer.encode(f"text {r.doc_id}", add_special_tokens=False).ids, 0], "<u4").tobytes())


def test_quality_of_unions_and_joins(spark, corpus, corpus_texts, tmp_path):
    """Tables of many files that aren't one read of files."""
    corpus.repartition(12).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    want = sorted((r.doc_id, r.kept) for r in quality.quality_report(corpus).collect())
    both = a.unionByName(spark.read.parquet(f"{tmp_path}/a"))
    joined = a.join(spark.read.parquet(f"{tmp_path}/a").select("doc_id", F.lit(1).alias("one")), "doc_id")
    for df, times in ((a, 1), (both, 2), (joined, 1)):
        assert sorted((r.doc_id, r.kept) for r in quality.quality_report(df).collect()) == sorted(want * times)
        assert sorted(r.doc_id for r in quality.quality_filter(df).collect()) == sorted([i for i, kept in want if kept] * times)
