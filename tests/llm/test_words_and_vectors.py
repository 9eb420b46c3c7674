"""The pair index, clusters of vectors and spelling variants, each against a plain version."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest

from lexspark.llm import bpe, clustering, tokens, variants


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


# byte-level BPE

ODD = [
    "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a \n b", "\n\n x", "x\t\ty", "it's we'll I'M 'sx ''s", "1a2 3³ ⅷ", "é 漢字 🙂 \x1c \x85 end", "aaaaaaaa aaaaaaa aa", "a b　c d",
    "<|endoftext|>", "x<|endoftext|>y <|endoftext|> z", "<|endoftext", "\x00\x01", "ꙮ𝔘𝔫𝔦", "ab" * 300, "The quick  brown\r\nfox" * 50, "ümläut ßtraße ÇA", "퟿",
]


def test_pair_index_gives_the_librarys_ids(tokenizer, corpus_texts, monkeypatch):
    rng = random.Random(1)
    texts = ODD + [t for _, t in corpus_texts] + ["".join(rng.choices("aab \n'sé漢1!", k=rng.randint(1, 60))) for _ in range(2000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for long in (0, 24, 10**9):  # all rules by whole lists, as set, and place by place
        monkeypatch.setattr(bpe, "LONG", long)
        tool = bpe.OccurrenceEncoder(tokens.tokenizer_path())
        assert [x.tolist() for x in tool.encode(texts)] == want


def test_decoding_is_the_librarys(tokenizer):
    rng = np.random.default_rng(2)
    runs = [rng.integers(0, 50_400, n) for n in (0, 1, 7, 300, 300)] + [np.array([50_256, 72, 50_256])]  # among them ids that the file lacks, and broken UTF-8
    tool = bpe.OccurrenceEncoder(tokens.tokenizer_path())
    assert tool.decode(np.concatenate(runs), np.cumsum([len(x) for x in runs])) == [tokenizer.decode(x.tolist(), skip_special_tokens=False) for x in runs]


def test_round_trip(spark, odd, odd_texts, corpus, corpus_texts, tokenizer, nothing):
    for df, texts in ((odd, odd_texts), (corpus, corpus_texts)):
        want = []
        for i, t in texts:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            back = tokenizer.decode(ids, skip_special_tokens=False)
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        rows = bpe.round_trip_digests(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    texts = collections.Counter(r.text for r in bpe.decode_documents(bpe.encode_documents(odd)).collect())
    assert texts == collections.Counter(t or "" for _, t in odd_texts)
    assert bpe.round_trip_digests(nothing).count() == 0
    ids = spark.createDataFrame([(1, None), (2, b"\xff\xff\xff\x7f"), (3, b"")], "doc_id long, ids binary")
    assert [(r.n_tokens, r.text) for r in bpe.decode_documents(ids).orderBy("doc_id").collect()] == [(0, ""), (1, ""), (0, "")]
    with pytest.raises(Exception, match="four bytes"):
        bpe.decode_documents(spark.createDataFrame([(1, b"abc")], "doc_id long, ids binary")).collect()


def test_files_that_the_index_does_not_cover(tmp_path):
    with pytest.raises(ValueError, match="later rule"):
        bpe.Rules({"a": 0, "b": 1, "ab": 2, "abb": 3}, ["ab b", "a b"])
    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        parts = json.load(f)
    parts["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(parts))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.OccurrenceEncoder(str(tmp_path / "other.json"))


# clusters

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance long, tag string, v int"


def plain_clusters(rows, k, rounds, scale, dimension):
    """Lists of Python's whole numbers and no search."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(np.float64(x) * scale)) for x in v], v))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    centroids = [v for _, v, _ in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v, _ in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v, _ in kept]
    inertia = collections.Counter()
    for _, n, d in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found)


def vectors_of(rng, n, dimension, spread):
    middles = rng.normal(0, spread, (5, dimension))
    return [(int(i), (middles[i % 5] + rng.normal(0, 0.2, dimension)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("k", "spread"), [(8, 1.0), (3, 0.0), (20, 40.0), (300, 1.0)])
def test_clusters(spark, k, spread):
    rng = np.random.default_rng(k)
    rows = vectors_of(rng, 200, 64, spread)
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(30)]  # equal vectors: ties, and centroids that stay empty
    rows += [(7, same), (None, same), (None, rows[9][1]), (2000, None), (2001, []), (2002, same[:63]), (2003, [*same, 0.0]), (2004, [None, *same[1:]]), (2005, [float("nan"), *same[1:]]), (2006, [float("-inf"), *same[1:]])]
    df = spark.createDataFrame([(i, v, 1, 1, 1, "x", 1) for i, v in rows], VECTORS).repartition(5)
    got = clustering.cluster_vectors(df, k=k)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    found = sorted((str(r[0]), *r[1:]) for r in got.collect())
    assert found == plain_clusters(rows, k, 10, 1024, 64)


def test_clusters_of_nothing_and_of_few(spark):
    none = spark.createDataFrame([], VECTORS)
    assert clustering.cluster_vectors(none).collect() == []
    one = spark.createDataFrame([(5, [1.0] * 64, 1, 1, 1, "x", 1)], VECTORS)
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in clustering.cluster_vectors(one).collect()] == [(5, 0, 0, 0)]


def test_numbers_beyond_doubles_stay_exact(spark):
    """Sums of squares beyond 2^53 and components beyond 2^62: exact, or refused when a distance is no long."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 4) * 1e5).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = clustering.cluster_vectors(df, k=4, dimension=4).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_clusters(rows, 4, 10, 1024, 4)
    same = spark.createDataFrame([(i, [1e20, -1e20]) for i in range(3)], "vec_id long, embedding array<double>")
    assert {r.distance for r in clustering.cluster_vectors(same, k=2, dimension=2).collect()} == {0}
    far = spark.createDataFrame([(0, [1e20, 1.0]), (1, [-1e20, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        clustering.cluster_vectors(far, k=1, rounds=1, dimension=2).collect()


def test_annulus_border():
    """Centroids at equal distance on both borders of the annulus, and equal ones: the smaller number."""
    search = clustering.Annulus([[9, 0], [-3, 0], [3, 0], [9, 0], [3, 0], [0, 0]])
    number, square = search.nearest(np.array([[6, 0], [-6, 0], [0, 0], [3, 0], [100, 0], [0, 3]]))
    assert number.tolist() == [0, 1, 5, 2, 0, 5] and square.tolist() == [9, 9, 0, 0, 91 * 91, 9]
    rng = np.random.default_rng(0)
    for spread in (2, 50):
        c, v = rng.integers(-spread, spread, (40, 3)).tolist(), rng.integers(-spread, spread, (500, 3))
        number, square = clustering.Annulus(c).nearest(v)
        want = [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(c)) for x in v.tolist()]
        assert list(zip(square.tolist(), number.tolist(), strict=True)) == want


def test_annulus_leaves_out_far_norms(monkeypatch):
    """Centroids whose norm is beyond the bound are never compared."""
    compared = []
    matrix = clustering.Annulus._matrix
    monkeypatch.setattr(clustering.Annulus, "_matrix", lambda self, v, places: compared.extend(places.tolist()) or matrix(self, v, places))
    search = clustering.Annulus([[100 * i, 0] for i in range(50)])
    number, _ = search.nearest(np.array([[1004, 3], [1990, -2]]))
    assert number.tolist() == [10, 20] and set(compared) <= {9, 10, 11, 19, 20, 21}


# spelling variants


def plain_words(texts):
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def in_order(rows):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows), key=lambda r: r[0])


def test_variants_of_counted_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 5))) for _ in range(150)} | {"", "a", "aa", "aaa", "abab", "baba", "\U0001f642a", "\U0001f642b", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    words = {w: rng.choice([1, 1, 5, 5, 25, 25, 125, 625, 3125]) for w in words}  # many ties, long chains
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x"), ("null", None, "x")], "word string, n long, number string").repartition(6)
    assert in_order(variants.spelling_variants(df).collect()) == plain_variants(words)
    with pytest.raises(ValueError, match="factor"):
        variants.spelling_variants(df, factor=1)


def test_variants_of_documents(spark, odd, odd_texts, nothing):
    rng = random.Random(8)
    stems = ["colour", "flavour", "naïveté", "organise", "Ärgernis", "programme", "schön÷gut", "letters"]
    texts = list(odd_texts)
    for i in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeé") + w[at + 1 :], w[:at] + rng.choice("ou") + w[at:]])
            words.append(rng.choice([w, w.upper(), w + ",", "漢" + w]))
        texts.append((100 + i, " ".join(words)))
    texts += texts[30:33]  # repeated rows count each
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, n long, word long").repartition(4)
    words = plain_words(texts)
    assert len(words) > 50 and any(plain[1] for plain in plain_variants(words))
    assert sorted((r.word, r.n) for r in variants.count_words(df).filter("n >= 5").collect()) == sorted(words.items())
    assert in_order(variants.document_variants(df).collect()) == plain_variants(words)
    assert variants.document_variants(nothing).collect() == []


def test_keys_are_those_of_the_strings():
    """Equal keys exactly where the words, the deletions or the wildcards are equal."""
    words = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)] + ["ñandú", "\U0001f642\U0001f642b"]
    owner, kind, a, b = variants.keys_of(words)
    spelled = collections.defaultdict(set)
    for o, k, x, y in zip(owner.tolist(), kind.tolist(), a.tolist(), b.tolist(), strict=True):
        spelled[o, k].add((x, y))
    strings = {}
    for o, w in enumerate(words):
        strings[o, 0] = {w}
        strings[o, 1] = {w[:i] + w[i + 1 :] for i in range(len(w))}
        strings[o, 2] = {w[:i] + "*" + w[i + 1 :] for i in range(len(w))}
    for x, y in itertools.product(strings, repeat=2):
        assert len(strings[x] & strings[y]) == len(spelled.get(x, set()) & spelled.get(y, set()))
