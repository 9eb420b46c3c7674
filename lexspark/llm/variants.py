"""Operator 13: groups of spelling variants, without a row for any pair of words.

Every word of the vocabulary offers itself, its deletions (the word without one code point) and its
wildcards (the word with one code point replaced by a mark that is no letter) as keys. Words
under one wildcard differ in that place alone, so each has all others of the group as near words: the
group's size counts them, and its two first words say which is the best for every
member (the second for the first, the first for all others). A deletion that is a word of the
vocabulary makes it and the deletion's owners near: the word needs only their count and the first of
them, an owner only the word. Both are sums and minima per word in the end.

A key is two polynomials of the code points modulo 2^61 - 1, each made from running sums in
constant time, so a word of n letters offers 2 n keys of fixed size however long it is. The
chance that any two of m different keys of n letters meet is below m^2 n / 2^122.

Words are numbered in the order in which they are preferred (most occurrences, then code points),
so the better of two words is the smaller number, and keys carry numbers only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Words that a task counts before it hands them up, and code points whose keys are made together.
HELD_WORDS, BLOCK_POINTS = 1 << 20, 1 << 20

#: Letters of a word in Latin-1, ASCII capitals as small ones; all other bytes part words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

# Fixed values of the contract: one in DAMAGE (document, word) pairs loses a code point.
DAMAGE, LEAST_LENGTH, LEAST_COUNT, FACTOR = 199, 6, 5, 5

PRIME = np.uint64((1 << 61) - 1)
BASES = (1_306_847_219_640_129_011, 932_476_120_884_513_307)
#: The code of a wildcard: beyond all code points.
MARK = 0x110001


def mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, for any 64-bit x."""
    x = (x >> np.uint64(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, in halves of 31 bits."""
    low, mid = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    cross = a0 * b1 + a1 * b0
    return mod(np.uint64(2) * a1 * b1 + (cross >> np.uint64(30)) + ((cross & mid) << np.uint64(31)) + a0 * b0)


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo 2^61 - 1, from 0: one longer than x. Halves are added apart, so nothing overflows."""
    high, low = x >> np.uint64(31), x & np.uint64((1 << 31) - 1)
    total = mod(times(mod(np.cumsum(high, dtype=np.uint64)), np.full(len(x), 1 << 31, np.uint64)) + mod(np.cumsum(low, dtype=np.uint64)))
    return np.concatenate([np.zeros(1, np.uint64), total])


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^61 - 1, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), int(PRIME)), np.uint64))])
    return out[:n]


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, kind, first key, second key) of every key of the words: kind 0 the word, 1 a deletion, 2 a wildcard.

    A deletion that several places give (a doubled letter) is offered once.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[owner]
    # without a letter or the one after it that is the same, a word is the same
    doubled = np.zeros(len(points), bool)
    doubled[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
    keys = []
    for base in BASES:
        power = powers(base, int(lengths.max(initial=0)) + 1)
        term = times(points + np.uint64(1), power[place])
        sums = running(term)
        subtract = lambda a, b: mod(a + PRIME - b)
        whole = subtract(sums[ends], sums[starts])
        before = subtract(sums[:-1], sums[starts[owner]])
        behind = subtract(sums[ends[owner]], sums[1:])
        inverse = np.full(len(points), pow(base, -1, int(PRIME)), np.uint64)
        deleted = mod(before + times(behind, inverse))
        marked = mod(mod(before + behind) + times(np.full(len(points), MARK, np.uint64), power[place]))
        keys.append(np.concatenate([whole, deleted[~doubled], marked]).astype(np.int64))
    owners = np.concatenate([np.arange(len(words)), owner[~doubled], owner])
    kinds = np.concatenate([np.zeros(len(words), np.int8), np.ones(int((~doubled).sum()), np.int8), np.full(len(points), 2, np.int8)])
    return owners, kinds, *keys


def damaged(run: bytes, seed: int) -> str:
    """A run of letters (Latin-1) of the document whose prefix has the checksum ``seed``, without a letter if the checksum says so."""
    own = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(own, seed)
    if h % DAMAGE == 0:
        at = h % len(run)
        run = run[:at] + run[at + 1 :]
    return run.decode("latin-1")


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): how often each word of at least LEAST_LENGTH code points occurs. Counts are added up before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_up() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                seed = zlib.crc32(b"" if key is None else str(key).encode())
                seed = zlib.crc32(b":", seed)
                runs = Counter(w for w in body.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= LEAST_LENGTH)
                for run, n in runs.items():
                    word = damaged(run, seed)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield hand_up()
        if held:
            yield hand_up()

    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def numbered(vocabulary: DataFrame) -> DataFrame:
    """(number, word, n), written: numbers ascend from the most frequent word on, ties in code-point order."""
    ordered = vocabulary.select("word", "n").orderBy(F.desc("n"), "word")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("number"), "word", "n"), "vocabulary")


def offered_keys(words: DataFrame) -> DataFrame:
    """(a, b, kind, number): the keys of all numbered words."""

    def offer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            upto = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_POINTS, "right")))
                owner, kind, a, b = keys_of(batch.column(1).slice(at, stop - at).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind), pa.array(numbers[at:stop][owner])], ["a", "b", "kind", "number"])
                at = stop

    return words.select("number", "word").mapInArrow(offer, "a long, b long, kind byte, number long")


def near_words(words: DataFrame) -> DataFrame:
    """(number, n_near, best): of every word that has near words, how many and the number of the first of them.

    A group's rows are sorted and read once, whatever its size, and one row a member leaves
    it. An edit of one code point is one wildcard or one deletion, so no near word is counted twice.
    """
    group = Window.partitionBy("a", "b")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(whole)
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("number"))).over(whole)
    in_order = group.orderBy("kind", "number")
    keys = offered_keys(words).select(
        "kind", "number", count(1).alias("owners"), least(1).alias("first_owner"), least(0).alias("word"), count(2).alias("size"), least(2).alias("first"), F.lead("number").over(in_order).alias("next")
    )
    # a key of kind 0 or 1 never meets one of kind 2: the mark is no code point
    of_word = F.when((F.col("kind") == 0) & (F.col("owners") > 0), F.struct(F.col("owners").alias("n"), F.col("first_owner").alias("best")))
    of_owner = F.when((F.col("kind") == 1) & F.col("word").isNotNull(), F.struct(F.lit(1).cast("long").alias("n"), F.col("word").alias("best")))
    other = F.when(F.col("number") == F.col("first"), F.col("next")).otherwise(F.col("first"))
    of_group = F.when((F.col("kind") == 2) & (F.col("size") > 1), F.struct((F.col("size") - 1).alias("n"), other.alias("best")))
    found = keys.select("number", F.coalesce(of_word, of_owner, of_group).alias("x")).filter("x IS NOT NULL")
    return found.groupBy("number").agg(F.sum("x.n").alias("n_near"), F.min("x.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(number, root) from (number, form): each number's last form, by doubling of the steps.

    A form occurs at least twice as often as its word, so a chain has at most 62 steps, and
    doubling ends after 6 rounds; it stops as soon as no chain is left.
    """
    links = materialize(links.select("number", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("number").alias("root"), F.col("root").alias("_next"))
        joined = links.join(further, "root", "left")
        links = materialize(joined.select("number", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return links.select("number", "root")


def spelling_variants(vocabulary: DataFrame, word: str = "word", n: str = "n", factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of a table of distinct words and their counts.

    Two words are near if one edit of one code point (put in, left out or replaced) turns one into the other.
    A word's form is its near word with most occurrences, the first in code-point order of
    several, if it has ``factor`` (at least 2) times the word's; else null. The root is the last of the chain of
    forms, the word itself if it has none. Rows whose word or count is null are left out; the empty word is a word like
    any other. A very long word offers keys of fixed size. An empty table gives no row; extra columns are ignored.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    spark = vocabulary.sparkSession
    with scratch(spark):
        words = numbered(vocabulary.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n")).filter("word IS NOT NULL AND n IS NOT NULL"))
        near = materialize(near_words(words), "near")
        counts = words.select(F.col("number").alias("best"), F.col("n").alias("best_n"))
        found = words.select("number", "n").join(near, "number").join(counts, "best")
        forms = materialize(found.select("number", "n_near", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")).alias("form")), "forms")
        last = roots(forms.filter("form IS NOT NULL").select("number", "form"))
        of_form = words.select(F.col("number").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
        of_root = words.select(F.col("number").alias("root"), F.col("word").alias("root_word"))
        spelled = forms.join(last, "number", "left").join(of_form, "form", "left").join(of_root, "root", "left").select("number", "n_near", "form_word", "root_word", "form_n")
        out = words.join(spelled, "number", "left").select(
            "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
        )
        return materialize(out, "variants", keep=True)


def document_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """:func:`spelling_variants` of the words of all texts that occur at least ``least`` times.

    A null or empty text has no words; rows that repeat count each; a null id damages words as an empty one.
    """
    return spelling_variants(count_words(docs, doc_id, text).filter(F.col("n") >= least))
