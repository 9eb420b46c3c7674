"""Operator 9: benchmark items inside documents, by size-partitioned MinHash containment. DataFrame functions only.

Items are partitioned by their number of distinct shingles, n. A document that holds at least
``need`` of them misses at most n - need, so of any n - need + 1 it holds one: a partition's sketch
is that many of the smallest hashes of each item. Two passes:

1. every shingle of every whole text probes the sketches, as hashes; a document and an item that meet are candidates;
2. the candidate documents, few as leaks are, are cut into shingles as text, which are counted exactly
   against the items they are candidates for.

No other pair is looked at, and none can be lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, scratch
from .quality import CAPITALS, hold, words_of

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80

#: Most sketch rows of a benchmark that are broadcast (two numbers each, so 5 MB); a larger one is
#: joined by shuffling on the shingle hash.
BROADCAST_SHINGLES = 200_000


def _words(text: Column) -> Column:
    """Lower-cased (A-Z) words."""
    return words_of(F.translate(text, CAPITALS, CAPITALS.lower()))


def _starts(words: str, width: int) -> Column:
    """Where windows of ``width`` words start, from 0; none in a shorter text."""
    last = F.size(words) - width
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hashes(hashes: str, width: int) -> Column:
    """A hash of each window of ``width`` words, from the words' hashes."""
    return F.transform(_starts(hashes, width), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(width)], F.lit(width)))


def _shingle_texts(words: str, width: int) -> Column:
    return F.transform(_starts(words, width), lambda i: F.concat_ws(" ", F.slice(words, i + 1, width)))


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Distinct shingles of each item: (item_id, width, n, need, h, shingle, in_sketch).

    An item of fewer than ``width`` words is one shingle, its whole word sequence;
    one without words has none. ``need`` is the least number of shared shingles,
    ceil(percent n / 100). Items of one size form a partition with one MinHash
    sketch size n - need + 1: a document that holds ``need`` of n shingles misses at
    most n - need, so at least one of any n - need + 1 is in it. The sketch takes
    the smallest hashes, the same order for all items.
    """
    w = hold(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")), w=_words(F.col("text"))).drop("text").filter(F.size("w") > 0)
    w = hold(w, hs=_hashes(F.col("w"))).withColumn("width", F.least(F.size("w"), F.lit(width)))
    parts = None
    for k in range(1, width + 1):
        both = F.arrays_zip(_shingle_hashes("hs", k).alias("h"), _shingle_texts("w", k).alias("shingle"))
        part = w.filter(F.col("width") == k).select("item_id", "width", F.inline(both).alias("h", "shingle"))
        parts = part if parts is None else parts.unionByName(part)
    distinct = parts.distinct()
    size = Window.partitionBy("item_id")
    sized = distinct.withColumn("n", F.count("*").over(size)).withColumn("need", F.ceil(F.col("n") * percent / 100).cast("long"))
    place = F.row_number().over(size.orderBy("h", "shingle"))
    return sized.withColumn("in_sketch", place <= F.col("n") - F.col("need") + 1)


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT, broadcast_limit: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) for each document that holds at least ``percent`` of an item's distinct shingles, as a written table.

    What is shuffled is in proportion to the leaks: hits of sketches, then the shingles of candidate
    documents that are an item's.

    Null or empty texts on either side match nothing. Repeated items give a row each;
    rows that repeat a doc_id count as one document, and so do those with a null one. Case A-Z is
    ignored. A very long text is one row's arrays. Ties don't matter: all pairs over the
    threshold are returned.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        return materialize(_contained(texts, item_shingles(items, item_id, item_text, width, percent), width, broadcast_limit), "leaks", keep=True)


def _contained(texts: DataFrame, items: DataFrame, width: int, broadcast_limit: int) -> DataFrame:
    index = materialize(items, "benchmark-shingles")
    widths = sorted(r[0] for r in index.select("width").distinct().collect())  # at most ``width`` numbers
    found = materialize(candidates(texts, index, widths, broadcast_limit), "leak-candidates")
    suspects = texts.join(found.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    cut = hold(suspects, w=_words(F.col("text"))).drop("text")
    of_width = lambda k: F.transform(F.array_distinct(_shingle_texts("w", k)), lambda x: F.struct(F.lit(k).alias("width"), x.alias("shingle")))
    every = F.concat(*map(of_width, widths or [width]))
    held = cut.select("doc_id", F.inline(every)).join(index.drop("h", "in_sketch"), ["width", "shingle"])
    held = held.select("doc_id", "item_id", "n", "need", "shingle").distinct()
    pairs = held.groupBy("doc_id", "item_id", "n", "need").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= F.col("need"))
    same = pairs["doc_id"].eqNullSafe(F.col("_doc")) & pairs["item_id"].eqNullSafe(F.col("_item"))
    candidate = found.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item"))
    return pairs.join(candidate, same, "left_semi").select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"))


def candidates(texts: DataFrame, index: DataFrame, widths: list[int], broadcast_limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """Distinct (doc_id, item_id) of documents (doc_id, text) that hold a shingle of an item's sketch."""
    sketches = index.filter("in_sketch").select("h", "item_id")
    table = F.broadcast(sketches) if sketches.count() <= broadcast_limit else sketches
    hashed = hold(texts, hs=_hashes(_words(F.col("text")))).drop("text")
    probes = hashed.select("doc_id", F.explode(F.concat(*[_shingle_hashes("hs", k) for k in widths or [SHINGLE_WORDS]])).alias("h"))
    return probes.join(table, "h").select("doc_id", "item_id").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, columns unchanged.

    Each row is judged by its own text: where ids repeat or are null, rows are numbered and the
    numbers stand for the ids. Null and empty texts hold nothing and stay.
    """
    number = F.col(doc_id).cast("long")
    if not docs.groupBy(number).count().filter(F.col("count") > 1).limit(1).count():
        return _without(docs, number, contained_items(docs, items, doc_id, text, **options))
    # written, so that a row has one number throughout; the row itself is one column, clear of any name
    rows = materialize(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_number")), "numbered-rows")
    return _without(rows, F.col("_number"), contained_items(rows, items, "_number", "_text", **options)).select("_row.*")


def _without(rows: DataFrame, number: Column, leaks: DataFrame) -> DataFrame:
    name = free_name(rows, "_leak")
    return rows.join(leaks.select(F.col("doc_id").alias(name)).distinct(), number.eqNullSafe(F.col(name)), "left_anti")
