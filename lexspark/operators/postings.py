"""An inverted index of character n-grams, for search of substrings without a scan of the bodies.

A token can only be in a row that has all of the token's grams of GRAM characters (a shorter token is a gram
itself). The index lists, for each gram, the rows that have it in their body or in a field beside it, by
blocks of BLOCK rows; its files are sorted by gram, so a search reads the row groups of its tokens' grams
alone. Lists of one block are intersected over the grams of a token and united over the tokens, which
gives the candidates: every row that holds a token is among them. Bodies are stored in a folder a block, and
only blocks with candidates are read. What is scored is the candidates' own text, so the
result is the scan's, row by row; rows that turn out to hold no token are the false candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from .keyword import ARTICLE_FIELDS, ATTACHMENT_FIELDS, CANDIDATES, FUZZY_LENGTH, hit_table, score_of

#: Characters of the longest gram, rows of a block, and characters whose grams are made together.
GRAM, BLOCK, SLICE = 3, 4096, 1 << 21

#: Bits of a character in a gram's number.
BITS = 21

KINDS = ("article", "attachment")
ROWS = "kind string, block long, item_index long, category string, source string, article_title string, chapter string, title string, body string"
POSTINGS = "kind string, gram long, block long, items array<int>"


def _number(gram: str) -> int:
    """The number of a gram of 1 to GRAM characters, as a long."""
    out = 0
    for c in gram:
        out = out << BITS | (ord(c) + 1)  # no character is 0, so grams of different lengths differ
    return out


def grams_of(token: str) -> list[int]:
    """Numbers of the grams that a text must have to hold the token; a ValueError for the empty one."""
    if not token:
        raise ValueError("a token has at least one character")
    n = min(GRAM, len(token))
    return sorted({_number(token[i : i + n]) for i in range(len(token) - n + 1)})


def text_grams(texts: list[str], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, owner) of all grams of the texts, each pair once, sorted; a gram lies within one text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(owners, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the text's end
    numbers, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, GRAM + 1):
        size = max(len(points) - n + 1, 0)
        gram = gram[:size] << np.uint64(BITS) | points[n - 1 :]
        inside = left[:size] >= n
        numbers, held = np.concatenate([numbers, gram[inside]]), np.concatenate([held, owner[:size][inside]])
    order = np.lexsort((held, numbers))
    numbers, held = numbers[order], held[order]
    once = np.ones(len(numbers), bool)
    once[1:] = (numbers[1:] != numbers[:-1]) | (held[1:] != held[:-1])
    return numbers[once].view(np.int64), held[once]


def index_rows(articles: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Both tables as rows of ROWS. Nulls in texts are empty; ``item_index`` tells the rows of a kind apart."""
    none = F.lit("")
    text = lambda c: F.coalesce(F.col(c), none).alias(c)
    common = [F.floor(F.col("item_index") / BLOCK).alias("block"), F.col("item_index").cast("long").alias("item_index"), "category", "source"]
    out = articles.select(F.lit("article").alias("kind"), *common, text("article_title"), text("chapter"), none.alias("title"), text("body"))
    if attachments is not None:
        out = out.unionByName(attachments.select(F.lit("attachment").alias("kind"), *common, none.alias("article_title"), none.alias("chapter"), text("title"), text("body")))
    return out


def partial_postings(rows: DataFrame) -> DataFrame:
    """POSTINGS of stored rows, a file of which is of one block; lists of one gram and block may come in parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, blocks, items = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            texts = list(zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True))
            at = 0
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and (stop == at or size < SLICE) and (kinds[stop], blocks[stop]) == (kinds[at], blocks[at]):
                    size += sum(map(len, texts[stop]))
                    stop += 1
                own = [t for row in texts[at:stop] for t in row]
                grams, owners = text_grams(own, np.repeat(items[at:stop] - blocks[at] * BLOCK, 4))
                cuts = np.flatnonzero(np.diff(grams, prepend=grams[:1] - 1)) if len(grams) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(grams)), pa.int32()), pa.array(owners, pa.int32()))
                n = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array([kinds[at]] * n), pa.array(grams[cuts]), pa.array(np.full(n, blocks[at]), pa.int64()), lists], ["kind", "gram", "block", "items"])
                at = stop

    some = rows.select("kind", "block", "item_index", "body", "article_title", "chapter", "title")
    return some.mapInArrow(make, POSTINGS)


def build_postings(articles: DataFrame, attachments: DataFrame | None, path: str) -> None:
    """Write the index under ``path``: ``rows`` in a folder a kind and block, ``postings`` sorted by gram.

    One exchange deals the rows to blocks and one the lists; a list never has more than BLOCK rows, so a
    gram that every row has is many lists and no hot key. Each file is sorted, so of each only the
    row groups of the asked grams are read.
    """
    rows = index_rows(articles, attachments).repartition("kind", "block")
    rows.write.partitionBy("kind", "block").parquet(f"{path}/rows")
    spark = articles.sparkSession
    stored = read_rows(spark, path)
    whole = partial_postings(stored).groupBy("kind", "gram", "block").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    whole.sortWithinPartitions("kind", "gram", "block").write.parquet(f"{path}/postings")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def _lists(posted: DataFrame, wanted: dict[str, list[int]]) -> DataFrame:
    numbers = sorted({g for grams in wanted.values() for g in grams})
    held = posted.filter(F.col("gram").isin(numbers)) if numbers else posted.limit(0)
    columns = [F.max(F.when(F.col("gram") == g, F.col("items"))).alias(f"g{i}") for i, g in enumerate(numbers)]
    return held.groupBy("kind", "block").agg(*columns or [F.lit(None).alias("none")])


def candidates(spark: SparkSession, path: str, tokens: list[str], fuzzy: bool = False) -> DataFrame:
    """(kind, block, item_index) of every row that may hold a token: at least those that do.

    A near hit of a token needs one of its pairs, so with ``fuzzy`` the rows of any pair are taken.
    """
    wanted = {t: grams_of(t) for t in tokens}
    near = {t: sorted({_number(t[i : i + 2]) for i in range(len(t) - 1)}) for t in tokens if fuzzy and len(t) >= FUZZY_LENGTH}
    posted = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    numbers = sorted({g for grams in [*wanted.values(), *near.values()] for g in grams})
    place = {g: i for i, g in enumerate(numbers)}
    lists = _lists(posted, {"": numbers})
    empty = F.array().cast("array<int>")
    of = lambda g: F.coalesce(F.col(f"g{place[g]}"), empty)
    both: list[Column] = [reduce(F.array_intersect, map(of, grams)) for grams in wanted.values()]
    both += [reduce(F.array_union, map(of, grams)) for grams in near.values()]
    items = reduce(F.array_union, both) if both else empty
    found = lists.select("kind", "block", F.explode(items).alias("at"))
    return found.select("kind", "block", (F.col("block") * BLOCK + F.col("at")).alias("item_index"))


#: Blocks with candidates that are broadcast to prune folders (16 bytes each); with more of them there is little to prune.
BROADCAST_BLOCKS = 1_000_000


def block_rows(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The stored rows of the blocks that have candidates; folders of other blocks are not read."""
    blocks = found.select("kind", "block").distinct()
    rows = read_rows(spark, path)
    if blocks.count() > BROADCAST_BLOCKS:
        return rows
    # the condition holds for all blocks; with one, Spark takes the join for a selective one and prunes folders
    return rows.join(F.broadcast(blocks.filter("block > -9223372036854775808")), ["kind", "block"], "left_semi")


def candidate_rows(spark: SparkSession, path: str, tokens: list[str], fuzzy: bool = False) -> DataFrame:
    """The stored rows of the candidates alone."""
    found = written(candidates(spark, path, tokens, fuzzy), "candidates")
    return block_rows(spark, path, found).join(found.select("kind", "item_index"), ["kind", "item_index"], "left_semi")


FIELDS = [*ARTICLE_FIELDS, *ATTACHMENT_FIELDS]


def candidate_hits(spark: SparkSession, path: str, tokens: list[str], fuzzy: bool = False) -> DataFrame:
    """The hits of all rows that have any, written: bodies are read once, for weights and scores, and in no exchange.

    The blocks of candidates are looked through as they are read. A row in them that is no candidate
    has no hit, so it needs no join to leave it out. Only articles have near hits, as in a scan.
    """
    keep = ("kind", "item_index", "category", "source")
    fields = [f for f, _ in FIELDS]
    rows = block_rows(spark, path, written(candidates(spark, path, tokens, fuzzy), "candidates"))
    if not fuzzy:
        hits = hit_table(rows, tokens, fields, False, keep)
    else:
        parts = [hit_table(rows.filter(F.col("kind") == kind), tokens, fields, kind == "article", keep) for kind in KINDS]
        hits = parts[0].unionByName(parts[1])
    some = reduce(lambda a, b: a | b, ((F.col(f"_n{i}") > 0) | _held(i) for i in range(len(tokens))), F.lit(False))
    return written(hits.filter(some), "hits")


def _held(i: int) -> Column:
    return F.col(f"_e{i}") | F.col(f"_f{i}_article_title") | F.col(f"_f{i}_chapter") | F.col(f"_f{i}_title")


def ranking_by_postings(
    spark: SparkSession, path: str, tokens: list[str], limit: int = CANDIDATES, fuzzy: bool = False, with_attachments: bool = True, category: str | None = None, matches: Column | None = None
) -> DataFrame:
    """(kind, item_index, score, position): the rows of :func:`.keyword.keyword_ranking`, from the index under ``path``.

    Weights come from all articles, whatever ``category`` and ``matches`` (a condition on the source)
    leave to be ranked. The articles are counted by their folders' footers, without their texts.
    """
    hits = candidate_hits(spark, path, tokens, fuzzy)
    n = read_rows(spark, path).filter("kind = 'article'").count()
    # a number for each token
    df = hits.filter("kind = 'article'").agg(F.lit(0), *[F.sum(_held(i).cast("long")) for i in range(len(tokens))]).first()[1:]
    weights = [F.lit(math.log((n + 1) / ((d or 0) + 1)) + 1.0) for d in df]
    some = hits if with_attachments else hits.filter("kind = 'article'")
    some = some.filter(F.col("category") == category) if category else some
    some = some if matches is None else some.filter(matches)
    found = some.select("kind", "item_index", score_of(weights, FIELDS).alias("score"), F.col("_position").alias("position"))
    return found.orderBy(F.desc("score"), "kind", "item_index").limit(limit).filter(F.col("score") > 0)


def postings_report(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """(kind, rows, blocks, candidate_blocks, candidates, true_candidates) of a search: how much of the table it reads, and for how many rows in vain."""
    every = read_rows(spark, path).groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("block").alias("blocks"))
    asked = candidates(spark, path, tokens).groupBy("kind").agg(F.count("*").alias("candidates"), F.countDistinct("block").alias("candidate_blocks"))
    right = reduce(lambda a, b: a | b, (_held(i) for i in range(len(tokens))), F.lit(False))
    held = candidate_hits(spark, path, tokens).groupBy("kind").agg(F.sum(right.cast("long")).alias("true_candidates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(asked, "kind", "left").join(held, "kind", "left").select("kind", "rows", "blocks", zero("candidate_blocks"), zero("candidates"), zero("true_candidates"))
