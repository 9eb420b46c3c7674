"""Search: allowed rows, two rankings, fusion, and the rows shown."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet, source_match, tokenize
from ..operators.dense import SemanticUnavailable, dense_ranking, row_numbers
from ..operators.fusion import keep_channel_heads, rrf_fusion
from ..operators.keyword import CANDIDATES, keyword_ranking, weights_of
from ..operators.postings import ranking_by_postings
from .expansion import expand_query

MODES = ("hybrid", "keyword", "semantic")
HITS = (
    "place int, type string, item_index long, category string, source string, revision string, citation string, snippet string, "
    "score double, search_mode string, matched_by string, keyword_score double, semantic_score double, "
    "chapter string, article string, article_title string, kind string, label string, title string"
)


def allowed_rows(rows: DataFrame, category: str | None, source: str | None) -> DataFrame:
    out = rows.filter(F.col("category") == category) if category else rows
    return out.filter(source_match(source, F.col("source")))


def search(
    articles: DataFrame, attachments: DataFrame, query: str, category: str | None = None, source: str | None = None, limit: int = 10,
    fuzzy: bool = False, include_attachments: bool = False, mode: str = "hybrid", chunks: DataFrame | None = None,
    encode: Callable[[str], Sequence[float]] | None = None, paused: Callable[[], bool] = lambda: False, postings: str | None = None,
) -> DataFrame:
    """The best ``limit`` rows for a query, as HITS; a bad mode is a ValueError before anything is read.

    ``hybrid`` fuses the two rankings; where ``chunks`` (with vectors) or ``encode`` is missing or
    refuses, or dense search is ``paused``, it falls back to keywords and says so. ``semantic``
    reads no text unless it has to fall back. With ``postings``, the folder of an index of these tables
    (:mod:`lexspark.operators.postings`), keywords are looked up there and no body is scanned.
    """
    mode = mode.lower().strip()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    spark = articles.sparkSession
    if not query.strip() or limit <= 0:
        return spark.createDataFrame([], HITS)
    some = allowed_rows(articles, category, source)
    attached = allowed_rows(attachments.filter(~F.col("deleted")), category, source) if include_attachments else None
    k = max(limit, CANDIDATES)

    def by_keyword() -> DataFrame:
        tokens = tokenize(query)
        if not tokens:
            return spark.createDataFrame([], "kind string, item_index long, score double, position int, rank int")
        if postings is None:
            top = keyword_ranking(some, attached, tokens, weights_of(articles, tokens), k, fuzzy)
        else:
            top = ranking_by_postings(spark, postings, tokens, k, fuzzy, include_attachments, category, source_match(source, F.col("source")) if source else None)
        return row_numbers(top, F.desc("score"), "kind", "item_index")

    def allowed_keys() -> DataFrame:
        keys = some.select(F.lit("article").alias("kind"), "item_index")
        return keys if attached is None else keys.unionByName(attached.select(F.lit("attachment").alias("kind"), "item_index"))

    semantic = None
    if mode != "keyword":
        try:
            if chunks is None or encode is None or paused():
                raise SemanticUnavailable("no vectors, or paused")
            # without a filter all chunks of articles are allowed, and nothing has to be joined
            free = not category and not source and attached is None
            some_chunks = chunks.filter(F.col("kind") == "article") if free else chunks
            ranked = dense_ranking(some_chunks, encode(expand_query(query)), k, allowed=None if free else allowed_keys())
            semantic = row_numbers(ranked, F.desc("score"), "kind", "item_index")
        except SemanticUnavailable:
            semantic = None
    middle = ((F.col("start") + F.col("end")) / 2).cast("int")
    if mode == "semantic" and semantic is not None:
        chosen = semantic.filter(F.col("rank") <= limit).select("kind", "item_index", F.col("rank").alias("place"), "score", F.lit(None).cast("double").alias("ks"), F.col("score").alias("ss"), middle.alias("position"))
        label = "semantic"
    elif semantic is None:
        words = by_keyword().filter(F.col("rank") <= limit)
        chosen = words.select("kind", "item_index", F.col("rank").alias("place"), "score", F.col("score").alias("ks"), F.lit(None).cast("double").alias("ss"), "position")
        label = "keyword" if mode == "keyword" else "keyword_fallback"
    else:
        words = by_keyword().select("kind", "item_index", "rank", F.col("score").alias("ks"), "position")
        near = semantic.select("kind", "item_index", "rank", F.col("score").alias("ss"), middle.alias("middle"))
        fused = keep_channel_heads(rrf_fusion(words, near), limit)
        chosen = fused.select("kind", "item_index", "place", F.col("fused").alias("score"), "ks", "ss", F.coalesce("position", "middle").alias("position"))
        label = "hybrid"
    return show(chosen, articles, attachments, label, limit)


#: Most chosen keys that are broadcast against the tables (about 100 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 10_000


def all_rows(articles: DataFrame, attachments: DataFrame) -> DataFrame:
    """(type, item_index, category, source, revision, body, chapter, article, article_title, kind, label, title) of both tables."""
    none = F.lit(None).cast("string")
    common = ["item_index", "category", "source", "revision", "body"]
    a = articles.select(F.lit("article").alias("type"), *common, "chapter", "article", "article_title", none.alias("kind"), none.alias("label"), none.alias("title"))
    b = attachments.select(F.lit("attachment").alias("type"), *common, none.alias("chapter"), none.alias("article"), none.alias("article_title"), "kind", "label", "title")
    return a.unionByName(b)


def show(chosen: DataFrame, articles: DataFrame, attachments: DataFrame, mode: str, limit: int) -> DataFrame:
    """The chosen keys, ``limit`` at most, with what is shown of their rows.

    The few keys go to the tables, not the tables' bodies to the keys.
    """
    digits = 2 if mode.startswith("keyword") else 4 if mode == "semantic" else 6
    keys = chosen.withColumnRenamed("kind", "type")
    rows = all_rows(articles, attachments).join(F.broadcast(keys) if limit <= BROADCAST_KEYS else keys, ["type", "item_index"])
    by = F.when(F.col("ks").isNotNull() & F.col("ss").isNotNull(), "hybrid").when(F.col("ks").isNotNull(), "keyword").otherwise("semantic")
    return rows.select(
        F.col("place").cast("int").alias("place"), "type", "item_index", "category", "source", "revision", F.concat_ws(" ", "source", F.coalesce("article", "label")).alias("citation"),
        snippet(F.col("body"), F.col("position")).alias("snippet"), F.round("score", digits).alias("score"), F.lit(mode).alias("search_mode"), by.alias("matched_by"),
        F.round("ks", 2).alias("keyword_score"), F.round("ss", 4).alias("semantic_score"), "chapter", "article", "article_title", "kind", "label", "title",
    ).orderBy("place")


def recall_at_k(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(mode, hits, queries, recall): of (query, expected item) rows, how many are in the first ``k`` of (mode, query, item_index, rank)."""
    top = ranked.filter(F.col("rank") <= k).select("mode", "query", "item_index").distinct()
    # a ranking has one of few modes, so each expected row is repeated that often and nothing is crossed
    modes = F.broadcast(ranked.agg(F.array_sort(F.collect_set("mode")).alias("_modes")))
    asked = expected.join(modes).select("*", F.explode("_modes").alias("mode")).drop("_modes")
    hit = asked.join(top.withColumn("hit", F.lit(1)), ["mode", "query", "item_index"], "left")
    per_query = hit.groupBy("mode", "query").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per_query.groupBy("mode").agg(F.sum("hit").alias("hits"), F.count("*").alias("queries"), F.avg("hit").alias("recall"))
