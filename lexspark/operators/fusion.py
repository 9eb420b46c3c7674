"""Reciprocal-rank fusion of the keyword and the dense ranking. Both are top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
SEMANTIC_WEIGHT = 1.0


def rrf_fusion(keyword: DataFrame, semantic: DataFrame, k: int = RRF_K, weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """(kind, item_index, keyword_rank, semantic_rank, fused, place) of two tables (kind, item_index, rank).

    Ties go to the keyword channel, then the better rank, then the key. ``place`` counts from 1.
    Other columns of the tables are carried along, so no ranking has to be computed again for them.
    """
    a = keyword.withColumnRenamed("rank", "keyword_rank")
    b = semantic.withColumnRenamed("rank", "semantic_rank")
    both = a.join(b, ["kind", "item_index"], "full")
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.col(rank) + k), F.lit(0.0))
    both = both.withColumn("fused", part("keyword_rank", 1.0) + part("semantic_rank", weight))
    channel, rank = F.when(F.col("keyword_rank").isNull(), 1).otherwise(0), F.coalesce("keyword_rank", "semantic_rank")
    return both.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fused"), channel, rank, "kind", "item_index")))


def keep_channel_heads(fused: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by place, with both channels' first hits among them where there is room for two."""
    if limit <= 0:
        return fused.limit(0)
    if limit < 2:
        return fused.filter(F.col("place") <= limit)
    head = (F.coalesce("keyword_rank", F.lit(0)) == 1) | (F.coalesce("semantic_rank", F.lit(0)) == 1)
    order = Window.orderBy(F.desc(head.cast("int")), "place")
    return fused.withColumn("_order", F.row_number().over(order)).filter(F.col("_order") <= limit).drop("_order")
