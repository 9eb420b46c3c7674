"""Operator 1: sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The generator's multiplier, and one drawn float's scale, as published for jump consistent hashing.
MULTIPLIER = 2862933555777941757
SCALE = float(1 << 31)

#: Rank buckets. A bound on what is broadcast: at most RANK_BUCKETS x shards offsets.
RANK_BUCKETS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, for ``shards`` >= 1.

    Each key walks a pseudo-random sequence of growing jumps and stays at the
    last position below ``shards``; adding a shard therefore moves a key only
    into the new shard, and with probability 1 / (shards + 1).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump = ((at[live] + 1) * (SCALE / step)).astype(np.int64)
        inside = jump < shards
        live = live[inside]
        at[live] = jump[inside]
    return at


def _jump(shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard number 0 .. shards-1 of a long key; a null key counts as key 0."""
    return _jump(shards)(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard and its gapless place there, for a long key.

    Adds ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``
    (the shard once one more is appended) to ``key``. A slot is the row's rank in
    its shard by (key, text_crc32, size), nulls first. A null text has size 1 and the
    checksum 0 of the empty text; rows with a null key all go where key 0 goes.
    Repeated rows get slots of their own.

    Ranks come from rank buckets: ``RANK_BUCKETS`` key ranges whose bounds are
    fixed on the driver (a bounded list), counts per (shard, range), and a window
    within one (shard, range) only, so no task holds a whole shard.
    """
    plain = docs.select(
        F.col(key).cast("long").alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    quantiles = [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)]
    found = docs.select(F.col(key).cast("long").cast("double").alias("key")).approxQuantile("key", quantiles, 0.0005)
    bounds = sorted({int(min(x, 2.0**63 - 1024)) for x in found if x == x})  # the largest long is no double

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(np.int64), side="right")
        return pd.Series(found.astype(np.int32))

    # a null key counts as the least long; a batch with nulls would reach pandas as doubles
    bucket = bucket_of(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")))
    placed = plain.withColumn("bucket", bucket)
    counts = docs.select(jump_shard(F.col(key), shards).alias("shard"), bucket.alias("bucket"))
    counts = counts.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )
