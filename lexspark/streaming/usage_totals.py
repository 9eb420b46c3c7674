"""Totals and days of usage kept up to date by a stream, each event counted once.

A batch is counted first, so only its distinct keys meet the stored counts; these are merged into the next
version of the stored table. The version's pointer names, for each streaming query, the last batch that it
holds, and moves in the same step as the table: a batch that comes again after a failure is
passed over, and one whose merge was cut off is merged from the version before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import local_day
from ..sources.tables import current, publish, read_pointer

#: One row a key: in total (day is null), or on a day.
COUNTS = "kind string, key string, day date, count long, first_seen timestamp, last_seen timestamp"


def counts_of(events: DataFrame) -> DataFrame:
    """COUNTS of (ts, tool, lang): each tool and language, in total and by day of UTC+9. Missing keys don't count."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("tool", "lang")])
    days = F.array(F.lit(None).cast("date"), local_day(F.col("ts")))
    each = events.select("ts", F.inline(kinds)).filter(F.col("key").isNotNull()).select("ts", "kind", "key", F.explode(days).alias("day"))
    return each.groupBy("kind", "key", "day").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """COUNTS as they stand; no row before the first batch."""
    if read_pointer(spark, path) is None:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(f"{current(spark, path)}/counts")


def merge_batch(events: DataFrame, path: str, query: str, number: int) -> bool:
    """Merge one batch of a query's events into the stored counts; whether it was new."""
    spark = events.sparkSession
    said = read_pointer(spark, path)
    done = said["batches"] if said else {}
    if done.get(query, -1) >= number:
        return False
    both = read_counts(spark, path).unionByName(counts_of(events))
    merged = both.groupBy("kind", "key", "day").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    publish(spark, path, lambda folder: merged.write.parquet(f"{folder}/counts"), batches=done | {query: number})
    return True


def run_totals(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of (ts, tool, lang) into the counts at ``path``, as far as there are events now.

    A checkpoint stands for one query, whose batches are numbered on when it is started again. Events
    may be of any age: nothing is left out as late.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, path, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint, number)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str, kind: str = "tool") -> DataFrame:
    """(key, count, first_seen, last_seen) as :func:`..operators.usage.usage_totals` has them, most used first."""
    rows = read_counts(spark, path).filter((F.col("kind") == kind) & F.col("day").isNull())
    return rows.select(F.col("key").alias(kind), "count", "first_seen", "last_seen").orderBy(F.desc("count"), kind)


def daily(spark: SparkSession, path: str, kind: str = "tool") -> DataFrame:
    """(day, key, count)."""
    return read_counts(spark, path).filter((F.col("kind") == kind) & F.col("day").isNotNull()).select("day", F.col("key").alias(kind), "count")
