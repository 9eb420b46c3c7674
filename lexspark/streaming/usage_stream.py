"""Usage counts kept up to date from a log of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import script_label
from ..operators.usage import local_day
from ..schemas import USAGE_EVENT


def label_events(calls: DataFrame) -> DataFrame:
    """(ts, tool, lang) of (ts, tool, text): the text's label is kept, the text isn't."""
    return calls.select("ts", "tool", script_label(F.col("text")).alias("lang"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(USAGE_EVENT).parquet(folder)


def daily_counts(events: DataFrame, key: str = "tool", late: str = "2 days") -> DataFrame:
    """(day, key, count) as a stream. Events more than ``late`` behind the latest may be left out; this bound is ours."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    kept = stream.filter(F.col(key).isNotNull())
    window = F.window("ts", "1 day", None, "15 hours")  # days at UTC+9 start at 15:00 UTC
    return kept.groupBy(window.alias("w"), key).agg(F.count("*").alias("count")).select(local_day(F.col("w.start")).alias("day"), key, "count")


def run_daily_counts(events: DataFrame, output: str, checkpoint: str, key: str = "tool") -> StreamingQuery:
    """Append each finished day's counts to Parquet; with the checkpoint, each exactly once."""
    out = daily_counts(events, key)
    return out.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_live_counts(events: DataFrame, update, checkpoint: str, key: str = "tool") -> StreamingQuery:
    """Call ``update(batch, number)`` with the days whose counts have changed; a batch may come twice and must overwrite."""
    return daily_counts(events, key).writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
