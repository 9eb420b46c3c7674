"""Usage counts by tool and language, in total, by day and by week. A day is one of UTC+9, a week starts on Monday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET_HOURS = 9


def local_day(ts: Column) -> Column:
    """The date of a UTC time at UTC+9."""
    return F.to_date(ts + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS"))


def usage_totals(events: DataFrame, key: str = "tool") -> DataFrame:
    """(key, count, first_seen, last_seen), most used first."""
    out = events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.orderBy(F.desc("count"), key)


def usage_daily(events: DataFrame, key: str = "tool") -> DataFrame:
    """(day, key, count)."""
    return events.filter(F.col(key).isNotNull()).groupBy(local_day(F.col("ts")).alias("day"), key).agg(F.count("*").alias("count"))


def daily_breakdown(events: DataFrame) -> DataFrame:
    """(day, total, tools, by_language): a day's counts as maps; the total counts tools only. Latest day first."""
    as_map = lambda key: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count"))))
    tools = usage_daily(events, "tool").groupBy("day").agg(F.sum("count").alias("total"), as_map("tool").alias("tools"))
    langs = usage_daily(events, "lang").groupBy("day").agg(as_map("lang").alias("by_language"))
    none = F.from_json(F.lit("{}"), "map<string,bigint>")
    out = tools.join(langs, "day", "full").select("day", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("tools", none).alias("tools"), F.coalesce("by_language", none).alias("by_language"))
    return out.orderBy(F.desc("day"))


def usage_weekly(daily: DataFrame, key: str = "tool") -> DataFrame:
    """(week, key, count) of daily counts."""
    return daily.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week"), key).agg(F.sum("count").alias("count"))


def week_view(daily: DataFrame, day: Column, key: str = "tool") -> DataFrame:
    """(key, count) of the week that holds ``day``, most used first."""
    monday = F.to_date(F.date_trunc("week", day))
    inside = daily.filter(F.col("day").between(monday, F.date_add(monday, 6)))
    return inside.groupBy(key).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), key)


def backfill_missing_days(daily: DataFrame, totals: DataFrame, key: str = "tool") -> DataFrame:
    """``daily`` with, for each key, its total on the day it was last seen, where that day has no row of it."""
    late = totals.select(local_day(F.col("last_seen")).alias("day"), key, "count")
    return daily.select("day", key, "count").unionByName(late.join(daily, ["day", key], "left_anti"))


def escape_label(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def metrics_lines(events: DataFrame, prefix: str = "lexspark") -> DataFrame:
    """(section, place, line): counts in the text format that metric scrapers read."""
    tool = F.concat(F.lit('tool="'), escape_label(F.col("tool")), F.lit('"'))
    week = F.concat(F.lit('week_start="'), F.col("week").cast("string"), F.lit('"'))
    number = F.col("count").cast("string")
    line = lambda name, *labels: F.concat(F.lit(f"{prefix}_{name}{{"), F.concat_ws(",", *labels), F.lit("} "), number)
    totals, weekly = usage_totals(events), usage_weekly(usage_daily(events))
    all_ = totals.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(F.lit(0).alias("section"), F.lit("").alias("place"), F.concat(F.lit(f"{prefix}_calls_total "), number).alias("line"))
    by_tool = totals.select(F.lit(1).alias("section"), F.col("tool").alias("place"), line("tool_calls_total", tool).alias("line"))
    by_week = weekly.groupBy("week").agg(F.sum("count").alias("count")).select(F.lit(2).alias("section"), F.col("week").cast("string").alias("place"), line("weekly_calls", week).alias("line"))
    both = weekly.select(F.lit(3).alias("section"), F.concat_ws("\n", F.col("week").cast("string"), "tool").alias("place"), line("weekly_tool_calls", week, tool).alias("line"))
    return all_.unionByName(by_tool).unionByName(by_week).unionByName(both)


# What the lines of each section are called, in order, with their kinds.
SECTIONS = (("calls_total", "counter"), ("tool_calls_total", "counter"), ("weekly_calls", "gauge"), ("weekly_tool_calls", "gauge"))


def render_metrics(events: DataFrame | None, prefix: str = "lexspark") -> str:
    """The lines as one text; without a log, that it is disabled; with one that can't be read, that too."""
    rows, enabled, failed = [], events is not None, False
    if events is not None:
        try:
            rows = metrics_lines(events, prefix).orderBy("section", "place").collect()
        except Exception:  # a scrape must not fail with the log
            failed = True
    lines = []
    for name, value in (("stats_enabled", enabled), ("stats_read_error", failed)):
        lines += [f"# TYPE {prefix}_{name} gauge", f"{prefix}_{name} {int(value)}"]
    for i, (name, kind) in enumerate(SECTIONS):
        own = [r["line"] for r in rows if r["section"] == i]
        lines += [f"# TYPE {prefix}_{name} {kind}", *(own or [f"{prefix}_{name} 0"] * (i == 0))]
    return "\n".join([*lines, "# EOF"]) + "\n"
