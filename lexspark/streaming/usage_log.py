"""The log of usage events: single calls written to it without a Spark job, compaction, and what has been counted.

Calls are held in memory and go to the log as one small Parquet file of several, with the language of
a text but not the text. Compaction puts the files of many writers into the next version of the log's
table and says so in its pointer, so a reader counts every call once, whether the small files
are deleted already or not. The stream in :mod:`.usage_totals` keeps totals of the log.
"""

from __future__ import annotations

import atexit
import datetime
import io
import threading
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import python_script_label
from ..operators import usage
from ..schemas import USAGE_EVENT
from ..sources.tables import current, publish, read_pointer

EMPTY = {"total": 0, "tools": [], "by_language": [], "daily": []}
EVENT = pa.schema([("ts", pa.timestamp("us", "UTC")), ("tool", pa.string()), ("lang", pa.string())])


def _pending(spark: SparkSession, log: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/pending")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class UsageWriter:
    """Adds calls to a log: :meth:`add` costs no job and no file until ``most`` calls or ``seconds`` have passed.

    What is held is written by :meth:`flush` and when the process ends; a process that is killed loses at most that.
    """

    def __init__(self, spark: SparkSession, log: str, most: int = 1000, seconds: float = 10.0):
        self.spark, self.log, self.most, self.seconds = spark, log, most, seconds
        self.held: list[tuple[datetime.datetime, str, str | None]] = []
        self.lock = threading.Lock()
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        try:
            self.flush()
        except Exception:  # the session may be gone
            self.held.clear()

    def add(self, tool: str, text: str | None = None, now: datetime.datetime | None = None) -> None:
        at = now or datetime.datetime.now(datetime.UTC)
        at = at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
        with self.lock:
            self.held.append((at, tool, python_script_label(text)))
            full = len(self.held) >= self.most or (at - self.held[0][0]).total_seconds() >= self.seconds
        if full:
            self.flush()

    def flush(self) -> None:
        """Write what is held as one file: under another name first, so that readers never see a part of it."""
        with self.lock:
            rows, self.held = self.held, []
        if not rows:
            return
        body = io.BytesIO()
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), EVENT, strict=True)], schema=EVENT), body)
        fs, folder = _pending(self.spark, self.log)
        name = uuid.uuid4().hex
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        try:
            out = fs.create(path(folder, f"_{name}"), False)
            try:
                out.write(bytearray(body.getvalue()))
            finally:
                out.close()
            if not fs.rename(path(folder, f"_{name}"), path(folder, f"{name}.parquet")):
                raise OSError(f"can't write to {self.log}")
        except BaseException:
            with self.lock:
                self.held = rows + self.held
            raise


def record(spark: SparkSession, log: str | None, tool: str, text: str | None = None, now: datetime.datetime | None = None) -> bool:
    """Add one call to the log at once; whether it was. Without a log nothing is done, and a failure never reaches the caller."""
    if not log:
        return False
    writer = UsageWriter(spark, log, most=1)
    try:
        writer.add(tool, text, now)
    except Exception:  # counting is an extra: it must not break what is counted
        return False
    finally:
        atexit.unregister(writer._at_exit)
    return True


def _pending_files(spark: SparkSession, log: str) -> list[str]:
    fs, folder = _pending(spark, log)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n for n in names if n.endswith(".parquet") and not n.startswith("_"))


def _events(spark: SparkSession, log: str, files: list[str]) -> DataFrame:
    """The compacted calls and those of pending files that the compacted ones don't hold."""
    said = read_pointer(spark, log)
    rows = spark.read.schema(USAGE_EVENT).parquet(f"{current(spark, log)}/events") if said else spark.createDataFrame([], USAGE_EVENT)
    fresh = [f"{log}/pending/{n}" for n in files if not said or n not in set(said["compacted"])]
    return rows.unionByName(spark.read.schema(USAGE_EVENT).parquet(*fresh)) if fresh else rows


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """(ts, tool, lang) of every call; FileNotFoundError if nothing has been written."""
    files = _pending_files(spark, log)
    if not files and read_pointer(spark, log) is None:
        raise FileNotFoundError(f"no log under {log}")
    return _events(spark, log, files)


def compact(spark: SparkSession, log: str, partitions: int = 1) -> int:
    """Put all pending files into the next version of the log's table; how many. Only one may run at a time.

    Files are deleted after the pointer names them as held; if that is cut off, readers pass them over
    and the next compaction deletes them.
    """
    files = _pending_files(spark, log)
    said = read_pointer(spark, log)
    done = set(said["compacted"]) if said else set()
    new = [n for n in files if n not in done]
    if new:
        rows = _events(spark, log, files)
        publish(spark, log, lambda folder: rows.coalesce(partitions).write.parquet(f"{folder}/events"), compacted=files)
    fs, folder = _pending(spark, log)
    for name in files:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), False)
    return len(new)


def snapshot(spark: SparkSession, log: str | None) -> dict:
    """enabled, total, tools, by_language and daily of the log: a row for each tool, language and day; ``error`` if it can't be read."""
    if not log:
        return {"enabled": False} | EMPTY
    try:
        events = read_log(spark, log)
        tools, langs = ([r.asDict() for r in usage.usage_totals(events, key).collect()] for key in ("tool", "lang"))
        daily = [r.asDict() | {"day": str(r.day)} for r in usage.daily_breakdown(events).collect()]
    except Exception as e:  # the shape stays, whatever the log's state
        return {"enabled": True} | EMPTY | {"error": str(e)}
    return {"enabled": True, "total": sum(t["count"] for t in tools), "tools": tools, "by_language": langs, "daily": daily}


def week(spark: SparkSession, log: str | None, today: datetime.date | None = None) -> dict:
    """The counts of the week, Monday to Sunday of UTC+9, that holds ``today``."""
    today = today or (datetime.datetime.now(datetime.UTC) + datetime.timedelta(hours=usage.OFFSET_HOURS)).date()
    monday = today - datetime.timedelta(days=today.weekday())
    span = {"mode": "week", "week_start": monday.isoformat(), "week_end": (monday + datetime.timedelta(days=6)).isoformat()}
    if not log:
        return span | {"total": 0, "tools": {}, "by_language": {}}
    events = read_log(spark, log)
    of = lambda key: {r[0]: r[1] for r in usage.week_view(usage.usage_daily(events, key), F.lit(today), key).collect()}
    tools = of("tool")
    return span | {"total": sum(tools.values()), "tools": tools, "by_language": of("lang")}


def backfill(spark: SparkSession, totals: DataFrame, daily: DataFrame, key: str = "tool") -> tuple[DataFrame, int]:
    """(daily counts with totals of older times put on the day last seen, rows that were added); doing it again adds none."""
    out = usage.backfill_missing_days(daily, totals, key)
    return out, out.count() - daily.count()
