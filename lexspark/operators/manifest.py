"""Checks that a new manifest must pass before it replaces the stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Least number of rows, and least share of the rows there were.
LEAST_ROWS, LEAST_SHARE = 100, 0.90
ORIGIN = "alio"


class UnsafeUpdate(RuntimeError):
    """The update is refused and the stored data stays."""


def managed(manifest: DataFrame) -> DataFrame:
    """The rows that earlier updates brought in; others are never checked or removed."""
    return manifest.filter(F.col("origin") == ORIGIN)


def duplicate_names(new: DataFrame) -> DataFrame:
    return new.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def removed_names(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.select("name").distinct().join(new.select("name"), "name", "left_anti")


def common_names(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.select("name").intersect(new.select("name"))


def regressed_revisions(previous: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old_revision, new_revision) where a revision, as text, goes back."""
    old = previous.select("name", F.col("revision").alias("old_revision")).filter(F.col("old_revision") != "")
    now = new.select("name", F.col("revision").alias("new_revision")).filter(F.col("new_revision") != "")
    return old.join(now, "name").filter(F.col("new_revision") < F.col("old_revision"))


def least_count(previous: int) -> int:
    return max(LEAST_ROWS, int(previous * LEAST_SHARE)) if previous else LEAST_ROWS


def collection_gate(listed: DataFrame, resolved: DataFrame, previous: DataFrame) -> DataFrame:
    """One row (listed, resolved, previous, least, ok) of three counts."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((listed, "listed"), (resolved, "resolved"), (previous, "previous"))]
    row = counts[0].join(counts[1]).join(counts[2])
    least = F.when(F.col("previous") > 0, F.greatest(F.lit(LEAST_ROWS), F.floor(F.col("previous") * LEAST_SHARE))).otherwise(LEAST_ROWS).cast("long")
    return row.withColumn("least", least).withColumn("ok", (F.col("listed") >= F.col("least")) & (F.col("resolved") >= F.col("least")))


def validate_update(previous: DataFrame, new: DataFrame) -> None:
    """Raise UnsafeUpdate on duplicate names, names that vanish, or revisions that go back, in this order."""
    old = managed(previous)
    for found, what in ((duplicate_names(new), "duplicate names"), (removed_names(old, new), "names removed"), (regressed_revisions(old, new), "revisions going back")):
        some = [r[0] for r in found.orderBy("name").limit(6).collect()]
        if some:
            raise UnsafeUpdate(f"{what}: {', '.join(some[:5])}{' and more' if len(some) > 5 else ''}; the stored data stays")


def validate_collection(listed: DataFrame, resolved: DataFrame, previous: DataFrame) -> None:
    row = collection_gate(listed, resolved, managed(previous)).first()
    if not row["ok"]:
        raise UnsafeUpdate(f"{row['listed']} listed, {row['resolved']} resolved, at least {row['least']} wanted; the stored data stays")


def numbered_names(rows: DataFrame, name: str = "name", order: str = "position") -> DataFrame:
    """Adds ``file``: the name with .md, and " (n)" before it from the second time on, in the given order."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    tail = F.when(F.col("_n") == 0, ".md").otherwise(F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(").md")))
    return rows.withColumn("_n", nth).withColumn("file", F.concat(name, tail)).drop("_n")
