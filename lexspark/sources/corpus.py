"""The corpus: Markdown files in, article and attachment tables out and back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import nfc
from ..operators.segment import numbered, parse_regulations
from ..schemas import ARTICLE, ATTACHMENT, MANIFEST, QUESTION
from .tables import current, publish, read_pointer, written

# Files that put the others of a category together.
AGGREGATES = ("law.md", "hr.md", "project.md", "volunteer.md", "partnership.md", "finance.md", "management.md")


def read_markdown(spark: SparkSession, folder: str, skip: tuple[str, ...] = AGGREGATES) -> DataFrame:
    """(category, file, stem, text) of the ``*.md`` files but those named in ``skip``; category is the name up to the first "_".

    Files that put others together are skipped by default: their articles would be found twice.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(nfc(F.col("value")).alias("text"), nfc(F.col("_metadata.file_name")).alias("file"))
    raw = raw.withColumn("file", F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))))
    stem = F.regexp_replace("file", r"\.md$", "")
    return raw.filter(~F.col("file").isin(*skip)).select(F.substring_index(stem, "_", 1).alias("category"), "file", stem.alias("stem"), "text")


def build_index(spark: SparkSession, folder: str, index: str, skip: tuple[str, ...] = AGGREGATES) -> None:
    """Parse all files and make both tables the index's next version, without vectors."""
    build_from(spark, read_markdown(spark, folder, skip), index)


def build_from(spark: SparkSession, files: DataFrame, index: str) -> None:
    """:func:`build_index` of a table (category, file, stem, text).

    A version is a folder of its own that is never changed, and the pointer moves to it only
    once both tables stand there: if a step fails, readers go on with the version before, vectors
    included. The parsed rows are written once, since numbering them reads them several times.
    """
    articles, attachments = (written(t, "parsed") for t in parse_regulations(files))
    publish(spark, index, lambda folder: write_index(numbered(articles), numbered(attachments), folder))


def index_folder(spark: SparkSession, index: str) -> str:
    """Where the index's tables are: the current version, or ``index`` itself if it has none."""
    return current(spark, index) if read_pointer(spark, index) else index


def write_index(articles: DataFrame, attachments: DataFrame, folder: str) -> None:
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    articles.select(*names(ARTICLE)).write.mode("overwrite").parquet(f"{folder}/articles")
    attachments.select(*names(ATTACHMENT)).write.mode("overwrite").parquet(f"{folder}/attachments")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """A small dictionary as a JSON table of one line."""
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    """What :func:`write_meta` wrote; empty if it is missing or broken."""
    try:
        return json.loads(spark.read.text(path).first()["value"]) if exists(spark, path) else {}
    except (ValueError, TypeError):
        return {}


def read_index(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame]:
    """(articles, attachments); FileNotFoundError before the index is built."""
    folder = index_folder(spark, index)
    if not exists(spark, f"{folder}/articles"):
        raise FileNotFoundError(f"no index under {index}; build it first")
    return spark.read.schema(ARTICLE).parquet(f"{folder}/articles"), spark.read.schema(ATTACHMENT).parquet(f"{folder}/attachments")


def read_json_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of a JSON index: an object of two lists, or a bare list of articles. Places in the lists become item_index."""
    return json_tables(spark.read.text(path, wholetext=True))


def json_tables(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`read_json_index` of a table of one row, ``value``."""
    whole = F.from_json("value", f"struct<articles: array<struct<{_fields(ARTICLE)}>>, attachments: array<struct<{_fields(ATTACHMENT)}>>>")
    bare = F.from_json("value", f"array<struct<{_fields(ARTICLE)}>>")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    lists = text.select(F.when(is_list, bare).otherwise(whole["articles"]).alias("articles"), F.when(~is_list, whole["attachments"]).alias("attachments"))

    def table(name: str, schema: str) -> DataFrame:
        rows = lists.select(F.posexplode(name).alias("item_index", "r"))
        return rows.select(F.col("item_index").cast("long").alias("item_index"), *[F.col(f"r.{n}") for n in _names(schema)])

    return table("articles", ARTICLE), table("attachments", ATTACHMENT)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ") if c.split()[0] != "item_index"]


def _fields(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", ") if c.split()[0] != "item_index")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a JSON list in NFC, with ``place``, their place in it."""
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in QUESTION.split(", "))
    text = spark.read.text(path, wholetext=True).select(nfc(F.col("value")).alias("value"))
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("place", "r")).select("r.*", F.col("place").cast("long").alias("place"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ``sources`` of a manifest file; an empty table if it is missing or broken."""
    empty = spark.createDataFrame([], MANIFEST)
    if not exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True)
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in MANIFEST.split(", "))
    return text.select(F.inline(F.from_json("value", f"struct<sources: array<struct<{fields}>>>")["sources"]))


def swap_in(rows: DataFrame, path: str, check) -> None:
    """Write a table beside ``path``, run ``check(staged)``, and only then put it in the old one's place.

    The old table goes only once the new one is in place; if a step fails, the old one is put back.
    """
    spark = rows.sparkSession
    live, staged, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.old"))
    fs = live.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(live):  # an earlier swap was cut off
        _rename(fs, old, live)
    rows.write.mode("overwrite").parquet(f"{path}.staged")
    check(spark.read.parquet(f"{path}.staged"))
    if fs.exists(live):
        fs.delete(old, True)
        _rename(fs, live, old)
    try:
        _rename(fs, staged, live)
    except OSError:
        if fs.exists(old):
            _rename(fs, old, live)
        raise
    fs.delete(old, True)


def _rename(fs, source, target) -> None:
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"can't move {source} to {target}")
