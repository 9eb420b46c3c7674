"""An update of the corpus from landed files: resolve, normalise, check, swap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename
from ..operators.headings import normalize_headings
from ..operators.manifest import ORIGIN, managed, numbered_names, validate_collection, validate_update
from .corpus import swap_in


def staged_documents(resolved: DataFrame, converted: DataFrame) -> DataFrame:
    """(name, type, file, revision, file_no, origin, text): resolved items that have a converted text, normalised and named.

    ``converted`` is (file_no, markdown); items without a text, or with an empty one, are left out.
    """
    have = converted.filter(F.length("markdown") > 0)
    rows = resolved.join(have, "file_no").withColumn("base", F.concat_ws("_", "type", safe_filename(F.col("title"))))
    named = numbered_names(rows, "base", "idx")
    return named.select(
        F.col("title").alias("name"), "type", "file", "revision", "file_no", F.lit(ORIGIN).alias("origin"),
        normalize_headings(F.col("markdown"), F.col("title"), F.col("revision")).alias("text"),
    )


def kept_documents(previous: DataFrame, staged: DataFrame) -> DataFrame:
    """The stored documents that no update brought in; they stay beside the new ones."""
    own = previous.filter(~F.col("origin").eqNullSafe(F.lit(ORIGIN)))
    return own.select(*[F.col(c) if c in own.columns else F.lit(None).cast("string").alias(c) for c in staged.columns])


def as_files(documents: DataFrame) -> DataFrame:
    """(category, file, stem, text), as the parser takes them."""
    stem = F.regexp_replace("file", r"\.md$", "")
    return documents.select(F.substring_index(stem, "_", 1).alias("category"), "file", stem.alias("stem"), "text")


def sync(spark: SparkSession, listed: DataFrame, resolved: DataFrame, converted: DataFrame, previous: DataFrame, path: str) -> None:
    """Replace the documents at ``path``, if the collection is complete and the new manifest safe.

    Only documents that earlier updates brought in are replaced. The new table is written beside
    the old one and checked there; a refusal leaves the old one as it was.
    """
    validate_collection(listed, resolved, previous)
    new = staged_documents(resolved, converted)
    staged = new.unionByName(kept_documents(previous, new))

    def check(written: DataFrame) -> None:
        validate_collection(listed, managed(written), previous)
        validate_update(previous, written)

    swap_in(staged, path, check)
