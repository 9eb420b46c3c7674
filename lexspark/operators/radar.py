"""Child documents whose parent was revised later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, revision_date, source_match
from ..sources.tables import written
from .names import contained

# Types of children and parents, endings of a child's name, how names are quoted.
CHILD_TYPES, PARENT_TYPES = ("시행세칙", "세칙", "지침"), ("규정", "정관")
CHILD_ENDING = " (?:시행세칙|세칙)$"
QUOTED = "「([^」]{2,40}?)」"


def documents(articles: DataFrame) -> DataFrame:
    """(source, category, revision, quoted): one row per source, as its first rows have it.

    ``quoted`` is the names that the first body quotes: article 1 of the main text, else any
    article 1, else the first row. Bodies are read where they are and not sent on.
    """
    one = (F.col("article_no") == 1) & (F.col("article_sub") == 0)
    rank = F.when(one & ~F.col("is_supplementary"), 0).when(one, 1).otherwise(2)
    names = F.regexp_extract_all("body", F.lit(QUOTED), F.lit(1))
    found = articles.groupBy("source").agg(F.min_by(F.struct("category", "revision"), "item_index").alias("_first"), F.min_by(names, F.struct(rank, "item_index")).alias("quoted"))
    return found.select("source", "_first.category", "_first.revision", "quoted")


def guess_parents(docs: DataFrame) -> DataFrame:
    """(source, category, revision, parent, parent_revision) of child documents; parent may be null.

    By name first: the child's without its ending. Else the names quoted in its first article,
    in their order: one that is a parent's, or that a parent's holds or is held by, the longest.
    """
    # each table that is read more than once is computed once
    docs = written(docs.filter(F.col("source").isNotNull() & F.col("category").isin(*CHILD_TYPES, *PARENT_TYPES)), "radar-documents")
    parents = docs.filter(F.col("category").isin(*PARENT_TYPES)).select(name_key(F.col("source")).alias("key"), F.struct(F.col("source").alias("parent"), "revision").alias("found"))
    # names with one key: the last in name order stands for all
    parents = written(parents.groupBy("key").agg(F.max("found").alias("found")), "radar-parents")
    stem = F.when(F.regexp_like("source", F.lit(CHILD_ENDING)), name_key(F.regexp_replace("source", CHILD_ENDING, "")))
    quotes = F.array_distinct(F.filter(F.transform("quoted", name_key), lambda q: q != ""))
    child = docs.filter(F.col("category").isin(*CHILD_TYPES)).select("source", "category", "revision", stem.alias("stem"), F.coalesce(quotes, F.array().cast("array<string>")).alias("quotes"))
    # only quoted names that are no parent's are looked for in parts of names
    unknown = written(child.select(F.explode("quotes").alias("q")).distinct().join(parents, F.col("q") == F.col("key"), "left_anti"), "radar-unknown")
    holds = contained(parents, "key", unknown, "q").unionByName(contained(unknown, "q", parents, "key")).select("key", "q")
    longest = F.min_by("found", F.struct(-F.length("found.parent"), "found.parent"))
    partial = written(holds.join(parents, "key").groupBy("q").agg(longest.alias("found")), "radar-partial")
    known = parents.select("key", "found", F.lit(True).alias("same")).unionByName(partial.select(F.col("q").alias("key"), "found", F.lit(False).alias("same")))
    one = lambda name, by_name: F.struct(name.alias("key"), F.lit(by_name).alias("by_name"))
    asked = F.concat(F.filter(F.array(one(F.col("stem"), True)), lambda x: x["key"].isNotNull()), F.transform("quotes", lambda q: one(q, False)))
    child = child.select("source", "category", "revision", asked.alias("asked"))
    n_asked = F.size("asked")

    def answered(rows: DataFrame) -> DataFrame:
        own = rows.select("source", "category", "revision", F.posexplode("asked").alias("place", "_a")).select("source", "category", "revision", "place", "_a.key", "_a.by_name")
        found = own.join(known, "key", "left")
        return found.select("source", "category", "revision", "place", F.when(F.col("same") | ~F.col("by_name"), F.col("found")).alias("found"))

    # a document that asks for one name only has its answer with it
    several = answered(child.filter(n_asked > 1)).groupBy("source", "category", "revision").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("place"))).alias("found"))
    nothing = child.filter(n_asked == 0).select("source", "category", "revision", F.lit(None).cast(parents.schema["found"].dataType).alias("found"))
    every = answered(child.filter(n_asked == 1)).drop("place").unionByName(several).unionByName(nothing)
    return every.select("source", "category", "revision", F.col("found.parent").alias("parent"), F.col("found.revision").alias("parent_revision"))


def compliance_radar(articles: DataFrame, source: str | None = None) -> DataFrame:
    """(source, type, revision, parent, parent_revision, status, months): review_needed, unknown, ok or no_parent, in that order.

    ``months`` is the gap, one at least, where review is needed. A source query matches the child or the parent.
    """
    rows = guess_parents(documents(articles)).withColumnRenamed("category", "type")
    c, p = revision_date(F.col("revision")), revision_date(F.col("parent_revision"))
    status = F.when(F.col("parent").isNull(), "no_parent").when(c.isNull() | p.isNull(), "unknown").when(p > c, "review_needed").otherwise("ok")
    gap = (p["y"] - c["y"]) * 12 + p["m"] - c["m"]
    rows = rows.withColumn("status", status).withColumn("months", F.when(F.col("status") == "review_needed", F.greatest(gap, F.lit(1))))
    if source:
        rows = rows.filter(source_match(source, F.col("source")) | F.coalesce(source_match(source, F.col("parent")), F.lit(False)))
    place = F.when(F.col("status") == "review_needed", 0).when(F.col("status") == "unknown", 1).when(F.col("status") == "ok", 2).otherwise(3)
    return rows.select("source", "type", "revision", "parent", "parent_revision", "status", "months").orderBy(place, "source")
