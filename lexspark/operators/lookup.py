"""Exact lookups and listings over the article and attachment tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_name, excerpt, nfc, number_key, parse_article_token, source_match
from .names import contained


def select_source(rows: DataFrame, query: str | None) -> DataFrame:
    """The rows whose source is exactly the query, or, if there is none, those that :func:`source_match` takes.

    The test for an exact one is an aggregate of one row that is joined back, so both
    branches are one plan.
    """
    q = nfc(query or "").strip()
    if not q:
        return rows
    exact = rows.agg(F.coalesce(F.max(F.col("source") == q), F.lit(False)).alias("_exact"))
    both = rows.join(F.broadcast(exact))
    return both.filter(F.when(F.col("_exact"), F.col("source") == q).otherwise(source_match(q, F.col("source")))).drop("_exact")


def prefer_main(rows: DataFrame) -> DataFrame:
    """The main-text rows if there are any, else all."""
    least = rows.agg(F.min("is_supplementary").alias("_least"))
    return rows.join(F.broadcast(least)).filter(F.col("is_supplementary") == F.col("_least")).drop("_least")


def get_article(articles: DataFrame, source: str, article: str) -> DataFrame:
    parsed = parse_article_token(article)
    if parsed is None:
        return articles.limit(0)
    no, sub = parsed
    # the exact-source test looks at all rows, so the number filter comes after it
    found = select_source(articles, source).filter((F.col("article_no") == no) & (F.col("article_sub") == sub))
    return prefer_main(found)


def with_citation(rows: DataFrame, label: str = "article") -> DataFrame:
    return rows.withColumn("citation", F.concat_ws(" ", "source", label))


def list_sources(articles: DataFrame, category: str | None = None) -> DataFrame:
    """(category, source, revision, articles): a source's first category and revision, and its number of articles."""
    rows = articles.filter(F.col("category") == category) if category else articles
    out = rows.groupBy("source").agg(F.min_by("category", "item_index").alias("category"), F.min_by("revision", "item_index").alias("revision"), F.count("*").alias("articles"))
    return out.select("category", "source", "revision", "articles").orderBy("category", "source")


def list_attachments(attachments: DataFrame, source: str | None = None, category: str | None = None, kind: str | None = None, include_deleted: bool = False) -> DataFrame:
    rows = attachments
    if category:
        rows = rows.filter(F.col("category") == category)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if not include_deleted:
        rows = rows.filter(~F.col("deleted"))
    rows = with_citation(rows.filter(source_match(source, F.col("source"))), "label")
    return rows.select("category", "source", "kind", "label", "title", "deleted", "citation", excerpt(F.col("body"), 200, 150).alias("body_excerpt")).orderBy("source", "kind", "label")


def get_attachment(attachments: DataFrame, source: str, label: str) -> DataFrame:
    """The attachments of a label such as "[별표 1]" or "별지 제3호 서식": kind, if named, and exact number."""
    m = re.match(r"\s*(별표|별지)?\s*(.*)$", re.sub(r"[\[\]]", "", nfc(label)).strip(), re.S)
    kind, number = m[1], re.sub(r"\s+", "", m[2]).replace("서식", "")
    if not number:
        return attachments.limit(0)
    rows = select_source(attachments, source)
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    return with_citation(rows.filter(number_key(F.col("number")) == number), "label")


def article_ranges(articles: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(source, first, last, n) of each source, or of the sources in ``names``, over the rows of every source whose name holds it.

    That a parent's range takes in its children's articles is how ranges have been
    reported; names are compared with names, and meet the distinct numbers by equality.
    """
    numbers = articles.select("source", F.struct("article_no", "article_sub").alias("x")).distinct()
    asked = (articles if names is None else names).select(F.col("source").alias("name")).distinct()
    holders = contained(articles.select("source").distinct(), "source", asked, "name")
    held = numbers.join(holders, "source").select("name", "x").distinct()
    out = held.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    label = lambda c: article_name(F.col(f"{c}.article_no"), F.col(f"{c}.article_sub"))
    return out.select(F.col("name").alias("source"), label("lo").alias("first"), label("hi").alias("last"), "n")


def range_text(first: Column, last: Column, n: Column) -> Column:
    return F.concat(first, F.lit(" ~ "), last, F.lit(", 총 "), n.cast("string"), F.lit("개"))


def first_by_key(articles: DataFrame) -> DataFrame:
    """Each (source, number, branch)'s first row, main text before supplementary."""
    order = Window.partitionBy("source", "article_no", "article_sub").orderBy("is_supplementary", "item_index")
    return articles.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
