"""Citations in free text checked against the article table."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_name, excerpt, title_matches
from ..sources.tables import written
from .lookup import article_ranges, range_text
from .names import contained

# The form of a citation, brackets that define rather than name, and the limits of a request.
CITATION = r"(?U)제(\d+)조(?:의(\d+))?(?:\s*제\d+항)?(?:\s*제\d+호)?(?:\s*\(([^)]{2,40})\))?"
DEFINITION = r"(?U)이하|약칭|['\"‘’“”]|(?:이)?라\s*(?:한다|칭한다)"
MOST_CHARACTERS, MOST_CITATIONS = 20_000, 200
SOURCE_WINDOW, SUPPLEMENT_WINDOW = 80, 15

#: Citations handed over at a time, however many a text has.
CITATIONS_A_BATCH = 1 << 15


def extract_citations(texts: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """(key, cite_no, raw, article_no, article_sub, cited_title, prefix) of every citation in order, with the text ahead of it.

    Each text is read once from its start to its end, and no row carries more of it than SOURCE_WINDOW
    characters. Null and empty texts cite nothing; a number beyond an int is null, which is no article's.
    """
    kind = texts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, cite_no int, raw string, article_no int, article_sub int, cited_title string, prefix string"
    pattern, window, most = CITATION.removeprefix("(?U)"), SOURCE_WINDOW, CITATIONS_A_BATCH

    def number(digits: str) -> int | None:
        return int(digits) if len(digits) < 19 and int(digits) < 1 << 31 else None

    def rows(key, body: str) -> Iterator[tuple]:
        for i, m in enumerate(re.finditer(pattern, body)):
            yield key, i, m[0], number(m[1]), number(m[2] or "0"), (m[3] or "").strip(), body[max(m.start() - window, 0) : m.start()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = [batch.schema.names[0], "cite_no", "raw", "article_no", "article_sub", "cited_title", "prefix"]
            keys, bodies = (c.to_pylist() for c in batch.columns)
            every = (row for k, body in zip(keys, bodies, strict=True) for row in rows(k, body))
            while some := list(itertools.islice(every, most)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    return texts.select(key, F.col(text).alias("_t")).filter("_t <> ''").mapInArrow(find, schema)


def nearest_source(citations: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``source``: of the known names in the prefix the one that starts last, the longer on a tie; null if there is none."""
    found = contained(citations, "prefix", sources, "source")
    best = found.groupBy("prefix").agg(F.max_by("source", F.struct("at", F.length("source"), "source")).alias("source"))
    return citations.join(best, "prefix", "left").select(*citations.columns, "source")


def verify_citations(texts: DataFrame, articles: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """One row per citation: (key, cite_no, citation, status, cited_title, article_title, title_verified, body_excerpt, message).

    status: ok, content_mismatch (another title), not_found (known source, no such article),
    unknown_source; and one row ``truncated`` where a text's limits cut it short. Texts are
    limited to MOST_CHARACTERS and MOST_CITATIONS, as a request is.
    """
    limited = texts.select(key, F.substring(text, 1, MOST_CHARACTERS).alias("_limited"), (F.length(text) > MOST_CHARACTERS).alias("_long"))
    # read for their names, for their articles and for the counts, but texts are searched once
    every = written(extract_citations(limited.select(key, "_limited"), key, "_limited"), "citations")
    cites = every.filter(F.col("cite_no") < MOST_CITATIONS)
    named = nearest_source(cites, articles.select("source").distinct(), [key, "cite_no"])
    prefers = F.contains(F.substring("prefix", -SUPPLEMENT_WINDOW, SUPPLEMENT_WINDOW), F.lit("부칙"))
    named = named.withColumn("_supplement", F.when(F.length("prefix") >= 2, prefers).otherwise(False))
    kept = articles.select("source", "article_no", "article_sub", "is_supplementary", "item_index", "article_title", excerpt(F.col("body"), 250, 150).alias("_excerpt"))
    # per key the first main and the first supplementary row, so a citation meets one row
    firsts = kept.groupBy("source", "article_no", "article_sub").agg(
        F.min_by(F.struct("article_title", "_excerpt"), F.struct("is_supplementary", "item_index")).alias("_main"),
        F.min_by(F.struct("article_title", "_excerpt"), F.struct(~F.col("is_supplementary"), "item_index")).alias("_suppl"),
    )
    joined = named.join(firsts, ["source", "article_no", "article_sub"], "left")
    hit = F.when(F.col("_supplement"), F.col("_suppl")).otherwise(F.col("_main"))
    checks = (F.col("cited_title") != "") & ~F.regexp_like("cited_title", F.lit(DEFINITION))
    name = article_name(F.col("article_no"), F.col("article_sub"))
    citation = F.concat_ws(" ", "source", F.coalesce(name, F.col("raw")))
    joined = joined.withColumns({"_hit": hit, "_checks": checks}).withColumn("_same", title_matches(F.col("cited_title"), F.col("_hit.article_title")))
    status = (
        F.when(F.col("source").isNull(), "unknown_source").when(F.col("_hit").isNull(), "not_found").when(F.col("_checks") & ~F.col("_same"), "content_mismatch").otherwise("ok")
    )
    joined = joined.withColumn("status", status)
    # only a source whose article is missing has its range told
    missing = joined.filter(F.col("status") == "not_found").select("source").distinct()
    joined = joined.join(article_ranges(articles, missing), "source", "left")
    when = lambda s, c: F.when(F.col("status") == s, c)
    rows = joined.select(
        key, "cite_no", F.when(F.col("source").isNull(), F.col("raw")).otherwise(citation).alias("citation"), "status",
        when("content_mismatch", F.col("cited_title")).alias("cited_title"), F.col("_hit.article_title").alias("article_title"),
        when("ok", F.col("_checks")).alias("title_verified"), when("ok", F.col("_hit._excerpt")).alias("body_excerpt"),
        when("not_found", F.concat(citation, F.lit(" 없음 (실재: "), range_text(F.col("first"), F.col("last"), F.col("n")), F.lit(")"))).alias("message"),
    )
    counts = every.groupBy(key).agg(F.count("*").alias("_n"))
    cut = limited.join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_long") | (F.col("_n") > MOST_CITATIONS))
    notes = cut.select(
        key, F.least("_n", F.lit(MOST_CITATIONS)).cast("int").alias("cite_no"), F.lit("truncated").alias("status"),
        F.concat(F.lit("verified "), F.least("_n", F.lit(MOST_CITATIONS)), F.lit(", skipped "), F.greatest(F.col("_n") - MOST_CITATIONS, F.lit(0))).alias("message"),
    )
    return rows.unionByName(notes, allowMissingColumns=True)


def lookup_by_key(citations: DataFrame, articles: DataFrame) -> DataFrame:
    """(source, article_no, article_sub) requests with their first article, or nulls: a left equi join.

    A key's first article is an aggregate, so a key that very many articles have is brought down before the exchange.
    """
    first = articles.groupBy("source", "article_no", "article_sub").agg(
        F.min_by(F.struct("item_index", "article_title"), F.struct("is_supplementary", "item_index")).alias("_first")
    )
    return citations.join(first, ["source", "article_no", "article_sub"], "left").select(*citations.columns, "_first.item_index", "_first.article_title")
