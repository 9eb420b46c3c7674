"""Exam questions by terms or id, with the article they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_of, excerpt, name_key, strip, tokenize

# Fixed value: how an explanation names its ground.
GROUND = r"(?U)근거:\s*([^제\n]+?)\s*(제\d+조(?:의\d+)?)"
ARTICLE_NUMBER = r"제(\d+)조(?:의(\d+))?"


def score_questions(questions: DataFrame, tokens: list[str]) -> DataFrame:
    """Adds ``score``: occurrences of all tokens in question, options and explanation."""
    blob = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.array_join(F.coalesce("options", F.array().cast("array<string>")), " "), F.coalesce("explanation", F.lit("")))
    return questions.withColumn("score", sum((count_of(blob, t) for t in tokens), F.lit(0)).cast("long"))


def find_questions(questions: DataFrame, articles: DataFrame, query: str | None = None, question_id: str | None = None, limit: int = 5) -> DataFrame:
    """The best ``limit`` questions (an id wins over a query), each with its ground's citation, title and excerpt.

    Ties keep the bank's order: by ``place`` where the table has it, else by id.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if question_id:
        found = questions.filter(F.col("id") == question_id).withColumn("score", F.lit(0).cast("long"))
    else:
        tokens = tokenize(query or "")
        if not tokens:
            return ground(questions.limit(0).withColumn("score", F.lit(0).cast("long")), articles)
        found = score_questions(questions, tokens).filter(F.col("score") > 0)
    return ground(found.orderBy(F.desc("score"), "place" if "place" in questions.columns else "id").limit(limit), articles)


def means(query: Column, name: Column) -> Column:
    """:func:`source_match` for a column of queries."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: F.length(w) >= 2)
    every = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(name, w))
    key = name_key(query)
    return F.contains(name, query) | every | ((key != "") & F.contains(name_key(name), key))


def ground(questions: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds (citation, article_title, body_excerpt) of the article that an explanation names.

    A source of exactly that name is the only one looked in, if there is one; else those that
    it means. Articles are met by their number, main text before supplementary.
    """
    has = F.regexp_like("explanation", F.lit(GROUND))
    name = F.when(has, strip(F.regexp_extract("explanation", GROUND, 1)))
    label = F.when(has, F.regexp_extract("explanation", GROUND, 2))
    number = lambda i: F.coalesce(F.regexp_extract("_label", ARTICLE_NUMBER, i).try_cast("int"), F.lit(0))
    asked = questions.withColumns({"_name": name, "_label": label}).withColumns({"article_no": number(1), "article_sub": number(2)})
    exact = articles.select(F.col("source").alias("_name"), F.lit(True).alias("_exact")).distinct()
    wanted = asked.filter("_label IS NOT NULL").select("id", "_name", "_label", "article_no", "article_sub").join(exact, "_name", "left")
    rows = articles.select(
        "source", "article_no", "article_sub", "article_title", excerpt(F.col("body"), 350, 200).alias("body_excerpt"), "item_index", "is_supplementary"
    )
    meant = F.when(F.col("_exact"), F.col("source") == F.col("_name")).otherwise(means(F.col("_name"), F.col("source")))
    near = wanted.join(rows, ["article_no", "article_sub"]).filter(meant)
    found = F.struct(F.concat_ws(" ", "source", "_label").alias("_cite"), "article_title", "body_excerpt")
    # an aggregate, so the many articles that a name may mean are brought down before the exchange
    near = near.groupBy("id").agg(F.min_by(found, F.struct("is_supplementary", "item_index")).alias("_near")).select("id", "_near.*")
    out = asked.drop("article_no", "article_sub").join(near, "id", "left")
    citation = F.coalesce("_cite", F.when(F.col("_label").isNotNull(), F.concat_ws(" ", "_name", "_label")))
    return out.withColumn("citation", citation).drop("_name", "_label", "_cite")
