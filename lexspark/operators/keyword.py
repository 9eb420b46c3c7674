"""Keyword ranking: weighted substring counts over articles and attachments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of, find
from ..sources.tables import written

# Weights of a hit in a title and a chapter, and the rule for near hits.
TITLE_WEIGHT, CHAPTER_WEIGHT = 5.0, 2.0
FUZZY_LENGTH, FUZZY_SHARE, FUZZY_WEIGHT = 3, 0.5, 0.3
CANDIDATES = 50

#: Fields beside the body, and what a hit in them weighs.
ARTICLE_FIELDS, ATTACHMENT_FIELDS = [("article_title", TITLE_WEIGHT), ("chapter", CHAPTER_WEIGHT)], [("title", TITLE_WEIGHT)]


def document_frequencies(articles: DataFrame, tokens: list[str]) -> tuple[int, dict[str, int]]:
    """(articles, for each token how many hold it in body, title or chapter): one aggregate, one row to the driver."""
    held = [F.sum((F.contains("body", F.lit(t)) | F.contains("article_title", F.lit(t)) | F.contains("chapter", F.lit(t))).cast("long")) for t in tokens]
    row = articles.agg(F.count("*"), *[F.coalesce(h, F.lit(0)).alias(f"t{i}") for i, h in enumerate(held)]).first()
    return row[0], dict(zip(tokens, row[1:], strict=True))


def idf_table(articles: DataFrame, tokens: list[str]) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 1)) + 1 over all articles."""
    sums = [F.sum((F.contains("body", F.lit(t)) | F.contains("article_title", F.lit(t)) | F.contains("chapter", F.lit(t))).cast("long")).alias(f"t{i}") for i, t in enumerate(tokens)]
    one = articles.agg(F.count("*").alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("df")) for i, t in enumerate(tokens)])
    return one.select("n", F.inline(rows)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def hit_table(rows: DataFrame, tokens: list[str], fields: list[str], fuzzy: bool = False, keep: tuple[str, ...] = ("item_index",), each: bool = False) -> DataFrame:
    """``keep``, and for token i ``_n{i}`` (its hits in the body), ``_e{i}`` (whether one is exact), ``_f{i}_{field}``; ``_position``. With ``each``, also ``_p{i}``, where it is first.

    Places come first, as columns of their own that later ones refer to, so a token is looked for
    once in a body and counted only where it is, and the plan grows in proportion to the tokens.
    The position folds the tokens in their order: an exact hit moves it forward in the text, a
    near one counts only if nothing was found before. That is the least of the first token's
    place that has any and of all exact places. A null body is empty.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    near = {i: [t[k : k + 2] for k in range(len(t) - 1)] for i, t in enumerate(tokens) if fuzzy and len(t) >= FUZZY_LENGTH}
    places = {f"_at{i}": find(body, t) for i, t in enumerate(tokens)}
    places |= {f"_at{i}_{k}": F.when(F.contains(body, F.lit(tokens[i])), -1).otherwise(find(body, p)) for i, pairs in near.items() for k, p in enumerate(pairs)}
    found = rows.select(*keep, body.alias("_body"), *fields, *[c.alias(n) for n, c in places.items()])
    hits, first, exact = [], [], []
    for i, token in enumerate(tokens):
        at = F.col(f"_at{i}")
        exact.append(F.when(at >= 0, at))
        first.append(exact[-1])
        hit = F.when(at >= 0, count_of(F.col("_body"), token).cast("double")).otherwise(0.0)
        if i in near:
            pairs = near[i]
            seen = [F.col(f"_at{i}_{k}") >= 0 for k in range(len(pairs))]
            enough = sum((x.cast("int") for x in seen), F.lit(0)) >= FUZZY_SHARE * len(pairs)
            counts = sum((F.when(x, count_of(F.col("_body"), p)).otherwise(0) for x, p in zip(seen, pairs, strict=True)), F.lit(0))
            hit = F.when(enough, counts / F.lit(len(pairs)) * FUZZY_WEIGHT).otherwise(hit)
            first += [F.when(enough & x, F.col(f"_at{i}_{k}")) for k, x in enumerate(seen)]
        hits += [hit.alias(f"_n{i}"), (at >= 0).alias(f"_e{i}"), *(F.coalesce(F.contains(f, F.lit(token)), F.lit(False)).alias(f"_f{i}_{f}") for f in fields)]
    position = F.coalesce(F.least(F.coalesce(*first), *exact), F.lit(-1)) if tokens else F.lit(-1)
    own = [F.col(f"_at{i}").alias(f"_p{i}") for i in range(len(tokens))] if each else []
    return found.select(*keep, position.alias("_position"), *hits, *own)


def score_of(weights: list[Column], fields: list[tuple[str, float]]) -> Column:
    """The score of a row of :func:`hit_table`, added up in the order of the tokens, for a weight a token."""
    score = F.lit(0.0)
    for i, w in enumerate(weights):
        for field, factor in fields:
            score = score + F.when(F.col(f"_f{i}_{field}"), factor * w).otherwise(0.0)
        score = score + F.col(f"_n{i}") * w
    return score


def _scored(rows: DataFrame, tokens: list[str], weights: dict[str, float], fields: list[tuple[str, float]], fuzzy: bool) -> DataFrame:
    """(item_index, score, position): the weighted hits of every row, and where the first one is."""
    found = hit_table(rows, tokens, [f for f, _ in fields], fuzzy)
    return found.select("item_index", score_of([F.lit(float(weights.get(t, 1.0))) for t in tokens], fields).alias("score"), F.col("_position").alias("position"))


def score_articles(articles: DataFrame, tokens: list[str], weights: dict[str, float], fuzzy: bool = False) -> DataFrame:
    """(item_index, score, position) of every article; tokens count in their order."""
    return _scored(articles, tokens, weights, ARTICLE_FIELDS, fuzzy)


def score_attachments(attachments: DataFrame, tokens: list[str], weights: dict[str, float]) -> DataFrame:
    return _scored(attachments, tokens, weights, ATTACHMENT_FIELDS, False)


def weights_of(articles: DataFrame, tokens: list[str]) -> dict[str, float]:
    """Inverse document frequencies on the driver: a number for each token of a query."""
    n, df = document_frequencies(articles, tokens)
    return {t: math.log((n + 1) / (df[t] + 1)) + 1.0 for t in tokens}


def keyword_ranking(articles: DataFrame, attachments: DataFrame | None, tokens: list[str], weights: dict[str, float], limit: int = CANDIDATES, fuzzy: bool = False) -> DataFrame:
    """(kind, item_index, score, position): the best ``limit`` with a score, ties by kind and index.

    The tables are the allowed rows; weights come from all articles. Ordering and limit
    are one TakeOrdered, so only ``limit`` rows of each task leave it.
    """
    found = score_articles(articles, tokens, weights, fuzzy).select(F.lit("article").alias("kind"), "*")
    if attachments is not None:
        found = found.unionByName(score_attachments(attachments, tokens, weights).select(F.lit("attachment").alias("kind"), "*"))
    # the filter stays above the limit: below it, it would compute every score again
    return found.orderBy(F.desc("score"), "kind", "item_index").limit(limit).filter(F.col("score") > 0)


def keyword_rankings(articles: DataFrame, queries: Sequence[Sequence[str]], limit: int = CANDIDATES) -> DataFrame:
    """(query, item_index, score, position, rank): for each list of tokens, numbered from 0, its best ``limit`` articles.

    The bodies are read once for all queries: hits of the distinct tokens are written beside the keys,
    weights are sums over them, and each query's score adds up its own tokens' columns. A query's
    ranks are cut off within each task before they meet. Ties go by index; only rows with a score count.
    """
    tokens = list(dict.fromkeys(t for q in queries for t in q))
    place = {t: i for i, t in enumerate(tokens)}
    fields = [f for f, _ in ARTICLE_FIELDS]
    hits = written(hit_table(articles, tokens, fields, False, ("item_index",), each=True), "hits")
    held = [F.col(f"_e{i}") | F.col(f"_f{i}_article_title") | F.col(f"_f{i}_chapter") for i in range(len(tokens))]
    row = hits.agg(F.count("*"), *[F.coalesce(F.sum(h.cast("long")), F.lit(0)) for h in held]).first()
    weights = [F.lit(math.log((row[0] + 1) / (d + 1)) + 1.0) for d in row[1:]]
    each = []
    for number, own in enumerate(queries):
        score, places = F.lit(0.0), [F.col(f"_p{place[t]}") for t in own]
        for t in own:
            i = place[t]
            for field, factor in ARTICLE_FIELDS:
                score = score + F.when(F.col(f"_f{i}_{field}"), factor * weights[i]).otherwise(0.0)
            score = score + F.col(f"_n{i}") * weights[i]
        first = F.array_min(F.filter(F.array(*places), lambda p: p >= 0)) if places else F.lit(None)
        each.append(F.struct(F.lit(number).alias("query"), score.alias("score"), F.coalesce(first, F.lit(-1)).cast("int").alias("position")))
    if not each:
        return articles.sparkSession.createDataFrame([], "query int, item_index long, score double, position int, rank int")
    scored = hits.select("item_index", F.inline(F.array(*each))).filter(F.col("score") > 0)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item_index")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limit, 0))
    return ranked.select("query", "item_index", "score", "position", "rank")
