"""Overlapping text chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 400, 80


def chunk_text(df: DataFrame, text: str = "body", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Adds (chunk_no, start, end, chunk): windows of ``size`` characters, ``size - overlap`` apart, the tail included.

    An empty or null text is one empty chunk. The number of windows is known from the length, so
    this is one generator and no shuffle.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap from 0 to below size")
    step = size - overlap
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.lit(1), F.ceil((F.length(body) - overlap) / F.lit(step))).cast("int")
    numbered = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk_no") * step
    end = F.least(start + size, F.length(body))
    return numbered.withColumns({"start": start, "end": end, "chunk": F.substring(body, start + 1, F.lit(size))})


def item_chunks(articles: DataFrame, attachments: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(kind, item_index, chunk_no, start, end, text) of both tables, each text under its item's header; deleted attachments left out."""

    def of(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
        header = F.concat_ws(" · ", *[F.nullif(F.col(f), F.lit("")) for f in fields])
        cut = chunk_text(df.withColumn("_header", header), "body", size, overlap)
        return cut.select(F.lit(kind).alias("kind"), "item_index", "chunk_no", "start", "end", F.concat("_header", F.lit("\n"), "chunk").alias("text"))

    return of(articles, "article", ["source", "chapter", "article", "article_title"]).unionByName(
        of(attachments.filter(~F.col("deleted")), "attachment", ["source", "kind", "label", "title"])
    )
