"""Dense ranking: exact dot products, best chunk of each item."""

from __future__ import annotations

import errno
import hashlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Layout of the stored vectors, and what the encoder without a model is called.
VERSION, HASHED = 1, "hashed-trigrams-64"


class SemanticUnavailable(RuntimeError):
    """Dense search can't be used safely."""


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Dot product with a query vector, in double precision, left to right; for vectors that stay columns."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, literal, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)


#: Vectors of a block that is multiplied with the queries at once; blocks times queries are the numbers held.
BLOCK_CELLS = 1 << 22


def vector_matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold ``dimension`` finite numbers, those as doubles)."""
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False), nan=-1)
    rows = np.flatnonzero(sizes == dimension)
    values = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    finite = np.isfinite(values).all(axis=1)  # a null has become NaN
    return rows[finite], values[finite]


SCORED = "query int, kind string, item_index long, chunk_no int, start int, end int, score double"
SCORED_ARROW = pa.schema([("query", pa.int32()), ("kind", pa.string()), ("item_index", pa.int64()), ("chunk_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def block_scores(chunks: DataFrame, queries: Sequence[Sequence[float]], limit: int | None, vector: str = "embedding") -> DataFrame:
    """SCORED: dot products of blocks of vectors with all queries, as matrix products in double precision.

    With a ``limit`` a task gives out, for each query, its best ``limit`` items by their best chunk (ties
    by kind, item and chunk); without, every chunk. Vectors never leave their task. Rows whose vector is
    null, has a component that is null or not finite, or another size than the queries are left out.
    """
    asked = np.array([list(q) for q in queries], np.float64).reshape(len(queries), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_CELLS // max(1, len(asked)))
        held: list[pd.DataFrame] = []

        def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts).sort_values(["query", "score", "kind", "item_index", "chunk_no"], ascending=[True, False, True, True, True], kind="stable")
            return rows.drop_duplicates(["query", "kind", "item_index"]).groupby("query", sort=False).head(limit)

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows, vectors = vector_matrix(part.column(5), asked.shape[1])
                if not len(rows):
                    continue
                scores = vectors @ asked.T
                if limit is None:
                    some = np.tile(np.arange(len(rows)), len(asked))
                    query = np.repeat(np.arange(len(asked)), len(rows))
                elif limit <= 0:
                    continue
                else:
                    # an item has few chunks in a block: those that can be among the best items are above its limit-th best item
                    item = pd.factorize(pd.MultiIndex.from_arrays([np.asarray(part.column(0).take(pa.array(rows)).to_pylist(), object), part.column(1).take(pa.array(rows)).to_numpy()]))[0]
                    some, query = [], []
                    for q in range(len(asked)):
                        top = np.full(item.max() + 1, -np.inf)
                        np.maximum.at(top, item, scores[:, q])
                        least = np.partition(top, -limit)[-limit] if len(top) > limit else -np.inf
                        found = np.flatnonzero((scores[:, q] >= least) & (scores[:, q] == top[item]))
                        some.append(found)
                        query.append(np.full(len(found), q))
                    some, query = np.concatenate(some), np.concatenate(query)
                at = rows[some]
                columns = [part.column(i).take(pa.array(at)) for i in range(5)]
                out = pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), *columns, pa.array(scores[some, query])], schema=SCORED_ARROW)
                if limit is None:
                    yield out
                else:
                    held = [best([*held, out.to_pandas()])]
        for rows in held:
            yield pa.RecordBatch.from_pandas(rows, schema=SCORED_ARROW, preserve_index=False)

    few = chunks.select("kind", F.col("item_index").cast("long"), F.col("chunk_no").cast("int"), F.col("start").cast("int"), F.col("end").cast("int"), vector)
    return few.mapInArrow(run, SCORED)


def dense_rankings(chunks: DataFrame, queries: Sequence[Sequence[float]], limit: int = 50, vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(query, kind, item_index, score, chunk_no, start, end, rank): for each query, numbered from 0, its best ``limit`` items.

    One pass over the vectors for all queries. Each task hands up ``limit`` rows a query; with
    ``allowed`` (kind, item_index) it hands up keys and scores of all chunks, and only those are joined.
    """
    scored = block_scores(chunks, queries, limit if allowed is None else None, vector)
    if allowed is not None:
        scored = allowed_chunks(scored, allowed)
    best = F.max(F.struct("score", (-F.col("chunk_no")).alias("r"), "start", "end")).alias("b")
    items = scored.groupBy("query", "kind", "item_index").agg(best).select("query", "kind", "item_index", "b.score", (-F.col("b.r")).alias("chunk_no"), "b.start", "b.end")
    return best_of_each(items, limit)


def best_of_each(scored: DataFrame, limit: int) -> DataFrame:
    """Adds ``rank`` by (score, kind, item_index) to the best ``limit`` rows of each ``query``; Spark cuts the ranks off before the exchange too."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "kind", "item_index")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limit, 0))


def allowed_chunks(chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """The chunks whose (kind, item_index) is allowed."""
    return chunks.join(allowed.select("kind", "item_index").distinct(), ["kind", "item_index"], "left_semi")


def best_chunks(scored: DataFrame) -> DataFrame:
    """Of each (kind, item_index) the chunk with the best score, the first on a tie. Partial maxima before the shuffle."""
    best = F.max(F.struct("score", (-F.col("chunk_no")).alias("r"), "start", "end")).alias("b")
    return scored.groupBy("kind", "item_index").agg(best).select("kind", "item_index", "b.score", (-F.col("b.r")).alias("chunk_no"), "b.start", "b.end")


def dense_ranking(chunks: DataFrame, query: Sequence[float], limit: int = 50, vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(kind, item_index, score, chunk_no, start, end) of the best ``limit`` items, of those ``allowed``; ``limit`` <= 0 gives none."""
    scored = block_scores(chunks, [query], limit if allowed is None else None, vector)
    if allowed is not None:
        scored = allowed_chunks(scored, allowed)
    return best_chunks(scored).orderBy(F.desc("score"), "kind", "item_index").limit(max(limit, 0))


def hashed_encoder(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed hashing of letter trigrams, unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for i in range(max(len(text) - 2, 0)):
                h = zlib.crc32(text[i : i + 3].encode())
                row[h % dimension] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed_chunks(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], prefix: str = "passage: ") -> DataFrame:
    """Adds ``embedding``, encoded batch by batch; spark.sql.execution.arrow.maxRecordsPerBatch bounds a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=list(encode([prefix + t for t in batch["text"]])))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, embedding array<float>")


def fingerprint(*tables: DataFrame) -> str:
    """A name for the contents of tables, whatever the order of their rows: one aggregate each, one row to the driver."""
    parts = []
    for t in tables:
        h = F.xxhash64(*sorted(t.columns))
        parts.append(tuple(t.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()))
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def index_meta(vectors: DataFrame, fingerprint: str, encoder: str, version: int = VERSION) -> dict:
    """What :func:`check_index` wants to know of stored vectors: one aggregate."""
    count, dimension = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return {"schema_version": version, "index_sha256": fingerprint, "encoder": encoder, "vector_count": count, "dimension": dimension or 0}


def check_index(chunks: DataFrame, vectors: DataFrame, meta: dict, fingerprint: str, dimension: int, version: int = VERSION, encoder: str | None = None) -> None:
    """Raise SemanticUnavailable unless the vectors are those of this keyword index, by this encoder if one is named."""
    if meta.get("schema_version") != version or meta.get("index_sha256") != fingerprint:
        raise SemanticUnavailable("the vectors were built for another index")
    if encoder is not None and meta.get("encoder") != encoder:
        raise SemanticUnavailable("the vectors were made by another encoder")
    kinds = ~F.col("kind").isin("article", "attachment") | (F.col("item_index") < 0)
    row = vectors.agg(F.count("*"), F.sum(kinds.cast("int")), F.sum((F.size("embedding") != dimension).cast("int"))).first()
    if row[0] != meta.get("vector_count") or row[0] != chunks.count() or row[1] or row[2]:
        raise SemanticUnavailable("vectors and chunks don't agree")


#: How long a marker pauses dense search, in seconds, and how long at least.
PAUSE_SECONDS, LEAST_PAUSE = 7200.0, 1.0


def marker_age(marker: str, now: float) -> float | None:
    """Seconds since a marker file was set; None without one, 0 if it can't be examined."""
    try:
        return now - Path(marker).stat().st_mtime
    except OSError as e:
        return None if e.errno == errno.ENOENT else 0.0


def runtime_paused(marker: str | None, now: float, max_age: float = PAUSE_SECONDS) -> bool:
    """Whether a marker no older than ``max_age`` pauses dense search."""
    age = marker_age(marker, now) if marker else None
    return age is not None and age <= max(LEAST_PAUSE, max_age)


def row_numbers(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` from 1. For tables of a top-k's size only: they are ranked in one task."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
