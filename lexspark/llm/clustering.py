"""Operator 12: k-means whose assignment searches an annulus of centroid norms.

Vectors are whole numbers, so every sum, mean and distance is exact and the result is the
same for any partitioning. For a vector x and any bound u on its distance to the nearest
centroid, that centroid's norm is within u of the norm of x. Centroids are sorted by norm;
the least distance to the two centroids beside x in that order is u; the centroids in the
annulus (its borders included, and widened by more than the rounding of the square
roots) are a range of the order, found by binary search, and only those are compared exactly.

A round is one pass over the table that sends up sums: k rows of ``dimension`` whole numbers a
task, added up by Spark, so k x dimension numbers reach the driver, whatever the table's size. No
state is kept between rounds, and a lost executor's part is computed again from the input.
"""

from __future__ import annotations

import decimal
import fractions
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that are compared together, and the numbers that a block of differences may hold.
BLOCK, CELLS = 8192, 1 << 22

#: Numbers up to which sums of products are exact in double precision and in 64 bits.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 63

Centroids = list[list[int]]


def whole_vectors(column: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors of ``dimension`` finite components, those as floor(scale * x)).

    Components are 64-bit numbers; if a product is beyond those, they are Python's.
    """
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    right = np.nan_to_num(sizes, nan=-1) == dimension
    rows = np.flatnonzero(right)
    flat = column.filter(pa.array(right)).flatten()
    values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimension)
    good = np.isfinite(values).all(axis=1)  # a null component has become NaN
    kept = np.zeros(len(column), bool)
    kept[rows[good]] = True
    values = values[good]
    with np.errstate(over="ignore"):
        product = np.floor(values * scale)
    if not len(product) or np.abs(product).max() < 1 << 62:
        return kept, product.astype(np.int64)
    exact = [[math.floor(fractions.Fraction(x) * scale) for x in row] for row in values.tolist()]
    return kept, np.array(exact, object)


def magnitude(vectors: np.ndarray) -> int:
    return max((abs(int(vectors.min())), abs(int(vectors.max())))) if vectors.size else 0


class Annulus:
    """Exact nearest centroids, the smaller number on a tie."""

    def __init__(self, centroids: Centroids):
        self.centroids = np.array(centroids, object)
        self.largest = magnitude(self.centroids)
        norms = np.array([float(sum(x * x for x in c)) ** 0.5 for c in centroids])
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.by_type: dict[type, np.ndarray] = {}

    def _in(self, kind: type) -> np.ndarray:
        """The centroids in the order of their norms, as numbers of a kind that computes exactly."""
        if kind not in self.by_type:
            self.by_type[kind] = self.centroids[self.order].astype(kind)
        return self.by_type[kind]

    def distances(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to the centroids at its own places (one row each)."""
        centroids = self._in(vectors.dtype.type if vectors.dtype != object else object)
        difference = vectors[:, None, :] - centroids[places]
        return (difference * difference).sum(axis=2)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of whole numbers."""
        most = (magnitude(vectors) + self.largest) ** 2 * max(1, vectors.shape[1])
        kind = np.float64 if most < EXACT_DOUBLE else np.int64 if most < EXACT_LONG else object
        numbers, squares = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), object if kind is object else np.int64)
        for at in range(0, len(vectors), BLOCK):
            block = vectors[at : at + BLOCK].astype(kind)
            numbers[at : at + BLOCK], squares[at : at + BLOCK] = self._block(block)
        return numbers, squares

    def _block(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.norms)
        floats = block.astype(np.float64)
        norms = np.sqrt((floats * floats).sum(axis=1))
        beside = np.searchsorted(self.norms, norms)
        ring = np.stack([np.clip(beside - 1, 0, k - 1), np.clip(beside, 0, k - 1)], axis=1)
        bound = np.sqrt(self.distances(block, ring).min(axis=1).astype(np.float64))
        wide = bound + 1e-9 * (bound + norms + 1)  # far more than the roots' rounding
        low, high = np.searchsorted(self.norms, norms - wide, "left"), np.searchsorted(self.norms, norms + wide, "right")
        best = np.full(len(block), k, np.int64)
        least = np.zeros(len(block), block.dtype)
        # vectors with the same range are compared with its centroids as one matrix
        ranges, member = np.unique(low * (k + 1) + high, return_inverse=True)
        order = np.argsort(member, kind="stable")
        for own, code in zip(np.split(order, np.cumsum(np.bincount(member))[:-1]) if len(order) else [], ranges.tolist(), strict=True):
            a, b = divmod(code, k + 1)
            step = max(1, CELLS // (max(1, len(own)) * max(1, block.shape[1])))
            for lo in range(a, b, step):
                places = np.arange(lo, min(b, lo + step))
                found = self._matrix(block[own], places)
                # of equal distances the smallest number: candidates in the order of their numbers
                by_number = np.argsort(self.order[places], kind="stable")
                pick = by_number[np.argmin(found[:, by_number], axis=1)]
                value, number = found[np.arange(len(own)), pick], self.order[places][pick]
                better = (best[own] == k) | (value < least[own]) | ((value == least[own]) & (number < best[own]))
                least[own[better]], best[own[better]] = value[better], number[better]
        return best, least if block.dtype == object else least.astype(np.int64)

    def _matrix(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared distances of all the vectors to all the centroids at the places."""
        return np.stack([((vectors - c) ** 2).sum(axis=1) for c in self._in(vectors.dtype.type if vectors.dtype != object else object)[places]], axis=1)


def is_vector(column: Column, dimension: int) -> Column:
    """Whether a column holds ``dimension`` components, none null or non-finite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(column) == dimension) & ~odd


def first_centroids(vectors: DataFrame, k: int, salt: str, dimension: int, scale: int, vec_id: str, embedding: str) -> Centroids:
    """The vectors whose ids hash least, as whole numbers in the order of the hashes; fewer if there are fewer vectors.

    Rows of one id go by their components. One TakeOrdered: k rows of each task leave it.
    """
    tag = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(vec_id).cast("long").cast("string"), F.lit(""))), 256)
    some = vectors.filter(is_vector(F.col(embedding), dimension)).select(tag.alias("tag"), F.col(embedding).cast("array<double>").alias("v"))
    rows = some.orderBy("tag", "v").limit(k).collect()
    if not rows:
        return []
    _, found = whole_vectors(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dimension, scale)
    return [[int(x) for x in row] for row in found.tolist()]


SUMS = "cluster int, place int, n decimal(38,0), total decimal(38,0)"


def _assign(vectors: DataFrame, centroids: Centroids, dimension: int, scale: int, vec_id: str, embedding: str, step, schema: str) -> DataFrame:
    """``step(ids, whole vectors, numbers, distances)`` over the vectors of each batch; it is told the end by None."""
    few = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, each = Annulus(centroids), step()
        for batch in batches:
            kept, found = whole_vectors(batch.column(1), dimension, scale)
            if len(found):
                out = each(batch.column(0).filter(pa.array(kept)), found, *search.nearest(found))
                if out is not None:
                    yield out
        out = each(None, None, None, None)
        if out is not None:
            yield out

    return few.mapInArrow(run, schema)


def _sums(k: int, dimension: int):
    """A step that adds up each cluster's vectors and hands the sums up at the end of its task."""

    def start():
        counts, totals, exact = [0] * k, np.zeros((k, dimension), np.int64), np.zeros((k, dimension), object)
        held = 0

        def step(ids, found, numbers, _):
            nonlocal held
            if ids is not None:
                size = magnitude(found) * len(found)
                if held + size >= 1 << 62:  # before 64 bits could overflow
                    exact[:] += totals.astype(object)
                    totals[:] = 0
                    held = 0
                for c in np.unique(numbers).tolist():
                    own = found[numbers == c]
                    counts[c] += len(own)
                    if size >= 1 << 62:
                        exact[c] += own.astype(object).sum(axis=0)
                    else:
                        totals[c] += own.astype(np.int64).sum(axis=0)
                held += size if size < 1 << 62 else 0
                return None
            whole = exact + totals.astype(object)
            rows = [(c, i, counts[c], whole[c, i]) for c in range(k) if counts[c] for i in range(dimension)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            number = pa.decimal128(38, 0)
            big = [pa.array([decimal.Decimal(int(x)) for x in c], number) for c in columns[2:]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *big], ["cluster", "place", "n", "total"])

        return step

    return start


def refine(vectors: DataFrame, centroids: Centroids, dimension: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> Centroids:
    """One round: every vector to its nearest centroid, then each centroid that has vectors becomes floor(sum / count)."""
    parts = _assign(vectors, centroids, dimension, scale, vec_id, embedding, _sums(len(centroids), dimension), SUMS)
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["cluster"]][r["place"]] = int(r["total"]) // int(r["n"])
    return out


def train_centroids(
    vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dimension: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding"
) -> Centroids:
    """The centroids after ``rounds`` rounds, as whole numbers in units of 1 / scale: k x dimension numbers, whatever the table's size.

    They stop early once a round changes none, since later rounds would not either.
    """
    centroids = first_centroids(vectors, k, salt, dimension, scale, vec_id, embedding)
    for _ in range(rounds if centroids else 0):
        moved = refine(vectors, centroids, dimension, scale, vec_id, embedding)
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assign_vectors(vectors: DataFrame, centroids: Centroids, dimension: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance) of every row that is a vector; other rows are left out. No shuffle.

    ``distance`` is the squared distance in whole units; one beyond 64 bits is an OverflowError.
    """
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")

    def start():
        def step(ids, found, numbers, squares):
            if ids is not None:
                return pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int32()), pa.array(squares.tolist() if squares.dtype == object else squares, pa.int64())], ["vec_id", "cluster", "distance"])

        return step

    return _assign(vectors, centroids, dimension, scale, vec_id, embedding, start, "vec_id long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dimension: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row that is a vector.

    Rows whose embedding is null, has another size or a null or non-finite component are left
    out. A null id hashes as an empty one and stays null; rows that repeat an id are vectors of their
    own and go by their components where that decides; equal vectors that are chosen twice at the
    start leave the later centroid empty, and an empty one stays where it is. A tie goes to the smaller number.
    An empty table gives no row. Extra columns are ignored.
    """
    centroids = train_centroids(vectors, k, rounds, salt, dimension, scale, vec_id, embedding)
    rows = assign_vectors(vectors, centroids, dimension, scale, vec_id, embedding)
    if not centroids:
        return rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    own = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    # one row a centroid
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
