"""Operator 10: packing documents into sequences, best fit in partitions, then up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, slices, tokenizer_path

CAPACITY = 2048

#: A sequence with at most so many places left is finished.
SLACK = 8

#: Groups that meet at each level of the tree, and underfull sequences that a group hands up.
#: Two sequences more than half full never fit together, and best fit leaves a group with at
#: most one that isn't. So every join at a level takes one of at most FAN_IN such sequences, and at
#: most FAN_IN of a group's others find a partner there. What fits into any of them fits into the
#: emptiest, so the emptiest FAN_IN for each of LEVELS levels are all that can ever be joined; more
#: than FAN_IN ** LEVELS partitions there are not.
FAN_IN = 8
LEVELS = 64
HANDED_UP = FAN_IN * LEVELS


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of items, longest first: (bin of each item, offset of each item, fill of each bin).

    Each item goes into the fullest bin that still has room. Open bins are kept by
    room left, with the rooms in use as bits of one number, so finding a bin is a
    shift and the lowest bit.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            bin_ = len(fill)
            fill.append(0)
        where[i], offset[i] = bin_, fill[bin_]
        fill[bin_] += n
        room = capacity - fill[bin_]
        if room:
            by_room[room].append(bin_)
            rooms |= 1 << room
    return where, offset, np.array(fill, np.int64)


def handed_up(fill: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Which bins go on as items: the emptiest HANDED_UP of those that aren't nearly full."""
    open_ = np.flatnonzero(fill < capacity - SLACK)
    return open_[np.argsort(fill[open_], kind="stable")[:HANDED_UP]]


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


#: ``part`` tells partitions apart, ``bin`` numbers its sequences; ``fill`` is the bin's.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long, open boolean"

#: A partition packs pieces in lots of about so many, which bounds its memory.
LOT = 200_000


def pack_partitions(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode, cut and pack each partition's documents as they lie; no shuffle."""
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, first = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            where, offset, fill = best_fit(np.array([r[3] for r in rows], np.int64), capacity)
            open_ = np.zeros(len(fill), bool)
            open_[handed_up(fill, capacity)] = True
            ids, piece, start, length, crc = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(rows), part), pa.int64()), "bin": pa.array(where + first), "offset": pa.array(offset),
                    "fill": pa.array(fill[where]), "open": pa.array(open_[where]),
                }
            ), len(fill)

        for batch in slices(batches):
            found, stops = tool.encode_column(batch.column(1))
            starts = np.concatenate([[0], stops[:-1]]).tolist()
            for key, lo, hi in zip(batch.column(0).to_pylist(), starts, stops.tolist(), strict=True):
                ids = np.concatenate([found[lo:hi].astype("<u4"), end])
                rows += [(key, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(pieces_of(len(ids), capacity))]
            if len(rows) >= LOT:
                out, bins = flush()
                yield out
                rows, first = [], first + bins
        if rows:
            yield flush()[0]

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, PIECES)


MERGED = "part long, bin long, fill long, open boolean, root_part long, root_bin long, shift long"


def merge_level(bins: DataFrame, level: int, capacity: int = CAPACITY) -> DataFrame:
    """Pack open bins, FAN_IN groups together, as items: (part, bin, fill, open, root_part, root_bin, shift).

    A bin's new place is (root_part, root_bin) from ``shift`` on; it keeps its own
    number where it isn't joined with others.
    """

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("bin", "ascending")])
        part, bin_, fill = (table.column(c).to_numpy() for c in ("part", "bin", "fill"))
        where, offset, full = best_fit(fill, capacity)
        head = np.zeros(len(full), np.int64)
        head[where[offset == 0]] = np.flatnonzero(offset == 0)
        open_ = np.zeros(len(full), bool)
        open_[handed_up(full, capacity)] = True
        return pa.table({"part": part, "bin": bin_, "fill": full[where], "open": open_[where], "root_part": part[head[where]], "root_bin": bin_[head[where]], "shift": offset})

    group = F.floor(F.col("part") / (FAN_IN**level)).cast("long")
    return bins.select("part", "bin", "fill", group.alias("group")).groupBy("group").applyInArrow(merge, MERGED)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Only documents of over ``capacity`` ids are cut, a very long text into many pieces. A null or
    empty text is its end id alone; a null id stays null; rows that repeat a document are packed
    each; pieces of one length are packed in the order they are read. Levels of the tree go on until
    all partitions have met; each handles at most FAN_IN x HANDED_UP bins in a task.
    """
    local = materialize(pack_partitions(docs, path, capacity, doc_id, text), "packed")
    parts = (local.agg(F.max("part")).first()[0] or 0) + 1
    # a bin's pieces are in one lot, and the one at offset 0 stands for it
    open_bins = local.filter(F.col("open") & (F.col("offset") == 0)).select("part", "bin", "fill")
    moved, level, width = None, 1, FAN_IN
    while True:
        merged = materialize(merge_level(open_bins, level, capacity), f"merged-{level}")
        step = merged.select("part", "bin", "root_part", "root_bin", "shift")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("part").alias("root_part"), F.col("bin").alias("root_bin"), F.col("root_part").alias("p"), F.col("root_bin").alias("b"), F.col("shift").alias("s"))
            moved = moved.join(later, ["root_part", "root_bin"], "left").select(
                "part", "bin", F.coalesce("p", "root_part").alias("root_part"), F.coalesce("b", "root_bin").alias("root_bin"), (F.col("shift") + F.coalesce("s", F.lit(0))).alias("shift")
            )
        if width >= parts:
            break
        open_bins = merged.filter(F.col("open") & (F.col("shift") == 0)).select("part", "bin", "fill")
        level, width = level + 1, width * FAN_IN
    placed = local.join(moved, ["part", "bin"], "left")
    sequence = F.shiftleft(F.coalesce("root_part", "part"), 36) + F.coalesce("root_bin", "bin")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
