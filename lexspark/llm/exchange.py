"""Chunks of documents that question the rest of the corpus through packed messages.

Some operators must know, for every window of every text, what the other texts hold.
As rows, those windows would be many times the input. Here documents are dealt into
chunks by a hash of their id; a chunk sends each bucket of the hash space one message,
its distinct sorted hashes packed, and a bucket answers each chunk with a message in
the same order, often a bit a hash. Messages are combined in the chunk before they are
sent, so a passage that fills a third of the corpus is one hash per chunk.

All steps of a query form one plan, so the exchange that deals the documents is
computed once and reused, and a lost executor's part is recomputed from the input.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of a chunk, and hashes of a bucket, that one task holds at a time.
CHUNK_BYTES = 12 << 20

MESSAGE = "bucket int, chunk int, body binary"

#: The C library's call that gives freed memory back, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bits of a filter hash; a chance match only adds work, since a later step compares in full.
FILTER_BITS = 48


def chunked(docs: DataFrame, n_chunks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, doc_id, text). Rows without an id share a chunk."""
    key = F.col(doc_id).cast("long")
    return docs.select(F.pmod(F.xxhash64(key), F.lit(n_chunks)).cast("int").alias("chunk"), key.alias("doc_id"), F.col(text).alias("text"))


def read_chunk(table: pa.Table) -> tuple[int, list[int | None], list[bytes]]:
    """(chunk, ids, texts as bytes) in the order of (id, text), so every step sees the same order."""
    ids, texts = table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return table.column("chunk")[0].as_py(), [ids[i] for i in order], [texts[i] for i in order]


def trimmed(result: pa.Table) -> pa.Table:
    """The result of a step; what the step has freed goes back to the system, since a worker stays for the next chunk."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    return result


def send(chunks: DataFrame, step: Callable, schema: str = MESSAGE) -> DataFrame:
    """First messages: ``step(table)`` for each chunk."""
    return chunks.groupBy("chunk").applyInArrow(lambda table: trimmed(step(table)), schema)


def answer(messages: DataFrame, step: Callable, schema: str = MESSAGE) -> DataFrame:
    """``step(table)`` for each bucket's messages."""
    return messages.groupBy("bucket").applyInArrow(lambda table: trimmed(step(table)), schema)


def resume(chunks: DataFrame, answers: DataFrame, step: Callable, schema: str = MESSAGE) -> DataFrame:
    """``step(documents, answers)`` for each chunk."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda table, own: trimmed(step(table, own)), schema)


def messages(chunk: int, bodies: dict[int, bytes]) -> pa.Table:
    return pa.table(
        {"bucket": pa.array(list(bodies), pa.int32()), "chunk": pa.array([chunk] * len(bodies), pa.int32()), "body": pa.array(list(bodies.values()), pa.binary())}
    )


def replies(bucket: int, bodies: dict[int, bytes]) -> pa.Table:
    return pa.table(
        {"bucket": pa.array([bucket] * len(bodies), pa.int32()), "chunk": pa.array(list(bodies), pa.int32()), "body": pa.array(list(bodies.values()), pa.binary())}
    )


def bodies_by(table: pa.Table, key: str) -> dict[int, bytes]:
    return dict(sorted(zip(table.column(key).to_pylist(), table.column("body").to_pylist(), strict=True)))


def bucket_edges(hashes: np.ndarray, n_buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's part of sorted hashes of ``bits`` bits starts; n_buckets + 1 places."""
    width = (1 << bits) // n_buckets
    edges = np.array([width * i for i in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body. Sorted unsigned ones are kept as differences, numbers by byte plane."""
    parts = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        if a.dtype == bool:
            parts += [b"b", np.array([len(a)], "<u8").tobytes(), np.packbits(a).tobytes()]
            continue
        a = np.ascontiguousarray(a)
        code = a.dtype.str[-2:].encode()
        kind = b"s" if a.dtype.kind == "u" and len(a) > 1 and (a[1:] >= a[:-1]).all() else b"n"
        if kind == b"s":
            a = np.diff(a, prepend=a.dtype.type(0))
        parts += [kind + code, np.array([len(a)], "<u8").tobytes(), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(body)
    n, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    for _ in range(n):
        kind = data[at : at + 1]
        code = "" if kind == b"b" else data[at + 1 : at + 3].decode()
        at += 1 + len(code)
        size = int(np.frombuffer(data, "<u8", 1, at)[0])
        at += 8
        if kind == b"b":
            out.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
            continue
        width = int(code[1])
        a = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T.copy().view(f"<{code}").reshape(-1)
        at += size * width
        out.append(np.cumsum(a, dtype=a.dtype) if kind == b"s" else a)
    return out
