"""Operator 8: token ids in binary shards, compressed by a pair grammar.

A shard's payload (little-endian) is

    magic "LXRP", version u16, width u16 (bytes of a symbol: 2 or 4)
    documents u32, symbols u32, rules u32, rounds u32, base u32 (first nonterminal)
    document ids i64[documents], token counts u32[documents], symbol counts u32[documents]
    rules of each round u32[rounds], pairs u32[rules, 2], expansion lengths u32[rules]
    symbols u16 or u32 [symbols]

A nonterminal base + r stands for the pair of rule r, whose members are ids or
earlier nonterminals. No nonterminal crosses a document's end, so any document,
or any id range of one, is decoded from its own symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder, slices, tokenizer_path

MAGIC = b"LXRP"
HEADER = struct.Struct("<4sHHIIIII")

#: Least number of times a pair occurs in a shard to get a rule. A rule takes 12 bytes and saves
#: at least two for each of its places.
LEAST_COUNT = 16

#: Ids of a shard; a partition is cut into shards of about so many, which bounds memory.
SHARD_IDS = 1 << 20

#: Pairs are counted in 2 ** HASH_BITS bins first, and only those in full bins exactly.
HASH_BITS = 18


def _bins(code: np.ndarray) -> np.ndarray:
    """A bin for each pair code of 32 or 64 bits."""
    if code.dtype == np.uint32:
        return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _every_other(joined: np.ndarray) -> np.ndarray:
    """Places to keep where ``joined`` marks those that overlap the place before: every other of a run, the first included."""
    place = np.arange(len(joined))
    return np.flatnonzero((place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0)


class Symbols:
    """A shard's symbols as a linked list, in which pairs are replaced in place."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        self.symbol, self.ends, self.dead = symbols.astype(np.uint32), ends.copy(), np.zeros(n, bool)
        self.next, self.last = np.arange(1, n + 1), np.arange(-1, n - 1)
        #: where a pair may begin that a rule could still take
        self.at = np.flatnonzero(~self.ends)

    def frequent(self, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, pair codes) of pairs in full bins, overlaps with themselves left out, and the bins. Only pairs
        next to a replaced one, and those that were frequent before, can be frequent, so only ``at`` is looked at."""
        code = self.symbol[self.at]
        if half == 32:
            code = code.astype(np.uint64)
        code = (code << code.dtype.type(half)) | self.symbol[self.next[self.at]]
        bins = _bins(code)
        hot = np.flatnonzero((np.bincount(bins, minlength=1 << HASH_BITS) >= LEAST_COUNT)[bins])
        at, code, bins = self.at[hot], code[hot], bins[hot]
        again = (self.next[at[:-1]] == at[1:]) & (code[1:] == code[:-1])
        if again.any():
            apart = _every_other(np.append(False, again))
            at, code, bins = at[apart], code[apart], bins[apart]
        return at, code, bins

    def replace(self, chosen: np.ndarray, by: np.ndarray, waiting: list[np.ndarray]) -> None:
        """Put ``by`` in the place of the pairs at ``chosen``; look next at these, at what is ahead of them, and at those that wait."""
        gone = self.next[chosen]
        follow = self.next[gone]
        self.symbol[chosen], self.ends[chosen], self.next[chosen] = by, self.ends[gone], follow
        self.dead[gone] = True
        inside = follow < len(self.symbol)
        self.last[follow[inside]] = chosen[inside]
        ahead = self.last[chosen]
        look = np.zeros(len(self.symbol), bool)
        for at in (chosen, ahead[ahead >= 0], *waiting):
            look[at] = True
        at = np.flatnonzero(look)
        self.at = at[~(self.dead[at] | self.ends[at])]


def repair(symbols: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar-compress ids: (symbols, ends, pairs[rules, 2], rules of each round).

    ``ends`` marks the last id of each document; no pair goes across. A round gives every frequent
    pair a nonterminal and replaces it wherever no more frequent pair overlaps it (ties go by
    code). It ends only when no pair occurs LEAST_COUNT times apart from overlaps with itself.
    """
    own = Symbols(symbols, ends)
    pairs, sizes, made = [], [], base
    while len(own.at):
        half = 16 if made <= 1 << 16 else 32
        at, code, bins = own.frequent(half)
        ordered = np.sort(code)
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        counts = np.diff(np.append(heads, len(ordered)))
        often = counts >= LEAST_COUNT
        if not often.any():
            break
        kinds = ordered[heads[often]]
        by_count = np.argsort(counts[often], kind="stable")
        rank = np.empty(len(kinds), np.int64)
        rank[by_count] = np.arange(len(kinds))
        # of the frequent pairs in one bin the most frequent is found there; the others wait for a later round
        table = np.full(1 << HASH_BITS, -1, np.int64)
        table[_bins(kinds[by_count])] = by_count
        kind = table[bins]
        found = (kind >= 0) & (kinds[kind] == code)
        other = np.flatnonzero(~found)
        waiting = at[other[kinds[np.minimum(np.searchsorted(kinds, code[other]), len(kinds) - 1)] == code[other]]]
        found = np.flatnonzero(found)
        at, kind = at[found], kind[found]
        place = rank[kind]
        near = own.next[at[:-1]] == at[1:]
        top = np.ones(len(at), bool)
        top[1:] &= ~near | (place[1:] >= place[:-1])
        top[:-1] &= ~near | (place[:-1] >= place[1:])
        good = np.bincount(kind[top], minlength=len(kinds)) >= LEAST_COUNT
        top &= good[kind]
        chosen = np.flatnonzero(top)
        number = (np.cumsum(good) - 1 + made).astype(np.uint32)
        own.replace(at[chosen], number[kind[chosen]], [at[~top], waiting])
        rules = kinds[good].astype(np.uint64)
        pairs.append(np.stack([rules >> np.uint64(half), rules & np.uint64((1 << half) - 1)], 1).astype(np.uint32))
        sizes.append(len(rules))
        made += len(rules)
    left = ~own.dead
    return own.symbol[left], own.ends[left], np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint32), np.array(sizes, np.uint32)


def expand(symbols: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: rounds are undone from the last."""
    first = base + len(pairs)
    for n in sizes[::-1]:
        first -= int(n)
        found = symbols >= first
        if found.any():
            spread = np.repeat(symbols, 1 + found)
            at = np.flatnonzero(found) + np.arange(found.sum())
            rule = spread[at] - base
            spread[at], spread[at + 1] = pairs[rule, 0], pairs[rule, 1]
            symbols = spread
    return symbols


def write_payload(doc_ids: list[int | None], arrays: list[np.ndarray], base: int) -> bytes:
    lengths = np.array([len(a) for a in arrays], np.uint32)
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(lengths.astype(np.int64)) - 1] = True
    symbols, ends, pairs, sizes = repair(ids, ends, base)
    symbol_counts = np.diff(np.flatnonzero(ends), prepend=-1).astype(np.uint32)
    width = 2 if base + len(pairs) <= 1 << 16 else 4
    spans = np.ones(base + len(pairs), np.uint32)
    done = 0
    for n in sizes:
        spans[base + done : base + done + n] = spans[pairs[done : done + n]].sum(1)
        done += int(n)
    missing = np.array([i is None for i in doc_ids], bool)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    head = HEADER.pack(MAGIC, 2, width, len(doc_ids), len(symbols), len(pairs), len(sizes), base)
    return b"".join(
        [head, numbers.tobytes(), np.packbits(missing).tobytes(), lengths.tobytes(), symbol_counts.tobytes(), sizes.tobytes(), pairs.tobytes(), spans[base:].tobytes(), symbols.astype(f"<u{width}").tobytes()]
    )


class Payload:
    """Reads a shard; ``document(k)`` decodes one document alone."""

    def __init__(self, data: bytes):
        magic, version, width, docs, symbols, rules, rounds, self.base = HEADER.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token shard")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids = take("<i8", docs)
        self.missing = np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)  # rows without an id
        self.lengths, self.symbol_counts = take("<u4", docs), take("<u4", docs)
        self.sizes, self.pairs, self.spans = take("<u4", rounds), take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self.starts = np.concatenate([[0], np.cumsum(self.symbol_counts, dtype=np.int64)])

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.starts[k] : self.starts[k + 1]].astype(np.uint32), self.pairs, self.sizes, self.base)

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1 of document k, expanding only the symbols that hold them."""
        own = self.symbols[self.starts[k] : self.starts[k + 1]].astype(np.uint32)
        nonterminal = own >= self.base
        span = np.ones(len(own), np.int64)
        span[nonterminal] = self.spans[own[nonterminal] - self.base]
        ends = np.cumsum(span)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[first - 1]) if first else 0
        return expand(own[first:last], self.pairs, self.sizes, self.base)[start - before : stop - before]

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols.astype(np.uint32), self.pairs, self.sizes, self.base)


ENCODED = "part int, doc_id long, ids binary"
SHARDS = "partition int, shard int, n_ids long, payload binary"

#: Stands for a missing id where parts are cut, with the least id.
NO_ID = -(2**63)


def id_bounds(docs: DataFrame, partitions: int, doc_id: str = "doc_id") -> list[int]:
    """At most ``partitions`` - 1 ids that cut the table into parts of about one size; an id that fills parts of its own comes more than once."""
    if partitions < 2:
        return []
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).cast("double").alias("id"))
    return [int(min(x, 2.0**63 - 1024)) for x in ids.approxQuantile("id", [i / partitions for i in range(1, partitions)], 1 / (8 * partitions))]


def encode_documents(docs: DataFrame, bounds: list[int], path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(part, doc_id, ids): each document's ids with ``end_id`` after them, and the part of the id order it belongs to.

    Equal ids that fill several parts are dealt to them by a checksum of their ids.
    """
    path = path or tokenizer_path()
    cuts = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in slices(batches):
            found, ends = tool.encode_column(batch.column(1))
            keys = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
            width = tool.dtype.itemsize
            closed = np.insert(found, ends, np.array(end_id, tool.dtype)) if len(ends) else found
            stops = (ends + np.arange(1, len(ends) + 1)) * width
            data = closed.tobytes()
            starts = np.concatenate([[0], stops[:-1]])
            first, last = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
            part = first.copy()
            for i in np.flatnonzero(last > first).tolist():
                part[i] += zlib.crc32(data[starts[i] : stops[i]]) % (last[i] - first[i] + 1)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.append(0, stops).astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), binary.cast(pa.binary())], ["part", "doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, ENCODED)


def encode_shards(docs: DataFrame, partitions: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Rows (partition, shard, n_ids, payload): the documents in ascending id order, ``end_id`` after each.

    Texts are encoded where they are read, and ids go to the part of the id order that they belong
    to; a part is cut into shards of about SHARD_IDS ids, the last document of each whole. A null
    text is empty, a null id sorts first and stays null; rows that repeat an
    id stay, in the order of their ids as bytes within a part. A very long text is one
    document of one shard.
    """
    path = path or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, partition, shard = encoder(path), TaskContext.get().partitionId(), 0
        base = tool.tokenizer.get_vocab_size()
        names: list[int] = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            payload = write_payload(names, arrays, base)
            return pa.RecordBatch.from_pydict(
                {"partition": pa.array([partition], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())}
            )

        for batch in batches:
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(key)
                arrays.append(np.frombuffer(data, tool.dtype))
                held += len(arrays[-1])
                if held >= SHARD_IDS:
                    yield flush()
                    names, arrays, held, shard = [], [], 0, shard + 1
        if names:
            yield flush()

    encoded = encode_documents(docs, id_bounds(docs, partitions, doc_id), path, doc_id, text, end_id)
    return encoded.repartitionById(partitions, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(write, SHARDS)


DOCUMENTS = "partition int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the payloads."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Payload(batch.column("payload")[row].as_py())
                ids = shard.all_ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "partition": pa.array(np.full(n, batch.column("partition")[row].as_py()), pa.int32()),
                        "shard": pa.array(np.full(n, batch.column("shard")[row].as_py()), pa.int32()),
                        "doc_id": pa.array(shard.doc_ids, mask=shard.missing), "local_start": pa.array(starts), "n_tokens": pa.array(shard.lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    documents = shards.select("partition", "shard", "payload").mapInArrow(decode, DOCUMENTS)
    # ids before each shard: sums per partition first, so no window sees all shards
    sums = shards.groupBy("partition").agg(F.sum("n_ids").alias("n"))
    up_to = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("partition", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    own = Window.partitionBy("partition").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("partition", "shard", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("within")).join(sums, "partition")
    return documents.join(offsets, ["partition", "shard"]).select(
        "doc_id", (F.col("before") + F.col("within") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write the shards to the shared folder, read them back, and list the documents found there."""
    partitions = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), docs.rdd.getNumPartitions())
    return read_documents(materialize(encode_shards(docs, partitions, path), "token-shards"))
