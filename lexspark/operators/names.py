"""Which of many names stand in which of many texts: an automaton, or windows of the names' lengths.

Names of up to PART_CHARACTERS become a trie with failure links, which goes to every task and finds all
of them, however they overlap, in one run over a text, whatever beginnings they share; texts are not
shuffled then. More names are joined with the texts' windows of as many letters. Every task has a
bitmap of at most MOST_BITS with two bits set for each name, so of a text's windows, which are hashed in
place, hardly any but names are sent, and neither texts nor names are sent more than once however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Most characters of names in an automaton, and characters of texts whose windows are hashed at a time.
PART_CHARACTERS, SLICE_CHARACTERS = 1 << 20, 1 << 20

#: Bits of the bitmap for each name, and in all: with more names, more windows are sent that are no names.
NAME_BITS, MOST_BITS = 32, 1 << 27

#: Bits of the bitmap that one task puts together, and the odd factor of the hash.
SHARE_BITS, FACTOR = 1 << 20, 0x9E3779B97F4A7C15


def automaton(names: list[str]):
    """The trie with failure links of distinct names."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for name in names:
        out.add_word(name, name)
    if names:
        out.make_automaton()
    return out


def last_places(machine, text: str) -> dict[str, int]:
    """Each name in the text, and where it starts for the last time."""
    return {name: end - len(name) + 1 for end, name in machine.iter(text)} if len(machine) else {}


def _scan(machine, keys: list, texts: list[str | None], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(key, name, at) for key, text in zip(keys, texts, strict=True) if text for name, at in last_places(machine, text).items()]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def name_places(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, at: str = "at") -> DataFrame:
    """(key, name, at): each distinct name in the text of each row, and where it starts for the last time, from 0.

    ``key`` tells the rows apart. Empty and null names stand in nothing, and nothing in empty and null texts.
    """
    known = names.select(F.col(name).alias(name)).filter(F.col(name) != "").distinct()
    some = texts.select(F.col(key), F.col(text).alias("_text")).filter(F.col("_text") != "")
    kind = some.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, `{name}` string, `{at}` int"
    size, count = known.agg(F.coalesce(F.sum(F.length(name)), F.lit(0)), F.count("*")).first()
    if size <= PART_CHARACTERS:
        every = [r[0] for r in known.collect()]  # at most PART_CHARACTERS, just counted
        handed = texts.sparkSession.sparkContext.broadcast(every)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(handed.value)
            for batch in batches:
                yield _scan(machine, batch.column(0).to_pylist(), batch.column(1).to_pylist(), pa.schema([batch.schema.field(0).with_name(key), (name, pa.string()), (at, pa.int32())]))

        return some.mapInArrow(run, schema)
    return _by_windows(some, key, written(known, "names"), name, count, at, schema)


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of so many code points."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # a window of 2^k + r letters is two of 2^k, r apart
    out, width = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR), 1
    mixed = lambda x, y: ((x ^ (x >> np.uint64(29))) * np.uint64(FACTOR)) + (y ^ (y >> np.uint64(31)))
    while 2 * width <= length:
        out, width = mixed(out[:-width], out[width:]), 2 * width
    if width < length:
        out = mixed(out[:n], out[length - width : length - width + n])
    out = (out ^ (out >> np.uint64(32))) * np.uint64(FACTOR)
    return out ^ (out >> np.uint64(29))


def two_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a bitmap of ``bits``, a power of two of at most 2^32."""
    return (hashes & np.uint64(bits - 1)).astype(np.int64), (hashes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def _name_bitmap(known: DataFrame, name: str, bits: int) -> np.ndarray:
    """Bytes of a bitmap with both bits of every name set; only finished shares of it come to the driver."""
    share = min(bits, SHARE_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for x in batch.column(0).to_pylist():
                by_length.setdefault(len(x), []).append(x)
            hashes = [window_hashes(code_points(group), n)[::n] for n, group in by_length.items()]
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for h in hashes for p in two_places(h, bits))]))
            edges = np.searchsorted(at, np.arange(0, bits + 1, share)).tolist()
            found = [(i, (at[a:b] - i * share).astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["share", "places"])

    def together(table: pa.Table) -> pa.Table:
        own = np.zeros(share, bool)
        for some in table.column("places").to_pylist():
            own[np.frombuffer(some, np.uint32)] = True
        return pa.table({"share": table.column("share")[:1], "bitmap": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    shares = known.select(name).mapInArrow(places, "share int, places binary").groupBy("share").applyInArrow(together, "share int, bitmap binary")
    for i, own in shares.collect():  # MOST_BITS in all at most
        out[i * share // 8 : (i + 1) * share // 8] = np.frombuffer(own, np.uint8)
    return out


def _by_windows(some: DataFrame, key: str, known: DataFrame, name: str, count: int, at: str, schema: str) -> DataFrame:
    lengths = sorted(r[0] for r in known.select(F.length(name)).distinct().collect())
    bits = min(MOST_BITS, max(1 << 10, 1 << (NAME_BITS * count).bit_length()))
    handed = some.sparkSession.sparkContext.broadcast(_name_bitmap(known, name, bits))
    slice_characters = SLICE_CHARACTERS

    def likely(texts: list[str], bitmap: np.ndarray) -> Iterator[tuple[int, str, int]]:
        """(text, window, where it starts) of the windows whose bits are set, a slice of the joined texts at a time."""
        codes = code_points(texts)
        ends = np.cumsum([len(t) for t in texts])
        for lo in range(0, len(codes), slice_characters):
            for n in lengths:
                hashes = window_hashes(codes[lo : lo + slice_characters + n - 1], n)
                first, second = two_places(hashes, bits)
                starts = np.flatnonzero(bitmap[first >> 3] >> (first & 7) & bitmap[second >> 3] >> (second & 7) & 1) + lo
                text = np.searchsorted(ends, starts, "right")
                whole = starts + n <= ends[text]
                for i, start in zip(text[whole].tolist(), starts[whole].tolist(), strict=True):
                    start -= int(ends[i]) - len(texts[i])
                    yield i, texts[i][start : start + n], start

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = handed.value
        for batch in batches:
            out = pa.schema([batch.schema.field(0).with_name(key), (name, pa.string()), (at, pa.int32())])
            texts = batch.column(1).to_pylist()
            last: dict[tuple[int, str], int] = {}
            for i, window, start in likely(texts, bitmap):
                last[i, window] = max(start, last.get((i, window), 0))
            rows = batch.column(0).take(pa.array([i for i, _ in last], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array([w for _, w in last], pa.string()), pa.array(list(last.values()), pa.int32())], schema=out)

    return some.mapInArrow(cut, schema).join(known, name, "left_semi").select(key, name, at)


def contained(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """(text, name, at): each distinct name in each distinct text, and where it starts for the last time, from 0."""
    t = texts.select(F.col(text).alias(text)).distinct()
    return name_places(t, text, text, names, name).select(text, name, "at")


def name_ends(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """(text, name): the distinct names that each distinct text ends with."""
    return contained(texts, text, names, name).filter(F.col("at") + F.length(name) == F.length(text)).select(text, name)
