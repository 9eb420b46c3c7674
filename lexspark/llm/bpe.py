"""Operator 11: byte-level BPE by an index of pair occurrences.

The words of a slice of a partition lie side by side as byte symbols. An index maps each
merge rule to the places where its pair stands. Active rules are applied in ascending
order, each to all its places at once; a merge enters the pairs that it makes with its
neighbours into the lists of their rules. Entries that a merge has made stale stay in
their lists and are passed over, since the symbols at a place say whether its pair still
stands. Words are told apart first, so that each distinct one is merged once a slice.

Ascending order over all words is each word's own order: a pair made by a rule can only be
joined by a later rule (this is checked when a file is loaded), so no word goes back.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import Splitter
from .tokens import PieceEncoder, byte_letters, slices, tokenizer_path
from .words import blocks

#: A symbol that a merge has used up, and the place beside a word's last or first symbol.
GONE, NOWHERE = -1, -1

#: UTF-8 bytes of texts, and bytes of ids, that a worker holds at a time; the arrays of a slice are some twenty times these.
ENCODE_BYTES, DECODE_BYTES = 12 << 20, 4 << 20

#: Rules are applied to all their places at once while these are about LONG on average over the last PATIENCE rules.
LONG, PATIENCE = 24, 200


class Rules:
    """Merge rules of a vocabulary file: the pair of each rank, and what it becomes."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rules = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        made = {}
        for rank, (_, _, new) in enumerate(self.rules):
            made[new] = rank
        if any(made.get(x, -1) >= rank for rank, (a, b, _) in enumerate(self.rules) for x in (a, b)):
            raise ValueError("a merge rule uses a token that a later rule makes")
        self.rank = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        codes = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], np.fromiter(self.rank.values(), np.int64, len(codes))[order]
        letters = {b: c for c, b in byte_letters().items()}
        self.bytes = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)

    def occurrences(self, symbols: np.ndarray, last: np.ndarray) -> dict[int, list[np.ndarray]]:
        """The index at the start: by rank, the places of its pair in ascending order. ``last`` marks ends of words."""
        codes = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        places = np.flatnonzero((self.codes[at] == codes) & ~last[:-1]) if len(self.codes) else np.zeros(0, np.int64)
        ranks = self.ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        return {int(ranks[a]): [p] for a, p in zip(cuts, np.split(places, cuts[1:]), strict=True)} if len(cuts) else {}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has)."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return np.zeros(0, np.int64), lengths
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = NOWHERE
        before[1:][last[:-1]] = NOWHERE
        index = self.occurrences(symbols, last)
        active = list(index)
        heapq.heapify(active)
        self._long_lists(symbols, after, before, index, active)
        if active:
            symbols = self._short_lists(symbols, after, before, index, active)
        left_over = symbols != GONE
        upto = np.concatenate([[0], np.cumsum(left_over)])
        return symbols[left_over], np.diff(upto[np.concatenate([[0], ends])])

    def _long_lists(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, index: dict[int, list[np.ndarray]], active: list[int]) -> None:
        """Apply the active rules in order, all places of one at a time, in place, until their lists have become short."""
        seen = 2.0 * LONG
        while active and seen >= LONG:
            rank = heapq.heappop(active)
            left, right, new = self.rules[rank]
            places = np.concatenate(index.pop(rank))
            seen += (len(places) - seen) / PATIENCE
            j = after[places]
            stands = (symbols[places] == left) & (j >= 0) & (symbols[j] == right)
            i = np.unique(places[stands])
            if left == right:  # of overlapping places the one further left goes first: every other one of a run
                at = np.arange(len(i))
                heads = np.ones(len(i), bool)
                heads[1:] = after[i[:-1]] != i[1:]
                i = i[(at - np.maximum.accumulate(np.where(heads, at, 0))) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = new, GONE
            after[i] = k
            inner = k >= 0
            before[k[inner]] = i[inner]
            h = before[i]
            h = h[h >= 0]
            made = np.concatenate([i[inner], h])
            codes = symbols[made] << 32 | symbols[after[made]]
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[at] == codes
            ranks, made = self.ranks[at[known]], made[known]
            order = np.argsort(ranks, kind="stable")
            ranks, made = ranks[order], made[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(ranks)], strict=False):
                r = int(ranks[a])
                if r in index:
                    index[r].append(made[a:b])
                else:
                    index[r] = [made[a:b]]
                    heapq.heappush(active, r)

    def _short_lists(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, found: dict[int, list[np.ndarray]], active: list[int]) -> np.ndarray:
        """The same place by place, which short lists take less time for."""
        index = {rank: np.concatenate(parts).tolist() for rank, parts in found.items()}
        symbol, after, before = symbols.tolist(), after.tolist(), before.tolist()
        rank_of, rules = self.rank.get, self.rules
        while active:
            rank = heapq.heappop(active)
            left, right, new = rules[rank]
            places = index.pop(rank)
            if left == right:
                places.sort()
            for i in places:
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = new, GONE
                after[i] = k = after[j]
                h = before[i]
                pairs = []
                if k >= 0:
                    before[k] = i
                    pairs.append((i, rank_of(new << 32 | symbol[k])))
                if h >= 0:
                    pairs.append((h, rank_of(symbol[h] << 32 | new)))
                for place, r in pairs:
                    if r is None:
                        continue
                    if r in index:
                        index[r].append(place)
                    else:
                        index[r] = [place]
                        heapq.heappush(active, r)
        return np.array(symbol, np.int64)


class OccurrenceEncoder(PieceEncoder):
    """Token ids of whole texts through :class:`Rules`; cutting into distinct words is the base class's."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, first = parts["model"], parts["pre_tokenizer"] or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type", "BPE") != "BPE" or first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space") or parts["normalizer"] or any(model.get(k) for k in odd):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        added = {t["content"]: t for t in parts.get("added_tokens", [])}
        if any(t.get(k) for t in added.values() for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that look at what stands beside them")
        self.rules, self.splitter = Rules(model["vocab"], model["merges"]), Splitter()
        self.special = {s: t["id"] for s, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.dtype = np.dtype("<u4")
        self.fast = True
        # what each id writes: bytes of the letters, or the token's own where it has others
        letters = byte_letters()
        token_of = {i: t for t, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        written = [b""] * (max(token_of, default=-1) + 2)
        for i, token in token_of.items():
            written[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.widths = np.array([len(w) for w in written], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts without special strings, how many each has)."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        some = [t for t in texts if t]
        starts, begin = self.splitter.starts(some)
        edges = [*starts.tolist(), len(joined)]
        words = [joined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        number: dict[str, int] = {}
        place = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        ids, lengths = self.rules.merge([w.encode("utf-8", "surrogatepass") for w in number])
        sizes = lengths[place]
        shift = (np.cumsum(lengths) - lengths)[place] - (np.cumsum(sizes) - sizes)
        out = ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].astype(self.dtype)
        counts = np.zeros(len(texts), np.int64)
        counts[[bool(t) for t in texts]] = np.add.reduceat(sizes, np.searchsorted(starts, begin))
        return out, counts

    def _words(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        return self._pieces([before + w for w in words.to_pylist()])

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with special strings or odd white space: cut at the strings, which are tokens of their own."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = self.cut.split(text) if self.cut else [text]
            parts += cut
            owner += [i] * len(cut)
        ids, counts = self._pieces(["" if p in self.special else p for p in parts])
        out: list[list[np.ndarray]] = [[np.zeros(0, self.dtype)] for _ in texts]
        for part, i, own in zip(parts, owner, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            out[i].append(np.array([self.special[part]], self.dtype) if part in self.special else own)
        return [np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids; unknown ids write nothing, bytes that are no UTF-8 become U+FFFD."""
        ids = np.where(ids < len(self.widths), ids, len(self.widths) - 1)  # the last entry writes nothing
        sizes = self.widths[ids]
        stops = np.cumsum(sizes)
        body = self.written[np.repeat(self.starts[ids] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)].tobytes()
        cuts = np.concatenate([[0], stops])[np.concatenate([[0], ends])].tolist()
        return [body[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.cache
def occurrence_encoder(path: str) -> OccurrenceEncoder:
    """The worker's encoder for a vocabulary file."""
    return OccurrenceEncoder(path)


def binary_slices(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each run of 32-bit ids as little-endian bytes, without a copy a row."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    return large.cast(pa.binary())


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every whole text, as little-endian unsigned 32-bit numbers. No shuffle.

    Special strings inside a text are their tokens; nothing is added, cut off or padded. A null
    text is empty and has no ids; a null id stays null; equal rows come out once each; extra
    columns are ignored. A very long text is one slice of its own. A vocabulary file that
    isn't plain byte-level BPE is a ValueError.
    """
    path = path or tokenizer_path()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = occurrence_encoder(path)
        for batch in slices(batches, most=ENCODE_BYTES):
            ids, ends = tool.encode_column(batch.column(1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0)), binary_slices(ids, ends)], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, n_tokens, ids, text): the text that each row's ids stand for, special tokens included. No shuffle.

    Null ids are none and give an empty text; ids that the vocabulary lacks write nothing; bytes that
    are no UTF-8 become U+FFFD; a row whose length is no multiple of four is a ValueError.
    """
    path = path or tokenizer_path()

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = occurrence_encoder(path)
        for batch in slices(batches, most=DECODE_BYTES):
            column = batch.column(1).fill_null(b"").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if (offsets % 4).any():
                raise ValueError("ids are four bytes each")
            numbers = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4")
            ends = (offsets[1:] - offsets[0]) // 4
            texts = tool.decode(numbers.astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0)), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decode, "doc_id long, n_tokens long, ids binary, text string")


def round_trip_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, text): :func:`encode_documents`, and the text that the ids decode to, in one worker.

    A task holds one vocabulary and one slice. Odd rows are as there; no shuffle.
    """
    path = path or tokenizer_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = occurrence_encoder(path)
        for batch in slices(batches, most=ENCODE_BYTES):
            ids, ends = tool.encode_column(batch.column(1).cast(pa.string()))
            sizes = np.diff(ends, prepend=0)
            for a, b in blocks((4 * sizes).tolist(), DECODE_BYTES):
                start = int(ends[a] - sizes[a])
                own, stops = ids[start : int(ends[b - 1])], ends[a:b] - start
                texts = pa.array(tool.decode(own.astype(np.int64), stops), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), binary_slices(own, stops), texts], ["doc_id", "n_tokens", "ids", "text"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded again."""
    both = round_trip_documents(docs, path, doc_id, text)
    return both.select("doc_id", "n_tokens", F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
