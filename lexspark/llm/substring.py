"""Operator 2: repeated passages, found by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of BLOCK words;
every rolling window of BLOCK words of every document probes them. A passage of WINDOW
words holds a whole block wherever it lies, as WINDOW >= 2 BLOCK - 1, so two equal
passages always share an anchor. Around anchors, hits extend to maximal repeats: the
windows of WINDOW words that hold an anchored place are compared in full (by 96 bits),
each with its first place in the corpus.

Steps, on the chunks and buckets of :mod:`.exchange`:

1. a chunk sends the distinct hashes of its rolling windows, and which are blocks;
2. a bucket answers, a bit a hash, which are anchors: a block found at another place too;
3. a chunk sends, for each distinct WINDOW-word window around an anchor, its first place;
4. a bucket answers, a bit a window, whether that place is the corpus's first;
5. a chunk removes the words of all windows that aren't the first of their kind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count
from .exchange import CHUNK_BYTES, FILTER_BITS, answer, bodies_by, bucket_edges, chunked, messages, pack, read_chunk, replies, resume, send, unpack
from .words import CHECK_BASE, blocks, inside_texts, windows, word_hashes

WINDOW = 20
BLOCK = 10

SHIFT = np.uint64(64 - FILTER_BITS)
SLICE_BYTES = 1 << 20


class ChunkWords:
    """The word hashes of a chunk, its documents one after another in the order of read_chunk."""

    def __init__(self, texts: list[bytes]):
        hashes, counts = [], [np.zeros(1, np.int64)]
        for lo, hi in blocks([len(t) for t in texts], SLICE_BYTES):
            found, bounds = word_hashes(texts[lo:hi])
            hashes.append(found)
            counts.append(np.diff(bounds))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.bounds = np.cumsum(np.concatenate(counts))
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def rolling(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window hashes, which lie in one document)."""
        found = windows(self.hashes, size)
        return found, inside_texts(self.bounds, size, len(found))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each probe, its place; the distinct hashes, sorted; which are blocks)."""
        found, ok = self.rolling(BLOCK)
        at = np.flatnonzero(ok)
        values = found[at] >> SHIFT
        block = (at - self.bounds[self.doc_of[at]]) % BLOCK == 0
        return values, at, distinct(values), distinct(values[block])


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def more_than_once(values: np.ndarray) -> np.ndarray:
    """The distinct values that occur at least twice."""
    values = np.sort(values)
    return distinct(values[1:][values[1:] == values[:-1]])


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chunks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A word goes if a window of WINDOW words that covers it has an equal that starts
    earlier: in a document of smaller id (a null id is smallest, equal ids go by their
    text), or earlier in the same document. Windows are judged on the input. A null or
    blank text has no words and the digest of the empty string; repeated rows are
    documents of their own, of which the first keeps its words.
    """
    return _passes(docs, "digest", doc_id, text, n_chunks)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TEXTS = "doc_id long, text string"


def deduplicated_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chunks: int | None = None) -> DataFrame:
    """(doc_id, text) with the kept words of each document, joined by spaces."""
    return _passes(docs, "texts", doc_id, text, n_chunks)


def _passes(docs: DataFrame, output: str, doc_id: str, text: str, n_chunks: int | None) -> DataFrame:
    n_chunks = n_chunks or chunk_count(docs, CHUNK_BYTES, text)
    n_buckets = n_chunks
    chunks = chunked(docs, n_chunks, doc_id, text)

    def offer(table: pa.Table) -> pa.Table:
        chunk, _, texts = read_chunk(table)
        words = ChunkWords(texts)
        values, _, kinds, reference = words.probes()
        is_block, twice = among(kinds, reference), among(kinds, more_than_once(values))
        edges = bucket_edges(kinds, n_buckets, FILTER_BITS).tolist()
        return messages(chunk, {b: pack(kinds[i:j], is_block[i:j], twice[i:j]) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i})

    def find_anchors(table: pa.Table) -> pa.Table:
        bucket, bodies = table.column("bucket")[0].as_py(), bodies_by(table, "chunk")
        sent = {c: unpack(body) for c, body in bodies.items()}
        everything = np.concatenate([s[0] for s in sent.values()])
        repeated = distinct(np.concatenate([more_than_once(everything), *(s[0][s[2]] for s in sent.values())]))
        reference = distinct(np.concatenate([s[0][s[1]] for s in sent.values()]))
        anchors = repeated[among(repeated, reference)]
        return replies(bucket, {c: pack(among(s[0], anchors)) for c, s in sent.items()})

    def candidates(words: ChunkWords, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around anchors: (place, hash, check), and the places sorted by (hash, check, place)."""
        values, at, kinds, _ = words.probes()
        bits = [unpack(body)[0] for body in bodies_by(answers, "bucket").values()]
        anchored = kinds[np.concatenate(bits)] if bits else kinds[:0]
        hit = np.zeros(len(words.hashes) + 1, np.int64)
        hit[at[among(values, anchored)]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        found, ok = words.rolling(WINDOW)
        start = np.flatnonzero(ok)
        # blocks that lie in the window start at start .. start + WINDOW - BLOCK
        start = start[before[start + WINDOW - BLOCK + 1] > before[start]]
        check = (windows(words.hashes, WINDOW, CHECK_BASE)[start] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((start, check, found[start]))
        return start[order], found[start][order], check[order], order

    def heads_of(found: np.ndarray, check: np.ndarray) -> np.ndarray:
        head = np.ones(len(found), bool)
        head[1:] = (found[1:] != found[:-1]) | (check[1:] != check[:-1])
        return head

    def claim(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return messages(0, {})
        chunk, ids, texts = read_chunk(docs_table)
        words = ChunkWords(texts)
        start, found, check, _ = candidates(words, answers)
        head = heads_of(found, check)
        start, found, check = start[head], found[head], check[head]
        keys = np.array([-(2**63) if i is None else i for i in ids], np.int64)
        doc = words.doc_of[start] if len(start) else np.zeros(0, np.int64)
        place = (start - words.bounds[doc]).astype(np.uint32)
        # equal ids are told apart by their order in the chunk, which all of them share
        edges = bucket_edges(found, n_buckets, 64).tolist()
        parts = {
            b: pack(found[i:j], check[i:j], keys[doc[i:j]], doc[i:j].astype(np.uint32), place[i:j]) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i
        }
        return messages(chunk, parts)

    def judge(table: pa.Table) -> pa.Table:
        bucket, bodies = table.column("bucket")[0].as_py(), bodies_by(table, "chunk")
        sent = {c: unpack(body) for c, body in bodies.items()}
        found, check, key, doc, place = (np.concatenate([s[i] for s in sent.values()]) for i in range(5))
        order = np.lexsort((place, doc, key, check, found))
        first = np.zeros(len(found), bool)
        first[order[heads_of(found[order], check[order])]] = True
        cuts = np.cumsum([len(s[0]) for s in sent.values()])[:-1]
        return replies(bucket, {c: pack(part) for c, part in zip(sent, np.split(first, cuts), strict=True)})

    def remove(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs_table.num_rows:
            kinds = answers.column("kind").to_pylist()
            asked = answers.filter(pa.array([k == 0 for k in kinds], pa.bool_()))
            judged = answers.filter(pa.array([k == 1 for k in kinds], pa.bool_()))
            _, ids, texts = read_chunk(docs_table)
            words = ChunkWords(texts)
            start, found, check, _ = candidates(words, asked)
            head = heads_of(found, check)
            bits = [unpack(body)[0] for body in bodies_by(judged, "bucket").values()]
            first = np.zeros(len(start), bool)
            if bits:
                first[np.flatnonzero(head)[np.concatenate(bits)]] = True
            gone = start[~first]
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            removed = np.cumsum(cover)[:-1] > 0
            for i, text in enumerate(texts):
                drop = removed[words.bounds[i] : words.bounds[i + 1]]
                kept = text.split()
                n = len(kept)
                if drop.any():
                    kept = [w for w, d in zip(kept, drop.tolist(), strict=True) if not d]
                joined = b" ".join(kept)
                rows.append((ids[i], n, n - len(kept), hashlib.sha256(joined).hexdigest()) if output == "digest" else (ids[i], joined.decode("utf-8", "surrogatepass")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if output == "digest" else [pa.int64(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] if output == "digest" else ["doc_id", "text"]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.table({name: pa.array(c, t) for name, c, t in zip(names, columns, kinds, strict=True)})

    anchors = answer(send(chunks, offer), find_anchors)
    firsts = answer(resume(chunks, anchors, claim), judge)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(firsts.withColumn("kind", F.lit(1)))
    return resume(chunks, both, remove, DIGEST if output == "digest" else TEXTS)
