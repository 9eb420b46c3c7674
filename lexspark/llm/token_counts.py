"""Operator 5: token counts by a compiled finite-state tokenizer.

Two deterministic transducers do the work.

The *splitter* reads classes of characters and marks where the byte-level pattern
starts a word. It has eleven states. Texts are cut into chunks, a chunk's map from
each entry state to its exit state is computed for all chunks at once, and the maps
are composed by a parallel prefix scan; with every chunk's entry state known, all
chunks are marked in one more pass.

The *counter* reads the bytes of one word. A state is what later bytes can depend
on: for each place from which a vocabulary entry could still be running, the last
token of the encoding up to there and its count. A transition carries the number of
tokens that its byte adds (it can be negative: "t", "h", "e" end in one token).
Its transitions are compiled from the merge list when first needed, and the counts of
whole words are remembered.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices, tokenizer_path

#: Classes of characters: letters that end a contraction have classes of their own.
SPACE, BLANK, QUOTE, STMD, R, V, L_, E, LETTER, NUMBER, OTHER = range(11)

#: States: START also follows a finished contraction; QR, QV and QL are a quote and r, v or l.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_SPACE, AT_BLANK, AT_QUOTE, QR, QV, QL, DEAD = range(11)

#: What a transition marks as the start of a word: this character, the one before, both or none.
NONE, HERE, BEFORE, BOTH = range(4)

#: UTF-8 bytes of the texts that are split together.
SLICE_BYTES = 1 << 19
CHUNK = 256
MEMO_WORDS = 300_000
MOST_STATES = 250_000


def _classes() -> np.ndarray:
    """The class of every code point, as the library's own pattern has it (its Unicode version counts)."""
    from tokenizers.pre_tokenizers import ByteLevel

    pattern = ByteLevel(add_prefix_space=False, use_regex=True)

    def together(text: str) -> bool:
        return len(pattern.pre_tokenize_str(text)) == 1

    def kind(c: str) -> int:
        return LETTER if together("a" + c) else NUMBER if together("1" + c) else OTHER if together("!" + c) else BLANK

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    table[:128] = [kind(chr(i)) for i in range(128)]
    # beyond ASCII a piece of the list of all characters is of one class
    blocks = [128, *range(0x1000, 0xD800, 0x1000), 0xD800, *range(0xE000, sys.maxunicode + 2, 0x1000)]
    for low, high in zip(blocks, blocks[1:], strict=False):
        if low == 0xD800:  # surrogates are no characters
            continue
        everything = "".join(map(chr, range(low, high)))
        for _, (a, b) in pattern.pre_tokenize_str(everything):
            table[low + a : low + b] = kind(everything[a])
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for letters, own in (("stmd", STMD), ("r", R), ("v", V), ("l", L_), ("e", E)):
        for x in letters:
            table[ord(x)] = own
    return table


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) by state x 16 + class."""
    state, mark = np.full(16 * 11, DEAD, np.uint8), np.zeros(16 * 11, np.uint8)

    def home(kind: int) -> int:
        return {SPACE: AT_SPACE, BLANK: AT_BLANK, QUOTE: AT_QUOTE, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}.get(kind, IN_LETTERS)

    def put(s: int, kind: int, to: int, what: int) -> None:
        state[16 * s + kind], mark[16 * s + kind] = to, what

    def as_after_letters(s: int, kind: int, extra: int) -> None:
        to = home(kind)
        put(s, kind, to, extra | (NONE if to == IN_LETTERS else HERE))

    for kind in range(11):
        to = home(kind)
        put(START, kind, to, HERE)
        as_after_letters(IN_LETTERS, kind, NONE)
        put(IN_NUMBERS, kind, to, NONE if to == IN_NUMBERS else HERE)
        put(IN_OTHERS, kind, *((IN_OTHERS, NONE) if kind in (QUOTE, OTHER) else (to, HERE)))
        # white space: its last character belongs to the next word if it is a space, and is a word otherwise
        white = kind in (SPACE, BLANK)
        put(AT_SPACE, kind, to if white or kind != QUOTE else IN_OTHERS, NONE if white else BEFORE)
        put(AT_BLANK, kind, to, NONE if white else BOTH)
        put(AT_QUOTE, kind, *({STMD: (START, NONE), R: (QR, NONE), V: (QV, NONE), L_: (QL, NONE), QUOTE: (IN_OTHERS, NONE), OTHER: (IN_OTHERS, NONE)}.get(kind, (to, HERE))))
        # a quote and one letter that didn't become a contraction: the letter starts a word
        for s, closing in ((QR, E), (QV, E), (QL, L_)):
            put(s, kind, START, NONE) if kind == closing else as_after_letters(s, kind, BEFORE)
    return state, mark


class Splitter:
    def __init__(self):
        self.classes = _classes()
        self.state, self.mark = _splitter()

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where words start in the joined texts, where each text starts)."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths) - lengths
        kinds = self.classes[points]
        # one row of CHUNK classes per chunk; 15 pads a text's last chunk
        per_text = -(-lengths // CHUNK)
        first = np.cumsum(per_text) - per_text
        n = int(per_text.sum())
        text_of = np.repeat(np.arange(len(texts)), per_text)
        chunk_at = begin[text_of] + (np.arange(n) - first[text_of]) * CHUNK
        size = np.minimum(CHUNK, begin[text_of] + lengths[text_of] - chunk_at)
        rows = np.full((CHUNK, n), 15, np.uint8)
        which = np.repeat(np.arange(n), size)
        place = np.arange(len(kinds)) - chunk_at[which]
        rows[place, which] = kinds
        entry = self._entries(rows, size, np.flatnonzero(np.isin(np.arange(n), first)), text_of)
        # marks, all chunks side by side
        marks = np.zeros((CHUNK, n), np.uint8)
        state = entry.astype(np.int64) * 16
        for i in range(CHUNK):
            at = state | rows[i]
            marks[i] = self.mark[at]
            live = rows[i] != 15
            state = np.where(live, self.state[at].astype(np.int64) * 16, state)
        flat = marks[place, which]
        start = (flat & HERE) != 0
        start[:-1] |= (flat[1:] & BEFORE) != 0
        # a text may end in a quote and one letter
        last = np.flatnonzero(per_text) if len(texts) else np.zeros(0, np.int64)
        final = state[(first + per_text - 1)[last]] // 16
        waiting = np.isin(final, (QR, QV, QL))
        start[(begin + lengths - 1)[last[waiting]]] = True
        return np.flatnonzero(start), begin

    def _entries(self, rows: np.ndarray, size: np.ndarray, heads: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Each chunk's entry state, from the composed maps of the chunks before it in its text."""
        n = rows.shape[1]
        entry = np.zeros(n, np.uint8)
        inner = np.flatnonzero(np.append(text_of[1:] == text_of[:-1], False))  # a chunk follows
        if not len(inner):
            return entry
        maps = np.repeat(np.arange(11, dtype=np.uint8)[None, :], n, 0)
        part = rows[:, inner]
        state = np.repeat(np.arange(11, dtype=np.int64)[None, :] * 16, len(inner), 0)
        for i in range(CHUNK):
            state = self.state[state | part[i][:, None]].astype(np.int64) * 16
        maps[inner] = state // 16
        # inclusive scan in log steps, within texts
        step, order = 1, np.arange(n)
        rank = order - np.searchsorted(text_of, text_of)
        while (rank >= step).any():
            later = np.flatnonzero(rank >= step)
            maps[later] = np.take_along_axis(maps[later], maps[later - step], 1)
            step *= 2
        after = np.flatnonzero(rank > 0)
        entry[after] = maps[after - 1, START]
        return entry


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The transducer over a word's bytes, compiled from a merge list as words need it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_letters()
        read = lambda s: bytes(to_byte[c] for c in s)
        self.tokens = {read(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(read(a), read(b)): i for i, (a, b) in enumerate(merges)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.single = {t for t in self.tokens if len(self.merge(t)) == 1}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        #: state -> (bytes that may still run on, (last token, tokens so far less tokens now) at each place in them)
        self.states: list[tuple] = [(b"", ((None, 0),))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        #: state x 256 + byte -> (next state x 256, tokens added)
        self.next: dict[int, tuple[int, int]] = {}
        self.places: dict[tuple, tuple] = {}  # one copy of each

    def merge(self, word: bytes) -> list[bytes]:
        """Encode by the definition: join the best-ranked pair until there is none."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            pair = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, a: bytes | None, b: bytes) -> bool:
        """Whether an encoding may have token b right after token a."""
        if a is None:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) > 4 * MEMO_WORDS:
                self.fits.clear()
            self.fits[a, b] = self.merge(a + b) == [a, b]
        return self.fits[a, b]

    def compile(self, number: int, byte: int) -> tuple[int, int]:
        """Add a transition: the last token is the longest fitting one that ends here."""
        run, places = self.states[number]
        run += bytes([byte])
        last = total = None
        for i in range(len(run)):
            token = run[i:]
            if token in self.single and self.follows(places[i][0], token):
                last, total = token, places[i][1] + 1
                break
        places = [self.places.setdefault(p, p) for p in [*((t, c - total) for t, c in (p or (None, 0) for p in places)), (last, 0)]]
        drop = 0
        while drop < len(run) and run[drop:] not in self.prefixes:
            drop += 1
        # a place inside from which no vocabulary entry is running can't matter any more
        kept = [p if run[i:] in self.prefixes or i == len(run) else None for i, p in enumerate(places[drop:], drop)]
        state = (run[drop:], tuple(kept))
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        self.next[number << 8 | byte] = step = self.numbers[state] << 8, total
        return step

    def count(self, word: bytes) -> int:
        """Tokens of a word: the sum of what its transitions emit."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state, total, get = 0, 0, self.next.get
        for byte in word:
            state, added = get(state | byte) or self.compile(state >> 8, byte)
            total += added
        return total


class TokenCounter:
    """Token counts of whole texts, as the library gives them."""

    def __init__(self, path: str):
        self.splitter, self.counter = Splitter(), Counter(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        #: Special strings are tokens of their own and split a text.
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def counts(self, texts: list[str | None]) -> list[int]:
        parts, owner, out = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            if not text:
                continue
            cut = [text]
            if self.special and self.special.search(text):
                cut = self.special.split(text)
                out[i] += len(cut) - 1
            parts += [p for p in cut if p]
            owner += [i] * sum(map(bool, cut))
        if not parts:
            return out
        starts, begin = self.splitter.starts(parts)
        joined = "".join(parts)
        edges = [*starts.tolist(), len(joined)]
        words = [joined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        known = self.counter.words
        if len(known) > MEMO_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.counter.count(word.encode("utf-8", "surrogatepass"))
        per_word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        sums = np.add.reduceat(per_word, np.searchsorted(starts, begin))
        for i, n in zip(owner, sums.tolist(), strict=True):
            out[i] += n
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The worker's compiled tokenizer for a file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. No shuffle.

    A null text is empty, with no token; a null id stays null; rows that repeat are counted
    each. A very long text is one slice of its own.
    """
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in slices(batches, most=SLICE_BYTES):
            n = np.array(tool.counts(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )
    return plain.mapInArrow(count, COUNTS)
