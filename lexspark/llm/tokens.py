"""Token ids of whole texts, exactly as the tokenizers library gives them, with little work for each word.

A text is cut before its single spaces, the words of a slice are told apart in Arrow, and each
distinct word is encoded once. Ids of words in plain Latin letters are proposed by the tiktoken library,
whose merging goes by ranks of results and not of pairs, and stand only where the merge rules prove
them: a sequence of ids is the library's if each neighbouring pair is, and a pair is
if, with the merges of both undone from the last, no rule joins the two sides earlier. All
other words, and texts with other white space than single blanks and line ends or with a
special token's string, are given to the tokenizers library as they are.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What the byte-level pattern treats as white space, and its words.
WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that all libraries class alike; a word of them neither starts nor ends in white space.
LATIN = "!-~À-ÖØ-öø-ſ"
PLAIN_WORD = f"^[{LATIN}](?:[\\n {LATIN}]*[{LATIN}])?$"

#: UTF-8 bytes of the texts that are encoded together, which bounds a worker's memory.
SLICE_BYTES = 24 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merge rules of a byte-level vocabulary whose ids follow its rules, and the proof that a pair of ids is its own encoding."""

    def __init__(self, vocabulary: dict[str, int], rules: list[tuple[str, str]], alphabet: int):
        n = alphabet + len(rules)
        self.left, self.right = np.arange(n), np.arange(n)
        for i, (a, b) in enumerate(rules):
            self.left[alphabet + i], self.right[alphabet + i] = vocabulary[a], vocabulary[b]
        code = (self.left[alphabet:] << 32) | self.right[alphabet:]
        order = np.argsort(code)
        self.codes, self.made = code[order], alphabet + order

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the ids a, b side by side are the encoding of their text, if each alone is.

        Merges of both sides are undone from the last. Between two of them the same two
        ids meet at the border; a rule for these that comes before the next merge would have
        been used. Of equal rules the one further left goes first.
        """
        ok = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        until = np.full(len(a), 1 << 40)
        while len(live):
            code = (a << 32) | b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            joined = (self.codes[at] == code) & (self.made[at] < until)
            ok[live[joined]] = False
            first, second = self.left[a] != a, self.left[b] != b  # what can be undone
            on = ~joined & (first | second)
            live, a, b, first, second = live[on], a[on], b[on], first[on], second[on]
            undo = first & (~second | (a > b))
            until = np.where(undo, a, b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok


class PieceEncoder:
    """Token ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = self._proposer(path)

    def _proposer(self, path: str):
        """The proposing library, set up with the same vocabulary; None for a file whose rules the proof doesn't cover."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, first = parts["model"], parts["pre_tokenizer"] or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not parts["normalizer"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type", "BPE") != "BPE" or not plain or any(model.get(k) for k in odd):
            return None
        vocabulary, alphabet = model["vocab"], byte_letters()
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len(vocabulary) != 256 + len(rules) or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(rules)) or any(vocabulary.get(c, 256) > 255 for c in alphabet):
            return None
        self.merges = Merges(vocabulary, rules, 256)
        self.widths = np.zeros(len(vocabulary), np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        # ids that are the encoding of their own text; the others never prove a word
        self.own = np.array([[t.id for t in self.tokenizer.model.tokenize(token)] == [i] for token, i in sorted(vocabulary.items(), key=lambda x: x[1])])
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """One array of ids per text; a null text is empty."""
        ids, ends = self.encode_column(pa.array([t or "" for t in texts], pa.string()))
        return np.split(ids, ends[:-1]) if len(ends) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end); a null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.fast is None or not len(texts):
            return self._joined([np.array(x, self.dtype) for x in self._library(texts.to_pylist())])
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy().astype(np.int64)
        told = cut.flatten().dictionary_encode()
        words, place = told.dictionary, told.indices.to_numpy().astype(np.int64)
        heads = starts[:-1]
        # a blank before white space, or before nothing, doesn't start a word: such texts go to the library whole
        odd = pc.or_(pc.equal(words, ""), pc.match_substring_regex(words, f"^[{WHITE}]")).to_numpy(zero_copy_only=False)
        later = odd[place]
        later[heads] = False
        whole = np.add.reduceat(later, heads) > 0
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # units: each word with the blank before it, then each text's first word or the whole text
        ids, lengths = self._words(words.filter(pa.array(~odd)), " ")
        unit_lengths = np.zeros(len(words) + len(texts) + 1, np.int64)
        unit_lengths[:-1][: len(words)][~odd] = lengths
        firsts = words.take(pa.array(place[heads]))
        own, own_lengths = self._words(firsts.filter(pa.array(~whole)), "")
        unit_lengths[len(words) : -1][~whole] = own_lengths
        units = np.where(np.repeat(whole, np.diff(starts)), len(words) + len(texts), place)
        units[heads] = len(words) + np.arange(len(texts))
        if whole.any():
            given = [np.array(x, self.dtype) for x in self._library(texts.filter(pa.array(whole)).to_pylist())]
            unit_lengths[len(words) : -1][whole] = [len(x) for x in given]
            parts = iter(np.split(own, np.cumsum(own_lengths)[:-1]) if len(own_lengths) else [])
            texts_left = iter(given)
            own = np.concatenate([next(texts_left) if w else next(parts) for w in whole.tolist()])
        pool = np.concatenate([ids, own])
        unit_starts = np.concatenate([[0], np.cumsum(unit_lengths)[:-1]])
        sizes = unit_lengths[units]
        ends = np.cumsum(sizes)
        shift = (unit_starts[units] - (ends - sizes)).astype(np.int32 if len(pool) + int(ends[-1]) < 1 << 31 else np.int64)
        gather = np.repeat(shift, sizes)
        gather += np.arange(len(gather), dtype=gather.dtype)
        return pool[gather], ends[starts[1:] - 1]

    def _words(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, with ``before`` ahead of each; how many each has)."""
        n = len(words)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False)
        lengths = np.zeros(n, np.int64)
        proposed = np.zeros(0, self.dtype)
        if plain.any():
            some = words.filter(pa.array(plain))
            # a word starts with its blank; first words are kept apart by line ends, which are ids of their own
            mark = before or "\n"
            joined = mark + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), mark)[0].as_py()
            found = self.fast.encode_to_numpy(joined).astype(np.int64)
            stops = np.cumsum(self.widths[found])
            ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            last = np.searchsorted(stops, ends)
            proven = stops[np.minimum(last, len(stops) - 1)] == ends
            counts = np.diff(last + 1, prepend=0)
            word_of = np.repeat(np.arange(len(some)), counts)
            pairs = (found[:-1] << 32) | found[1:]
            kinds = np.unique(pairs)
            bad = kinds[~self.merges.stands(kinds >> 32, kinds & 0xFFFFFFFF)]
            for at in (np.flatnonzero(np.isin(pairs, bad)) if len(bad) else []), np.flatnonzero(~self.own[found]):
                proven[word_of[at]] = False
            if not before:
                firsts = last - counts + 1
                proven &= self.widths[found[firsts]] == 1
                keep = np.ones(len(found), bool)
                keep[firsts] = False
                found, word_of, counts = found[keep], word_of[keep], counts - 1
            proposed = found[proven[word_of]].astype(self.dtype)
            plain[np.flatnonzero(plain)[~proven]] = False
            lengths[plain] = counts[proven]
        if plain.all():
            return proposed, lengths
        others = self._library([before + w for w in words.filter(pa.array(~plain)).to_pylist()])
        lengths[~plain] = [len(x) for x in others]
        ids = np.zeros(int(lengths.sum()), self.dtype)
        from_library = np.repeat(~plain, lengths)
        ids[~from_library] = proposed
        ids[from_library] = np.concatenate([np.array(x, self.dtype) for x in others])
        return ids, lengths

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(arrays) if arrays else np.zeros(0, self.dtype)
        return ids, np.cumsum([len(a) for a in arrays], dtype=np.int64)


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    return PieceEncoder(path)


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``most`` bytes of the text column, one row at least; small batches become one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + (not held), int(np.searchsorted(ends, done + most - size, "right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            start, done = stop, int(ends[stop - 1]) if stop else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
