"""Words of many texts as arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import WORD_SEPARATORS, mix64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in WORD_SEPARATORS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the word and window polynomials.
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
CHECK_BASE = np.uint64(0xA0761D6478BD642F)

_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), WORD_BASE)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the texts in order, where each text's words start: len(texts) + 1 places)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        joined = _LOWER[joined]
    gap = _SEPARATOR[joined]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(gap[1:] & inside[:-1]) + 1
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, text_starts)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, lengths)
    powers = _powers_to(int(lengths.max()))
    values = (joined[at].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mix64(sums + lengths.astype(np.uint64) * WINDOW_BASE), bounds


def windows(hashes: np.ndarray, size: int, base: np.uint64 = WINDOW_BASE) -> np.ndarray:
    """Hash of each run of ``size`` words, by doubling: a run is two shorter ones, the second shifted."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, offset = None, 0, 0
    power, span, bit = hashes, 1, size
    while bit:
        if bit & 1:
            part = power[offset : offset + n]
            out = part if out is None else mix64(out * base + part)
            offset += span
        bit >>= 1
        if bit:
            power = mix64(power[: len(power) - span] * base + power[span:])
            span *= 2
    return mix64(out ^ np.uint64(size))


def inside_texts(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n windows of ``size`` words over joined texts lie within one text."""
    ok = np.zeros(n + 1, np.int32)
    lengths = np.diff(bounds)
    full = lengths >= size
    np.add.at(ok, bounds[:-1][full], 1)
    np.add.at(ok, bounds[1:][full] - size + 1, -1)
    return np.cumsum(ok)[:n] > 0


def as_bytes(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive items whose sizes sum to ``most`` at most, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
