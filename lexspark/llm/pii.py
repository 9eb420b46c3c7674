"""Operator 4: personal data, plain and disguised, as spans of source characters.

Plain identifiers are found by four patterns on the text as it is. Disguised ones are
found by normalising the text with small transducers that keep, for every character
they write, the source characters it stands for:

* homoglyphs: look-alike Cyrillic and Greek letters, full-width and styled letters and
  digits become ASCII; zero-width characters vanish;
* spelled digits: runs of at least four digit words or digits, one of them a word
  (English, German, French, Spanish), become digits, and a "plus" before them a sign;
* "at" and "dot": bracketed, or bare between words where both are there, become @ and a
  full stop.

The same patterns run on the normalised text; a match that uses a rewritten character
is mapped back and added unless a plain span of its kind covers it.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain from the left. Starts from each @, so a long run of letters costs its length once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the four patterns, in order; a match that fails its check is dropped."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# Look-alike letters (Cyrillic, then Greek), and the ASCII letters they resemble.
LOOK_ALIKE = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABESIJKMHOPCTYXaesijopcyxdqwh" "ABEZHIKMNOPTYXoa", strict=True))
ZERO_WIDTH = "­​‌‍⁠﻿"
DISGUISED = re.compile(f"[{''.join(LOOK_ALIKE)}{ZERO_WIDTH}！-～٠-٩۰-۹①-⓿𝐀-𝟿Ａ-Ｚａ-ｚ]")

# Digit words, zero to nine; "oh" is another zero.
DIGIT_WORDS = {
    word: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: A cheap test for two digit words in a row, then the run itself.
TWO_WORDS = re.compile(rf"\b(?:{WORD})[\s,.-]{{1,3}}(?:{WORD}|[0-9])\b|\b[0-9][\s,.-]{{1,3}}(?:{WORD})\b", re.I)
RUN = re.compile(rf"(?:\bplus[\s-]{{1,3}})?(?:\b(?:{WORD})\b|(?<!\w)[0-9])(?:[\s,-]{{1,3}}(?:dot[\s]{{1,3}})?(?:{WORD}|[0-9])\b){{3,}}", re.I)
ITEM = re.compile(rf"plus|dot|{WORD}|[0-9]", re.I)

MARKED_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|arroba|@)\s{0,3}[\])}>]\s{0,3}", re.I)
MARKED_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|punto|point|\.)\s{0,3}[\])}>]\s{0,3}", re.I)
NAME = r"[A-Za-z0-9-]{1,63}"
BARE = re.compile(rf"(?<=[A-Za-z0-9])(\s{{1,3}}at\s{{1,3}}){NAME}(?:(?:\s{{1,3}}dot\s{{1,3}}|\.){NAME}){{0,8}}\s{{1,3}}dot\s{{1,3}}{NAME}", re.I)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.I)


class Mapped:
    """A text with, for runs of its characters, the source spans they stand for."""

    def __init__(self, text: str):
        self.text = text
        #: (start here, start in source, whether rewritten), by start; a rewritten run is one unit
        self.runs: list[tuple[int, int, bool]] = [(0, 0, False)]
        self.length = len(text)

    @functools.cached_property
    def keys(self) -> list[int]:
        return [r[0] for r in self.runs]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span that a span here stands for."""
        i, j = bisect_right(self.keys, start) - 1, bisect_right(self.keys, end - 1) - 1
        a, b = self.runs[i], self.runs[j]
        begin = a[1] if a[2] else a[1] + start - a[0]
        stop = (self.runs[j + 1][1] if j + 1 < len(self.runs) else self.length) if b[2] else b[1] + end - b[0]
        return begin, stop


def rewrite(mapped: Mapped, edits: list[tuple[int, int, str]]) -> Mapped:
    """Apply (start, end, new) edits, given in order and apart, keeping the map to the source."""
    if not edits:
        return mapped
    out, parts, at, size = Mapped.__new__(Mapped), [], 0, 0
    runs: list[tuple[int, int, bool]] = []
    keys, total = mapped.keys, len(mapped.text)

    def copy(a: int, b: int) -> None:
        nonlocal size
        if a >= b:
            return
        i = bisect_right(keys, a) - 1
        while a < b:
            start, src, new = mapped.runs[i]
            end = min(b, mapped.runs[i + 1][0] if i + 1 < len(mapped.runs) else total)
            if end > a:
                runs.append((size, src if new else src + a - start, new))
                parts.append(mapped.text[a:end])
                size += end - a
                a = end
            i += 1

    for start, end, new in edits:
        copy(at, start)
        if new:
            runs.append((size, mapped.source(start, end)[0], True))
            parts.append(new)
            size += len(new)
        at = end
    copy(at, total)
    out.text, out.runs, out.length = "".join(parts), runs or [(0, 0, False)], mapped.length
    return out


def _plain_character(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii():
        return folded
    return str(unicodedata.decimal(c, "")) or c


def _digits(m: re.Match) -> str:
    out = []
    for x in ITEM.finditer(m[0]):
        word = x[0].lower()
        out.append("+" if word == "plus" else "." if word == "dot" else DIGIT_WORDS.get(word, word))
    return "".join(out)


def normalise(text: str) -> Mapped | None:
    """The text without disguises, or None if it shows none."""
    mapped = Mapped(text)
    if DISGUISED.search(text):
        mapped = rewrite(mapped, [(m.start(), m.end(), _plain_character(m[0])) for m in DISGUISED.finditer(text)])
    if TWO_WORDS.search(mapped.text):
        mapped = rewrite(mapped, [(m.start(), m.end(), _digits(m)) for m in RUN.finditer(mapped.text) if re.search("[a-z]{2}", m[0], re.I)])
    if re.search(r"[\[({<]\s{0,3}(?:at|arroba|@|dot|punkt|punto|point|\.)\s{0,3}[\])}>]", mapped.text, re.I):
        mapped = rewrite(mapped, [(m.start(), m.end(), "@") for m in MARKED_AT.finditer(mapped.text)])
        mapped = rewrite(mapped, [(m.start(), m.end(), ".") for m in MARKED_DOT.finditer(mapped.text)])
    if "dot" in mapped.text.lower():
        mapped = rewrite(mapped, [(m.start(1), m.end(1), "@") for m in BARE.finditer(mapped.text)])
        mapped = rewrite(mapped, [(m.start(), m.end(), ".") for m in BARE_DOT.finditer(mapped.text)])
    return None if mapped.text is text else mapped


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain spans, all spans), each ordered by kind and start."""
    base = plain_spans(text)
    mapped = normalise(text)
    if mapped is None:
        return base, base
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in range(len(KINDS))}
    added = []
    for kind, start, end in plain_spans(mapped.text):
        a, b = mapped.source(start, end)
        i = bisect_right(taken[kind], (a, 1 << 62))  # the plain span that starts last up to a, if any
        if text[a:b] != mapped.text[start:end] and not any(b <= y for _, y in taken[kind][max(0, i - 1) : i]):
            added.append((kind, a, b))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of plain spans by kind, their digest, and all spans.

    Offsets are code points of the source text, ends excluded. A null text is empty.
    Rows are independent, so repeated ids and texts give repeated rows; no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                base, spans = all_spans(value or "")
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, SPANS)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, the first's."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in all_spans(text)[1]):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(text: Column) -> Column:
    """Column form of :func:`redacted`; null stays null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else redacted(v) for v in values.to_pylist()], pa.string())

    return run(text)
