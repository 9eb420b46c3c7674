"""Text functions as Column expressions, with the positions and counts that Python strings have.

Positions count from 0 and -1 is absent. White space is Unicode's, as Python's ``\\s``.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles that may end a Korean word, longest kinds first as they are tried.
PARTICLES = (
    "에게서", "으로부터", "로부터", "에서", "께서", "에게", "한테",
    "으로", "이라", "라고", "이며", "이고",
    "을", "를", "이", "가", "은", "는", "에", "와", "과", "의", "도", "만", "로", "라",
)

# Words that say nothing in a query.
STOP_WORDS = frozenset(
    "다음 중 옳은 옳지 않은 것은 것 것이 것을 어느 어떤 해당 어떻게 얼마 약 몇 최소 최대 "
    "이며 이고 이다 한다 있다 없다 이상 이하 초과 미만 포함 제외 관한 관하여 대한 대하여 위한 위해 위하여 "
    "그리고 그러나 만약 또는 다만 단 각 각호 이하의 사항 내용 설명 경우 방법 기준 원칙 규정 "
    "통해 통하여 라고 라면 라는 수 또 더 곧 왜 뭐 이".split()
)

# What the tokenizer cuts at and strips, middle dots of several alphabets, joining words of names.
TOKEN_BREAK = r"[\s,·、]+"
TOKEN_EDGE = "().,!?\"'·"
MIDDLE_DOTS = "·․‧・"
JOINING_WORDS = "에관한|관한|의|및|와|과"

# Marks of amendments in texts.
AMENDED_ANGLE = "개정|신설|삭제|단서개정|제목개정|전부개정"
AMENDED_SQUARE = "개정|신설|삭제|제목개정|단서개정|전부개정"

#: White space but a line's end, with the separators that Python strips and Unicode doesn't class as white.
BLANK = r"(?:[^\S\n]|[\x1c-\x1f])"


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def tokenize(query: str) -> list[str]:
    """Query terms: cut, stripped of edges and of one particle, stop words and single letters dropped, each once."""
    particle = re.compile(f"({'|'.join(PARTICLES)})$")
    out: dict[str, None] = {}
    for part in re.split(TOKEN_BREAK, nfc(query).strip()):
        part = part.strip(TOKEN_EDGE)
        stem = particle.sub("", part)
        term = stem if len(stem) >= 2 else part
        if len(term) >= 2 and term not in STOP_WORDS:
            out[term] = None
    return list(out)


def token_array(text: Column) -> Column:
    """:func:`tokenize` for a column of queries."""
    edge = re.escape(TOKEN_EDGE)
    parts = F.transform(F.split(text, f"(?U){TOKEN_BREAK}"), lambda t: F.regexp_replace(t, f"^[{edge}]+|[{edge}]+$", ""))
    # the leftmost particle goes, and only if two letters stay before it: one pass over a part
    ending = f"(?:{'|'.join(PARTICLES)})$"
    stems = F.transform(parts, lambda t: F.regexp_replace(t, f"(?s)^(?!.?{ending})(.{{2,}}?){ending}", "$1"))
    return F.array_distinct(F.filter(stems, lambda t: (F.length(t) >= 2) & ~t.isin(*sorted(STOP_WORDS))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def count_of(text: Column, part: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def find(text: Column, part: Column | str) -> Column:
    return F.locate(part, text) - 1 if isinstance(part, str) else F.instr(text, part) - 1


def rfind(text: Column, part: Column) -> Column:
    back = F.instr(F.reverse(text), F.reverse(part))
    return F.when(back == 0, -1).otherwise(F.length(text) - back - F.length(part) + 1)


def strip_markup(text: Column) -> Column:
    """Without amendment marks; runs of white space are one space."""
    plain = F.regexp_replace(text, rf"<(?:{AMENDED_ANGLE})[^>]*?>|\[(?:{AMENDED_SQUARE})[^\]]*?\]", "")
    return strip(F.regexp_replace(plain, r"(?U)\s{2,}", " "))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] for 0 <= start."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def flat(text: Column) -> Column:
    return strip_markup(F.replace(text, F.lit("\n"), F.lit(" ")))


def snippet(body: Column, position: Column, span: int = 80) -> Column:
    """The text around a position, dots where it goes on; from the start if the position is -1."""
    start, end = F.greatest(position - span, F.lit(0)), F.least(F.length(body), position + span)
    head = F.concat(flat(F.substring(body, 1, 2 * span)), F.when(F.length(body) > 2 * span, "…").otherwise(""))
    around = F.concat(F.when(start > 0, "…").otherwise(""), flat(cut(body, start, end)), F.when(end < F.length(body), "…").otherwise(""))
    return F.when(F.length(body) == 0, "").when(position < 0, head).otherwise(around)


def context(body: Column, position: Column, span: int = 60) -> Column:
    start, end = F.greatest(position - span, F.lit(0)), F.least(F.length(body), position + span)
    return F.concat(F.when(start > 0, "…").otherwise(""), flat(cut(body, start, end)), F.when(end < F.length(body), "…").otherwise(""))


def excerpt(body: Column, first: int, then: int) -> Column:
    return F.substring(flat(F.substring(body, 1, first)), 1, then)


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters, repeats kept; none of a text shorter than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def name_key(name: Column) -> Column:
    """A document's name without white space, middle dots and joining words."""
    return F.regexp_replace(F.regexp_replace(name, rf"(?U)[\s{MIDDLE_DOTS}]+", ""), JOINING_WORDS, "")


def python_name_key(name: str) -> str:
    return re.sub(JOINING_WORDS, "", re.sub(rf"[\s{MIDDLE_DOTS}]+", "", nfc(name)))


def source_match(query: str | None, name: Column) -> Column:
    """Whether a name is meant by a query: it holds the query, or all its words of two letters or more, or its key the query's."""
    q = nfc(query or "").strip()
    if not q:
        return F.lit(True)
    words = [w for w in q.split() if len(w) >= 2]
    out = F.contains(name, F.lit(q))
    if words:
        every = F.contains(name, F.lit(words[0]))
        for w in words[1:]:
            every = every & F.contains(name, F.lit(w))
        out = out | every
    key = python_name_key(q)
    return out | F.contains(name_key(name), F.lit(key)) if key else out


# Signs that titles are compared without, the least share of common letter pairs, the form of a date.
TITLE_SIGNS = r"""(?U)[\s·․.,'"()\[\]「」]"""
LIKE_ENOUGH = 0.4
DATE = r"(?U)(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})"


def title_key(title: Column) -> Column:
    return F.regexp_replace(title, TITLE_SIGNS, "")


def title_matches(cited: Column, actual: Column) -> Column:
    """Whether a cited title is the actual one: equal or part of it, or similar enough in letter pairs."""
    c, a = title_key(cited), title_key(actual)
    similar = jaccard(F.array_distinct(bigrams(c)), F.array_distinct(bigrams(a))) >= LIKE_ENOUGH
    short = (F.length(c) < 2) | (F.length(a) < 2)
    return (F.length(c) == 0) | (F.length(a) == 0) | F.contains(a, c) | short | F.coalesce(similar, F.lit(True))


def revision_date(revision: Column) -> Column:
    """(y, m, d) of the first date, not checked against a calendar; null if there is none."""
    part = lambda i: F.regexp_extract(revision, DATE, i).try_cast("int")
    return F.when(F.regexp_like(revision, F.lit(DATE)), F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d")))


def script_label(text: Column) -> Column:
    """ko if any Hangul is there, else en for a Latin letter, else other; null for a blank text."""
    return (
        F.when(F.length(strip(F.coalesce(text, F.lit("")))) == 0, F.lit(None).cast("string"))
        .when(F.regexp_like(text, F.lit("[가-힣ᄀ-ᇿ㄰-㆏]")), "ko")
        .when(F.regexp_like(text, F.lit("[A-Za-z]")), "en")
        .otherwise("other")
    )


def python_script_label(text: str | None) -> str | None:
    """:func:`script_label` of one text."""
    if not (text or "").strip():
        return None
    return "ko" if re.search("[가-힣ᄀ-ᇿ㄰-㆏]", text) else "en" if re.search("[A-Za-z]", text) else "other"


# Endings that name a document's type, tried in this order.
TYPE_ENDINGS = ("시행세칙", "세칙", "규정", "지침", "기준", "정관", "규칙", "매뉴얼")


def ending_label(title: Column, endings: tuple[str, ...] = TYPE_ENDINGS, otherwise: str = "기타") -> Column:
    out = F.lit(otherwise)
    for ending in reversed(endings):
        out = F.when(F.endswith(strip(title), F.lit(ending)), ending).otherwise(out)
    return out


def safe_filename(title: Column) -> Column:
    return strip(F.regexp_replace(F.translate(title, "/\\:", "---"), r"(?U)\s+", " "))


def number_key(number: Column) -> Column:
    """An attachment's number for comparison."""
    return F.replace(F.regexp_replace(number, r"(?U)\s+", ""), F.lit("서식"), F.lit(""))


def article_name(no: Column, sub: Column) -> Column:
    return F.concat(F.lit("제"), no.cast("string"), F.lit("조"), F.when(sub != 0, F.concat(F.lit("의"), sub.cast("string"))).otherwise(""))


def parse_article_token(token: str) -> tuple[int, int] | None:
    """(number, branch) of "제15조의2", "15의2" or "15"; else of the first article named; else None."""
    t = nfc(token).strip()
    m = re.fullmatch(r"\s*(?:제)?(\d+)조?(?:의(\d+))?\s*", t) or re.search(r"제(\d+)조(?:의(\d+))?", t)
    return (int(m[1]), int(m[2] or 0)) if m else None


# What opens a paragraph: circled numbers, "1." or "1의2)", "가.", and attachment marks.
PARAGRAPH = rf"[①-⑳]|\d+(?:{BLANK}*의{BLANK}*\d+)?[\.\)]{BLANK}|[가-힣]\.{BLANK}|\[(?:별표|별지|서식)"


def reflow(text: Column) -> Column:
    """Lines joined into paragraphs: a line goes on the one before unless it opens a paragraph; blank lines part them, one at a time."""
    lines = F.regexp_replace(text, rf"(?U){BLANK}*\n{BLANK}*", "\n")
    lines = F.regexp_replace(strip(lines), r"(?U)\n{2,}", "\n\n")
    joined = F.regexp_replace(lines, rf"(?U)(?<!\n)\n(?!\n|{PARAGRAPH})", " ")
    return F.regexp_replace(joined, "[ \t]+", " ")
