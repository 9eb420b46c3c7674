"""Operator 6: quality rules as a short-circuit cascade. DataFrame functions only."""

from __future__ import annotations

import contextlib
import hashlib
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

#: The sample on which costs and selectivities are estimated: so many rows of so many of the input's
#: files, texts of up to so many bytes. It only orders the rules, and never reaches the driver.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_TEXT_BYTES = 2000, 8, 1 << 16

#: Times that a rule's cost is measured; the least counts.
MEASURED = 3


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document that the rule rejects; null counts as not rejected."""

    name: str
    fails: Column


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null or blank text: no words."""
    return F.array_remove(F.split(without(text, WHITE[1:], " "), " "), "")


WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(text: Column, letters: str, by: str = "") -> Column:
    """The text, empty if null, with each of some ASCII characters replaced: a byte search each, faster than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in letters:
        out = F.replace(out, F.lit(c), F.lit(by))
    return out


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row and never copied into later expressions.

    The optimizer moves a filter's condition through projections by substitution, so
    an array that a lambda refers to would be built anew for each element. A
    generator over one row's values stands between.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def word_chars(text: Column) -> Column:
    return F.length(without(text, WHITE)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) - F.length(without(text, SYMBOLS))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs).

    n_repeat_words counts words in a 3-word window found at least twice in the text.
    Windows are compared as 64-bit hashes within one text; sorting (hash, place)
    pairs puts equal ones side by side, and nothing leaves its row.

    A null text counts as empty: all five are 0. A very long text is one row's
    arrays, of a size in proportion to it.
    """
    t = F.col(text)
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")  # columns of these names are replaced
    step = hold(docs, _hashes=F.transform(words_of(t), lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    window = lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    windows = F.transform(F.slice("_hashes", 1, F.greatest(n - 2, F.lit(0))), window)
    step = hold(step, _windows=F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    # Sorted (hash, place) pairs only where some window is repeated at all.
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = hold(step, _pairs=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs))
    same = lambda p, i: (F.get("_pairs", i - 1)["h"] == p["h"]) | (F.get("_pairs", i + 1)["h"] == p["h"])
    places = F.transform(F.filter("_pairs", lambda p, i: F.coalesce(same(p, i), F.lit(False))), lambda p: p["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))
    step = hold(
        step,
        n_words=n.cast("long"),
        word_chars=word_chars(t),
        n_symbols=n_symbols(t),
        n_dup_lines=n_dup_lines(t),
        n_repeat_words=F.when(F.col("_pairs").isNull(), 0).otherwise(covered).cast("long"),
    )
    return step.drop("_hashes", "_windows", "_pairs")


def n_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{CAPITALS}]+", ""))


def n_lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n"))


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules beside the base ones, on the columns of :func:`base_stats` and, where those don't do, on the text.

    All in whole numbers, so SQL agrees exactly. Each has a wide margin: running prose passes all of them.
    """
    c = F.col
    return [
        Rule("word_length", (c("word_chars") > 12 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        Rule("symbols", 100 * c("n_symbols") > 25 * c("n_words")),
        Rule("dup_lines", 100 * c("n_dup_lines") > 30 * n_lines(c(text))),
        Rule("shouting", 100 * n_upper(c(text)) > 40 * c("word_chars")),
    ]


def text_rules(text: str = "text", words: str = "words") -> list[Rule]:
    """The same rules and the base's least number of words, on the text itself and its number of words, so that a rule not reached is not computed."""
    t, n = F.col(text), F.col(words)
    return [
        Rule("few_words", n < 50),
        Rule("word_length", (word_chars(t) > 12 * n) | (word_chars(t) < 2 * n)),
        Rule("symbols", 100 * n_symbols(t) > 25 * n),
        Rule("dup_lines", 100 * n_dup_lines(t) > 30 * n_lines(t)),
        Rule("shouting", 100 * n_upper(t) > 40 * word_chars(t)),
    ]


def sample_of(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text) of some rows, written: those of the least hashes in files that are chosen by a hash of their names.

    Only the chosen files are read, where the table is one read of files. Any other table (a union, a
    join, rows that were made) has no one file name a row, and is sampled as a whole.
    Texts are taken whole, those of over SAMPLE_TEXT_BYTES left out.
    """
    files = docs.inputFiles()
    some = docs
    if len(files) > SAMPLE_FILES:
        names = {f.rpartition("/")[2] for f in files}
        chosen = sorted(names, key=lambda f: hashlib.md5(f.encode()).digest())[:SAMPLE_FILES]
        with contextlib.suppress(AnalysisException):  # no file name, or several
            some = docs.filter(F.col("_metadata.file_name").isin(chosen))
    some = some.select(F.col(text).alias(text)).filter(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    return materialize(some.orderBy(F.xxhash64(text)).limit(rows), "rule-sample")


def order_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejected share per cost, best first, as measured on a bounded, written sample.

    The cost of a rule is what an aggregate over it takes beyond one that only reads the sample, the
    least of some runs, to the next power of two, so that chance seldom decides; ties keep
    the given order. Selectivity is the share of the sample that it rejects. The order
    never changes which documents are kept: a document is kept if no rule rejects it. An empty
    sample keeps the given order.
    """
    columns = [F.bit_xor(F.xxhash64(c)) for c in sample.columns]

    def seconds(*aggregates: Column) -> tuple[float, int, int]:
        best, row = float("inf"), None
        for _ in range(MEASURED):
            began = time.perf_counter()
            row = sample.agg(F.count("*"), *columns, *aggregates).first()
            best = min(best, time.perf_counter() - began)
        return best, row[0], row[-1] or 0

    read, rows, _ = seconds()
    if not rows:
        return list(rules)
    rated = []
    for place, rule in enumerate(rules):
        taken, _, rejected = seconds(F.sum(F.coalesce(rule.fails, F.lit(False)).cast("long")))
        cost = math.ceil(math.log2(max(taken - read, LEAST_COST) / LEAST_COST))
        rated.append((-rejected / 2**cost, place, rule))
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


#: Differences in seconds below this are not told apart.
LEAST_COST = 0.02


def cascade(docs: DataFrame, rules: Sequence[Rule], verdict: str = "failed_rule", when: Column | None = None) -> DataFrame:
    """Adds the name of the first rule, in the given order, that rejects a row; null: none does.

    One CASE expression: a branch is evaluated only if those before it were false, and none where
    ``when`` isn't true. A rule that is null for a row (a null column) doesn't reject it.
    """
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        out = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return docs.withColumn(verdict, out if when is None else F.when(when, out))


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All counts of every document, the base verdict and the cascade's.

    The counts are wanted of every document; the rules beside them are reached only by documents that
    the base passes, in the order measured on a sample that has the counts too.
    Empty and null texts have no words, so they fail. Repeated rows are judged alike, a null key
    stays null, and a very long text is one row.
    """
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    with scratch(docs.sparkSession):
        sample = materialize(base_stats(sample_of(docs, text, sample_rows), text).filter(~base_failed), "rule-sample-counts")
        rules = order_rules(sample, standard_rules(text))
    judged = cascade(base_stats(docs.select(key, text), text), rules, when=~base_failed)
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("failed_rule").isNull()).alias("kept"),
    )


def quality_filter(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, columns unchanged, whatever their names.

    The rules run on the text itself in the measured order, so a rule after the first that rejects is not
    computed; what needs every word's windows comes last, for the rows those leave. A null or
    blank text has too few words and goes; of rows that repeat all go or stay; a
    very long text is one row.
    """
    counted = lambda df: hold(df, _words=F.size(words_of(F.col("_text"))))
    with scratch(docs.sparkSession):
        sample = sample_of(docs.select(F.col(text).alias("_text")), "_text", sample_rows)
        order = order_rules(materialize(counted(sample), "rule-sample-counts"), text_rules("_text", "_words"))
    held = counted(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")))
    left = cascade(held, order, "_failed").filter(F.col("_failed").isNull())
    repeated = base_stats(left.select("_row", "_text"), "_text")
    return repeated.filter(100 * F.col("n_repeat_words") <= 50 * F.col("n_words")).select("_row.*")
