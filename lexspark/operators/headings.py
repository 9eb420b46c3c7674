"""Converted Markdown brought to the headings that :mod:`.segment` reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# Headings of chapters and articles, and any heading.
CHAPTER = r"(?U)^#{1,4}\s+(제\d+(?:편|장|절)\b.*)$"
ARTICLE = r"(?U)^#{1,4}\s+(제\d+조(?:의\d+)?\s*\(.+)$"
HEADING = r"(?U)^(#{1,6})\s+(.*)$"


def normalize_headings(markdown: Column, title: Column, revision: Column) -> Column:
    """The title first, as the only first-level heading; chapters at level 2, articles at 3, other headings bold.

    Lines with attachment marks stay; headings that repeat the title go. One expression per row.
    """
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")

    def line(x: Column) -> Column:
        s = F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+$", "")
        text = strip(F.regexp_extract(s, HEADING, 2))
        like = lambda p: F.regexp_like(s, F.lit(p))
        return (
            F.when(F.contains(s, F.lit("[별표")) | F.contains(s, F.lit("[별지")), x)
            .when(like(ARTICLE), F.concat(F.lit("### "), strip(F.regexp_extract(s, ARTICLE, 1))))
            .when(like(CHAPTER), F.concat(F.lit("## "), strip(F.regexp_extract(s, CHAPTER, 1))))
            .when(like(HEADING) & (squeezed(text) == squeezed(title)), F.lit(None).cast("string"))
            .when(like(HEADING), F.when(text == "", "").otherwise(F.concat(F.lit("**"), text, F.lit("**"))))
            .otherwise(x)
        )

    head = F.concat(F.lit("# "), title, F.when(F.coalesce(revision, F.lit("")) != "", F.concat(F.lit(" ("), revision, F.lit(" 개정)"))).otherwise(""))
    body = F.filter(F.transform(F.split(markdown, "\n"), line), lambda x: x.isNotNull())
    return F.array_join(F.concat(F.array(head), body), "\n")
