"""Regulation Markdown into article and attachment rows, by windows over lines.

Lines are classed by patterns; openings (an article, an attachment, a heading that only
closes) get running numbers within a file; a body line belongs to the opening before it.
What a row says of its document (chapter, source, revision) is the state just before the
line that closes it. So a plain chapter line, which closes nothing, names the chapter of
the article that is still open, as the format has always been read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_name, reflow, strip

# The formats of titles, chapters, articles, supplementary provisions and attachments.
TITLE = r"(?U)^# (.+?)(?:\s*\(([^()]*(?:개정|제정|호)[^()]*)\))?\s*$"
CHAPTER_HEADING = r"(?U)^## (제\d+(?:편|장|절).+?)\s*$"
ARTICLE_HEADING = r"(?U)^#{2,3} (제(\d+)조(?:의(\d+))?)\s*\((.+?)\)\s*(.*)$"
CHAPTER_LINE = r"(?U)^\s*(제\d+(?:편|장|절))\s+(\S.{0,40})\s*$"
ARTICLE_LINE = r"(?U)^\s*제(\d+)조(?:의(\d+))?\s*\(([^)]+)\)\s*(.*)$"
SUPPLEMENT = r"(?U)^\**\s*부\s*칙(?:\s*<|\s*\**\s*$|\s)"
ATTACHMENT = r"(?U)\[\s*(별표|별지)\s+((?:제\s*)?[\d\-]+(?:호)?\s*(?:서식)?)\s*\]\s*"
LONGEST_CHAPTER = 30
SENTENCE_ENDS = ("다.", "한다.", "있다.", "없다.")

#: Where Python's splitlines cuts.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def attachment_headers(df: DataFrame, line: str = "line") -> DataFrame:
    """One row per attachment mark of a line: adds (mark_no, kind, number, label, title, before).

    ``before`` is the text ahead of the line's first mark; a mark's title is the text up to the next.
    """
    marks = F.regexp_extract_all(line, F.lit(ATTACHMENT), F.lit(0))
    pieces = F.split(F.col(line), ATTACHMENT)
    # a mark with the text after it, so a line with very many marks isn't copied for each of them
    titled = F.arrays_zip(marks.alias("mark"), F.slice(pieces, F.lit(2), F.greatest(F.size(marks), F.lit(0))).alias("title"))
    # the text ahead is cut below the explode, so once a line
    out = df.withColumn("before", strip(F.get(pieces, F.lit(0)))).select("*", F.posexplode(titled).alias("mark_no", "_m"))
    kind, number = F.regexp_extract("_m.mark", ATTACHMENT, 1), F.regexp_extract("_m.mark", ATTACHMENT, 2)
    label = F.concat(F.lit("["), F.regexp_replace(strip(F.concat_ws(" ", kind, number)), r"(?U)\s+", " "), F.lit("]"))
    return out.withColumns(
        {"kind": kind, "number": F.regexp_replace(number, r"(?U)\s+", ""), "label": label, "title": strip(F.col("_m.title"))}
    ).drop("_m")


def _part(pattern: str, i: int) -> Column:
    return F.regexp_extract("line", pattern, i)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def classed_lines(files: DataFrame) -> DataFrame:
    """(category, file, stem, line_no, line, what) of a table (category, file, stem, text): the first class that fits a line."""
    lines = files.select("category", "file", "stem", F.posexplode(F.split("text", LINE_END)).alias("line_no", "line"))
    bare = strip(F.col("line"))
    like = lambda p, c=F.col("line"): F.regexp_like(c, F.lit(p))
    sentence = F.lit(False)
    for end in SENTENCE_ENDS:
        sentence = sentence | F.endswith(bare, F.lit(end))
    indent = F.length("line") - F.length(F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+", ""))
    what = (
        F.when(F.startswith("line", F.lit("# ")), "title")
        .when(like(SUPPLEMENT, bare), "supplement")
        .when(like(ATTACHMENT), "attachment")
        .when(like(ARTICLE_HEADING), "heading")
        .when(F.startswith("line", F.lit("## ")), "chapter")
        .when(F.startswith("line", F.lit("### ")), "close")
        .when(like(CHAPTER_LINE) & (F.length(bare) <= LONGEST_CHAPTER) & ~sentence, "chapter line")
        .when(like(ARTICLE_LINE) & (~F.startswith("line", F.lit(" ")) | (indent <= 2)), "article line")
        .otherwise("body")
    )
    return lines.withColumn("what", what)


def parse_regulations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, attachments) of a table (category, file, stem, text), without item_index.

    One shuffle by file, then windows and one aggregate in the same partitioning. Articles have
    ``order`` and attachments ``order``, their places in the file.
    """
    lines = classed_lines(files)
    marks = attachment_headers(lines.filter(F.col("what") == "attachment"))
    ahead = marks.filter((F.col("mark_no") == 0) & (F.col("before") != "")).select(
        "category", "file", "stem", "line_no", F.lit(-1).alias("mark_no"), F.col("before").alias("line"), F.lit("ahead").alias("what")
    )
    rows = lines.filter(F.col("what") != "attachment").withColumn("mark_no", F.lit(0))
    rows = rows.unionByName(ahead, allowMissingColumns=True).unionByName(marks.drop("before"), allowMissingColumns=True)
    heading, plain = F.col("what") == "heading", F.col("what") == "article line"
    article, attachment = heading | plain, F.col("what") == "attachment"
    opens = article | attachment | F.col("what").isin("chapter", "close")
    in_order = Window.partitionBy("file").orderBy("line_no", "mark_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    named = F.regexp_like("line", F.lit(TITLE)) & (F.col("what") == "title")
    long_chapter = F.when(F.regexp_like("line", F.lit(CHAPTER_HEADING)), strip(_part(CHAPTER_HEADING, 1))).otherwise(strip(F.substring("line", 4, 1 << 30)))
    chapter = F.when(F.col("what") == "chapter", long_chapter).when(
        F.col("what") == "chapter line", F.concat_ws(" ", _part(CHAPTER_LINE, 1), strip(_part(CHAPTER_LINE, 2)))
    )
    state = rows.withColumns(
        {
            "segment": F.sum(opens.cast("int")).over(so_far),
            "opens": opens,
            "ends_article": opens & ~attachment,
            "supplementary": F.max((F.col("what") == "supplement").cast("int")).over(so_far) == 1,
            "chapter_now": F.coalesce(F.last(chapter, ignorenulls=True).over(so_far), F.lit("")),
            "source_now": F.coalesce(F.last(F.when(named, strip(_part(TITLE, 1))), ignorenulls=True).over(so_far), F.col("stem")),
            "revision_now": F.coalesce(F.last(F.when(named, strip(_part(TITLE, 2))), ignorenulls=True).over(so_far), F.lit("")),
        }
    )
    # the state just before the next line that closes, or at the file's end
    # the nearest later line is the last one of those before in reverse order: a running frame
    back = Window.partitionBy("file").orderBy(F.desc("line_no"), F.desc("mark_no")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("line_no", "mark_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now = F.struct("chapter_now", "source_now", "revision_now")
    state = state.withColumn("_before", F.lag(now).over(in_order)).withColumn("_last", F.last(now).over(whole))
    closing = lambda flag: F.coalesce(F.last(F.when(F.col(flag), F.col("_before")), ignorenulls=True).over(back), F.col("_last"))
    state = state.withColumn("at_close", F.when(article, closing("ends_article")).otherwise(closing("opens")))
    rest = strip(F.when(heading, _part(ARTICLE_HEADING, 5)).when(plain, _part(ARTICLE_LINE, 4)))
    text_line = F.when(F.col("what") == "body", strip(F.col("line"))).when(F.col("what") == "ahead", F.col("line")).when(article & (rest != ""), rest)
    state = state.withColumn("_text", F.when(text_line.isNotNull(), F.struct("line_no", "mark_no", text_line.alias("t"))))
    opening = F.struct(
        "what", "line", "kind", "number", "label", "title", "supplementary", "at_close", F.struct("line_no", "mark_no").alias("order")
    )
    grouped = state.groupBy("category", "file", "segment").agg(
        F.first(F.when(F.col("opens"), opening), ignorenulls=True).alias("o"),
        # text ahead of a mark goes to an attachment that is open, never to an article
        F.array_sort(F.collect_list(F.when(F.col("what") != "ahead", F.col("_text")))).alias("own"),
        F.array_sort(F.collect_list("_text")).alias("every"),
    )
    body = lambda c: reflow(F.array_join(F.transform(c, lambda x: x["t"]), "\n"))
    common = ["category", F.col("o.at_close.source_now").alias("source"), F.col("o.at_close.revision_now").alias("revision"), "file", F.col("o.order").alias("order")]
    items = grouped.filter(F.col("o").isNotNull())
    from_heading = F.col("what") == "heading"
    found = items.filter(F.col("o.what").isin("heading", "article line")).select(
        *common, F.col("o.at_close.chapter_now").alias("chapter"), F.col("o.line").alias("line"), F.col("o.what").alias("what"),
        F.col("o.supplementary").alias("is_supplementary"), body("own").alias("body"),
    )
    pick = lambda h, p: F.when(from_heading, _part(ARTICLE_HEADING, h)).otherwise(_part(ARTICLE_LINE, p))
    articles = found.withColumns({"article_no": _number(pick(2, 1)), "article_sub": _number(pick(3, 2)), "article_title": strip(pick(4, 3))})
    articles = articles.select(
        "category", "source", "revision", "file", "chapter", article_name(F.col("article_no"), F.col("article_sub")).alias("article"),
        "article_no", "article_sub", "article_title", "body", "is_supplementary", "order",
    )
    attached = items.filter(F.col("o.what") == "attachment").select(
        *common, F.col("o.kind").alias("kind"), F.col("o.label").alias("label"), F.col("o.number").alias("number"), F.col("o.title").alias("title"), body("every").alias("body")
    )
    deleted = F.regexp_like("body", F.lit(r"(?U)<\s*삭제\s*[^>]*>")) | F.contains("title", F.lit("삭제"))
    return articles, attached.withColumn("deleted", deleted)


#: Ranges of file names that are numbered side by side.
RANGES = 256


def numbered(rows: DataFrame, key: str = "file") -> DataFrame:
    """Adds item_index, the place by (file, order).

    Counts per file come first. Files are then counted up within ranges of names, whose bounds are
    at most RANGES - 1 names taken by hash, and the ranges among themselves, so no task holds all files.
    """
    counts = rows.groupBy(key).count()
    bounds = sorted(r[0] for r in counts.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(RANGES - 1).select(key).collect())
    own = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    up_to = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = counts.withColumn("_range", F.coalesce(own, F.lit(0)))
    sums = ranged.groupBy("_range").agg(F.sum("count").alias("count")).select("_range", up_to(Window.orderBy("_range")).alias("_first"))
    starts = ranged.withColumn("_within", up_to(Window.partitionBy("_range").orderBy(key))).join(F.broadcast(sums), "_range")
    starts = starts.select(F.col(key).alias("_key"), (F.col("_first") + F.col("_within")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("order")) - 1
    placed = rows.withColumn("_rank", rank).join(starts, F.col(key).eqNullSafe(F.col("_key")))
    return placed.withColumn("item_index", (F.col("_before") + F.col("_rank")).cast("long")).drop("_before", "_rank", "_key", "order")
