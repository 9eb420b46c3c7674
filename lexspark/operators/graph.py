"""The citation graph: what an article's text cites, and who cites it.

All edges are derived in one pass over the bodies; one article's references read its body only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import article_name, context, cut, excerpt, flat
from ..sources.tables import written
from .lookup import select_source
from .names import contained, name_ends

# A plain article mention, a quoted name, the endings of unquoted names and how many words they have.
MENTION = r"제(\d+)조(?:의(\d+))?"
QUOTED_NAME = re.compile(r"「([^」\n]{2,40}?)」$")
ENDINGS = "규정|법률|법|지침|세칙|정관|매뉴얼"
NAME_WORDS = 7

#: Letters of the longest quoted name with its brackets.
QUOTED_LENGTH = 42


def last_words(text: str, most: int) -> list[str]:
    """Up to ``most`` Hangul words at a text's end, one blank between two, the last one last; each with the blank after it."""
    out: list[str] = []
    end = len(text)
    while end and len(out) < most:
        start = end - bool(out)  # the blank before the word found last
        if out and not text[start].isspace():
            break
        first = start
        while first and "가" <= text[first - 1] <= "힣":
            first -= 1
        if first == start:
            break
        out.append(text[first:end])
        end = first
    return out[::-1]


def mentions(body: str) -> list[tuple[int, int, int, int, int, str | None]]:
    """(start, end, place of the article, number, branch, cited name or None) of every article mention, in order.

    The name is read backwards from each mention, from no further than the one before: a
    quoted name, or up to seven Hangul words the last of which has a known ending, as many as
    there are. This takes time in proportion to the text, where one pattern for the whole would not.
    """
    out, done = [], 0
    for m in re.finditer(MENTION, body):
        ahead = body[done : m.start()].rstrip()
        name, start = None, m.start()
        quoted = QUOTED_NAME.search(ahead[-QUOTED_LENGTH:]) if ahead.endswith("」") else None
        if quoted:
            name, start = quoted[1], done + len(ahead) - len(quoted[0])
        elif re.search(rf"(?:{ENDINGS})$", ahead):
            words = last_words(ahead, NAME_WORDS)
            if words and not re.fullmatch(ENDINGS, words[-1]):  # an ending of its own is a word more
                words = words[-(NAME_WORDS - 1) :]
            found = "".join(words)
            if words and not re.fullmatch(ENDINGS, found):  # a name is more than its ending
                name, start = found, done + len(ahead) - len(found)
        out.append((start, m.end(), m.start(), int(m[1]), int(m[2] or 0), name and re.sub(r"\s+", "", name)))
        done = m.end()
    return out


FOUND = "item_index long, source string, place int, start int, end int, mention int, no int, sub int, name string, before string"

#: What a pattern with Unicode classes takes for white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def mention_table(articles: DataFrame) -> DataFrame:
    """(item_index, source, place, start, end, mention, no, sub, name, before) of every mention in every body.

    ``before`` is the character ahead of the mention, empty at the start.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (index, source, place, *found[:5], found[5], body[found[2] - 1 : found[2]])
                for index, source, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for place, found in enumerate(mentions(body or ""))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    return articles.select(F.col("item_index").cast("long"), "source", "body").mapInArrow(find, FOUND)


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
NAMES = [c.split()[0] for c in FOUND.split(", ")]
TYPES = [KINDS[c.split()[1]] for c in FOUND.split(", ")]


def first_articles(articles: DataFrame) -> DataFrame:
    """Each (source, number, branch)'s first row in index order, supplementary or not, as an aggregate."""
    keys = ["source", "article_no", "article_sub"]
    rest = [c for c in articles.columns if c not in keys]
    return articles.groupBy(*keys).agg(F.min_by(F.struct(*rest), "item_index").alias("_first")).select(*keys, "_first.*")


def outgoing_references(articles: DataFrame, strict: bool = False, citing: DataFrame | None = None) -> DataFrame:
    """(item_index, place, scope, citation, article_title, snippet): what every article's body cites, each target once.

    With ``citing``, some rows of the table, only their bodies are read for mentions.

    scope is cross_regulation (a name that matches a known source, which it holds or is held
    by, the longest first), external, or same_regulation (a bare mention). A name cited again
    is dropped, and its bare mention then counts as one of the own document, as has been the
    rule; ``strict`` leaves it out.
    """
    citing = articles if citing is None else citing
    found = mention_table(citing)
    once = Window.partitionBy("item_index", "name", "no", "sub").orderBy("place")
    named = found.filter(F.col("name").isNotNull()).withColumn("_nth", F.row_number().over(once))
    sources = articles.select(F.col("source").alias("known")).distinct()
    holds = contained(sources, "known", named, "name").unionByName(contained(named, "name", sources, "known")).select("known", "name").distinct()
    match = named.filter("_nth = 1").join(holds, "name", "left")
    longest = F.max_by("known", F.struct(F.length("known"), "known"))
    match = match.groupBy("item_index", "place", "name", "no", "sub").agg(longest.alias("known"))
    shown = articles.select("source", "article_no", "article_sub", "item_index", "article", "article_title", excerpt(F.col("body"), 200, 120).alias("t_excerpt"))
    targets = first_articles(shown).select(
        F.col("source").alias("t_source"), F.col("article_no").alias("t_no"), F.col("article_sub").alias("t_sub"), F.col("article").alias("t_article"),
        F.col("article_title").alias("t_title"), "t_excerpt",
    )
    at = (F.col("known") == F.col("t_source")) & (F.col("no") == F.col("t_no")) & (F.col("sub") == F.col("t_sub"))
    cross = match.join(targets, at, "left")
    cited = F.col("t_article").isNotNull()
    external = F.concat_ws(" ", "name", article_name(F.col("no"), F.col("sub")))
    cross = cross.select(
        "item_index", "place", F.lit(0).alias("pass"), F.when(cited, "cross_regulation").otherwise("external").alias("scope"),
        F.when(cited, F.concat_ws(" ", "t_source", "t_article")).otherwise(external).alias("citation"), F.col("t_title").alias("article_title"),
        F.when(cited, F.col("t_excerpt")).alias("snippet"),
    )
    bare = found.filter(F.col("name").isNull())
    if not strict:
        bare = bare.unionByName(named.filter("_nth > 1").drop("_nth"))
    bare = bare.filter(~F.regexp_like("before", F.lit(r"(?U)[가-힣A-Za-z\w]")))
    own = citing.select("item_index", F.col("article_no").alias("o_no"), F.col("article_sub").alias("o_sub"))
    bare = bare.join(own, "item_index").filter((F.col("no") != F.col("o_no")) | (F.col("sub") != F.col("o_sub")))
    bare = bare.groupBy("item_index", "source", "no", "sub").agg(F.min("place").alias("place"))
    same = bare.join(targets, (F.col("source") == F.col("t_source")) & (F.col("no") == F.col("t_no")) & (F.col("sub") == F.col("t_sub"))).select(
        "item_index", "place", F.lit(1).alias("pass"), F.lit("same_regulation").alias("scope"), F.concat_ws(" ", "t_source", "t_article").alias("citation"),
        F.col("t_title").alias("article_title"), F.col("t_excerpt").alias("snippet"),
    )
    return cross.unionByName(same)


def incoming_references(articles: DataFrame, target: DataFrame) -> DataFrame:
    """(item_index, scope, citation, article_title, snippet): articles that cite the one row of ``target``.

    In the target's own document a bare mention counts; elsewhere its source's name directly before the mention.
    """
    t = target.select(F.col("item_index").alias("t_index"), F.col("source").alias("t_source"), F.col("article_no").alias("t_no"), F.col("article_sub").alias("t_sub"))
    rows = articles.join(F.broadcast(t), F.col("item_index") != F.col("t_index"))
    sub = F.when(F.col("t_sub") == 0, "(?!의\\d)").otherwise(F.concat(F.lit("의"), F.col("t_sub").cast("string"), F.lit("(?!\\d)")))
    name = F.concat(F.lit("제0*"), F.col("t_no").cast("string"), F.lit("조"), sub)
    bare = F.concat(F.lit("(?U)(?<![가-힣A-Za-z\\w])"), name)
    quoted = F.concat(F.lit("(?U)\\Q"), F.col("t_source"), F.lit("\\E\\s*"), name)
    own = F.col("source") == F.col("t_source")
    pattern = F.when(own, bare).otherwise(quoted)
    # the cheap test first: WHEN keeps the order
    cites = F.when(own | F.contains("body", "t_source"), F.regexp_like("body", pattern)).otherwise(False)
    # places are counted in characters, as lengths are; those of patterns would count some twice
    found = rows.filter(cites).withColumn("_at", F.length(F.split("body", pattern, 2)[0]) + 1)
    return found.select(
        "item_index", F.when(own, "same_regulation").otherwise("cross_regulation").alias("scope"), F.concat_ws(" ", "source", "article").alias("citation"), "article_title",
        context(F.col("body"), F.col("_at") - 1).alias("snippet"),
    )


#: Buckets of a stored edge table; one target's edges are in one of them.
EDGE_BUCKETS = 64
EDGES = "t_source string, t_no int, t_sub int, item_index long, scope string, citation string, article_title string, at int, snippet string"


#: Characters on either side of a place that a snippet shows.
CONTEXT = 60

MENTIONED = "item_index long, source string, no int, sub int, at int, before string, ahead string, end int, shift int, around string, length int"


def known_mentions(articles: DataFrame, longest: int) -> DataFrame:
    """MENTIONED of every mention in every body, in one pass.

    ``ahead`` is the text before a mention up to ``end``, where the white space before the mention starts,
    ``longest`` characters of it. ``around`` is all that a snippet of the mention, or of a name ahead of
    it, can show, and starts at ``shift``, so bodies go no further than this.
    """
    names, kinds = zip(*(c.split() for c in MENTIONED.split(", ")), strict=True)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for index, source, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in re.finditer(MENTION, body or "", re.ASCII):
                    no, sub, start = int(m[1]), int(m[2] or 0), m.start()
                    end = start
                    while end and body[end - 1] in WHITE:
                        end -= 1
                    shift = max(0, end - longest - CONTEXT)
                    if max(no, sub) < 1 << 31:  # no article has a larger number
                        rows.append((index, source, no, sub, start, body[start - 1 : start], body[max(0, end - longest) : end], end, shift, body[shift : start + CONTEXT], len(body)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, t in zip(columns, kinds, strict=True)], list(names))

    return articles.select(F.col("item_index").cast("long"), "source", "body").mapInArrow(find, MENTIONED)


def edge_table(articles: DataFrame) -> DataFrame:
    """EDGES: who cites whom, both directions of all references, from one pass over the bodies.

    A row says that the article ``item_index`` (shown as ``citation``) cites the article ``t_no``, ``t_sub`` of the source
    ``t_source``, first at ``at``: a bare mention in the own source, elsewhere the source's name directly before
    the mention, as :func:`incoming_references` has it for one target. Only existing targets count. An
    article that cites its own number is there only if another row has that number too. Names are found by their automaton at the end of the text ahead of a
    mention, so the table's cost grows with the mentions, whatever the number of sources.
    """
    sources = articles.select(F.col("source").alias("t_source")).filter(F.col("t_source") != "").distinct()
    longest = articles.agg(F.max(F.length("source"))).first()[0] or 0
    found = written(known_mentions(articles, longest), "mentions")
    targets = articles.select(F.col("source").alias("t_source"), F.col("article_no").alias("t_no"), F.col("article_sub").alias("t_sub")).filter(F.col("t_source") != "")
    # an article that cites its own numbers cites another row only if there is one
    targets = targets.groupBy("t_source", "t_no", "t_sub").agg(F.count("*").alias("_rows"))
    keys = ["item_index", "source", F.col("no").alias("t_no"), F.col("sub").alias("t_sub")]
    same = found.filter(~F.regexp_like("before", F.lit(r"(?U)[가-힣A-Za-z\w]")))
    same = same.select(*keys, F.col("source").alias("t_source"), F.col("at").alias("place"), "shift", "around", "length")
    ahead = found.filter(F.col("ahead") != "").select("ahead").distinct()
    cross = found.join(name_ends(ahead, "ahead", sources, "t_source"), "ahead").filter(F.col("t_source") != F.col("source"))
    cross = cross.select(*keys, "t_source", (F.col("end") - F.length("t_source")).alias("place"), "shift", "around", "length")
    both = same.select(*same.columns, F.lit("same_regulation").alias("scope")).unionByName(cross.select(*cross.columns, F.lit("cross_regulation").alias("scope")))
    first = both.groupBy("t_source", "t_no", "t_sub", "item_index", "scope").agg(F.min(F.struct("place", "shift", "around", "length")).alias("f"))
    joined = first.join(targets, ["t_source", "t_no", "t_sub"])
    citing = articles.select("item_index", F.col("source").alias("_own"), F.col("article_no").alias("_no"), F.col("article_sub").alias("_sub"), F.concat_ws(" ", "source", "article").alias("citation"), "article_title")
    joined = joined.join(citing, "item_index")
    itself = (F.col("_own") == F.col("t_source")) & (F.col("_no") == F.col("t_no")) & (F.col("_sub") == F.col("t_sub"))
    return joined.filter(~(itself & (F.col("_rows") == 1))).select(
        "t_source", "t_no", "t_sub", "item_index", "scope", "citation", "article_title", F.col("f.place").alias("at"), _cut_snippet().alias("snippet")
    )


def _cut_snippet() -> Column:
    """:func:`..functions.text.context` of the whole body, from the part that was kept."""
    place, length = F.col("f.place"), F.col("f.length")
    start, end = F.greatest(place - CONTEXT, F.lit(0)), F.least(length, place + CONTEXT)
    part = flat(cut(F.col("f.around"), start - F.col("f.shift"), end - F.col("f.shift")))
    return F.concat(F.when(start > 0, "…").otherwise(""), part, F.when(end < length, "…").otherwise(""))


def write_edges(edges: DataFrame, path: str) -> None:
    """Store an edge table in a folder a bucket of targets, each sorted by target."""
    bucket = F.pmod(F.xxhash64("t_source", "t_no", "t_sub"), F.lit(EDGE_BUCKETS)).cast("int")
    stored = edges.withColumn("bucket", bucket).repartition("bucket", "t_source", "t_no", "t_sub").sortWithinPartitions("bucket", "t_source", "t_no", "t_sub")
    stored.write.partitionBy("bucket").parquet(path)


def edges_of(spark: SparkSession, path: str, source: str, no: int, sub: int) -> DataFrame:
    """The stored edges to one target: a read of its bucket, and of the row groups that may have it."""
    asked = spark.range(1).select(F.pmod(F.xxhash64(F.lit(source), F.lit(no), F.lit(sub)), F.lit(EDGE_BUCKETS)).cast("int")).first()[0]
    stored = spark.read.schema(f"{EDGES}, bucket int").parquet(path)
    return stored.filter((F.col("bucket") == asked) & (F.col("t_source") == source) & (F.col("t_no") == no) & (F.col("t_sub") == sub)).drop("bucket")


def reference_target(articles: DataFrame, source: str, no: int, sub: int) -> DataFrame:
    """The one row that a reference query is about, main text before supplementary."""
    found = select_source(articles, source).filter((F.col("article_no") == no) & (F.col("article_sub") == sub))
    return found.orderBy("is_supplementary", "item_index").limit(1)


# How a flowchart is written.
CHART, NODE, EDGE = "flowchart LR", '  {}["{}"]', "  {} --> {}"
TARGET_STYLE = "  style {} fill:#dbeafe,stroke:#2563eb"
LABEL_SIGNS = str.maketrans({'"': "'", "[": "(", "]": ")"})


def mermaid(target: str, incoming: list[str], outgoing: list[str]) -> str:
    """A flowchart of at most a page of references: the nodes, named by first use, then the edges."""
    edges = [(label, target) for label in incoming] + [(target, label) for label in outgoing]
    names = {label: f"n{i}" for i, label in enumerate(dict.fromkeys([target, *incoming, *outgoing]))}
    nodes = [NODE.format(name, label.translate(LABEL_SIGNS)) for label, name in names.items()]
    return "\n".join([CHART, *nodes, TARGET_STYLE.format(names[target]), *(EDGE.format(names[a], names[b]) for a, b in edges)])
