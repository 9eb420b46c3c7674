"""The registered queries: every operator on the driver's tables, with citations, headings and marks written into them where a format needs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, citations, dense, fusion, graph, keyword, lookup, manifest, postings, questions, radar, segment, usage
from ..operators.headings import normalize_headings
from ..operators.names import contained, name_places
from ..schemas import USAGE_EVENT
from ..sources import corpus, listing, sync, tables
from ..streaming import usage_stream
from ..streaming import usage_totals as stored_totals
from .expansion import expand_queries
from .search import all_rows, recall_at_k, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MANY_TOKENS = ["the", "tionble", "der", "que", "and", "ion", "eux", "ado", "sch", "thing", "mente", "est", "iert", "or", "zzz"]
TOKENS = ["the", "tionble", "der", "que"]
FUZZY_TOKENS = ["thonblezz", "quement"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first line is the title, the whole text the body."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_index"), F.col("lang").alias("category"), "source", F.lit("").alias("revision"), F.lit("").alias("chapter"),
        F.lit("").alias("article"), F.split("text", "\n")[0].alias("article_title"), F.col("text").alias("body"),
    )


def attachments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("item_index"), F.lit("en").alias("category"), F.lit("benchmark").alias("source"), F.lit("").alias("revision"), F.lit("별표").alias("kind"),
        F.concat(F.lit("[별표 "), F.col("item_id").cast("string"), F.lit("]")).alias("label"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), F.lit(False).alias("deleted"),
    )


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunk vectors, four to an item."""
    e = table(spark, sf_dir, "embeddings")
    no = (F.col("vec_id") % 4).cast("int")
    return e.select(
        F.lit("article").alias("kind"), F.floor(F.col("vec_id") / 4).alias("item_index"), no.alias("chunk_no"), (no * 320).alias("start"), (no * 320 + 400).alias("end"), "embedding", "label"
    )


def rules_of(spark: SparkSession, sf_dir: str, quoted: bool = False) -> DataFrame:
    """documents as numbered articles that cite: another source's, with or without a title, for each "the", one of their own for each "que"."""
    i = F.col("doc_id")
    nth = lambda shift: F.concat(F.lit("제"), ((i + shift) % 9 + 1).cast("string"), F.when(i % 2 == 0, "조의2").otherwise("조"))
    mark = (" 「src", "」") if quoted else (" src", "")
    named = F.concat(
        F.lit(mark[0]), (i % 25).cast("string"), F.lit(mark[1]), F.when(i % 5 == 0, " 부칙 ").otherwise(" "), nth(3),
        F.when(i % 4 == 0, F.concat(F.lit("(rule "), ((i + 3) % 9 + 1).cast("string"), F.lit(") "))).when(i % 4 == 1, "(이하 x) ").otherwise("(zzzz) "),
    )
    body = F.replace(F.replace("text", F.lit(" the "), named), F.lit(" que "), F.concat(F.lit(" "), nth(5), F.lit(" ")))
    no, sub = (i % 9 + 1).cast("int"), (i % 3).cast("int")
    return table(spark, sf_dir, "documents").select(
        i.alias("item_index"), F.col("lang").alias("category"), "source", F.lit("").alias("revision"), F.lit("").alias("chapter"), T.article_name(no, sub).alias("article"),
        no.alias("article_no"), sub.alias("article_sub"), F.concat(F.lit("rule "), no.cast("string"), F.lit(" of "), "source").alias("article_title"), body.alias("body"),
        (i % 4 == 1).alias("is_supplementary"),
    )


def forms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as attachments of two kinds."""
    i = F.col("doc_id")
    n, form = (i % 6).cast("string"), i % 2 == 1
    return table(spark, sf_dir, "documents").select(
        i.alias("item_index"), F.col("lang").alias("category"), "source", F.lit("").alias("revision"), F.when(form, "별지").otherwise("별표").alias("kind"),
        F.when(form, F.concat(F.lit("[별지 제"), n, F.lit("호 서식]"))).otherwise(F.concat(F.lit("[별표 "), n, F.lit("]"))).alias("label"),
        F.when(form, F.concat(F.lit("제"), n, F.lit("호서식"))).otherwise(n).alias("number"), F.concat(F.lit("form "), n).alias("title"), F.col("text").alias("body"),
        (i % 7 == 0).alias("deleted"),
    )


def regulation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Markdown files: a title, and an opening of some kind ahead of most lines that start with a capital."""
    nth = lambda i, n: (i % n + 1).cast("string")

    def line(x: Column, i: Column) -> Column:
        k = (F.col("doc_id") + i) % 8
        opened = (
            F.when(k == 0, F.concat(F.lit("### 제"), nth(i, 9), F.lit("조(가나) "), x))
            .when(k == 2, F.concat(F.lit("제"), nth(i, 9), F.lit("조의2(다) "), x))
            .when((k == 3) & (i % 3 == 0), F.concat(F.lit("앞말 [별표 "), nth(i, 4), F.lit("] 삭제")))
            .when(k == 3, F.concat(F.lit("[별지 제"), nth(i, 4), F.lit("호 서식] "), x))
            .when(k == 4, F.concat(F.lit("## 제"), nth(i, 5), F.lit("장 "), x))
            .when(k == 5, F.concat(F.lit("제"), nth(i, 5), F.lit("절 총칙\n"), x))
            .when((k == 6) & (i % 2 == 0), F.concat(F.lit("부칙 <2024.01.01.>\n"), x))
            .otherwise(x)
        )
        return F.when(F.regexp_like(x, F.lit("^[A-Z]")), opened).otherwise(x)

    title = F.concat(F.lit("# "), "source", F.lit(" 규정"), F.when(F.col("doc_id") % 2 == 0, " (2025.03.01 개정)\n").otherwise("\n"))
    name = F.col("doc_id").cast("string")
    text = F.concat(title, F.array_join(F.transform(F.split("text", "\n"), line), "\n"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), name.alias("file"), name.alias("stem"), text.alias("text"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("event_type").alias("tool"), T.script_label(F.col("props")).alias("lang"))


def r6(c: str) -> object:
    return F.round(c, 6).alias(c)


# keyword channel


@query
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles_of(spark, sf_dir)
    return keyword.score_articles(a, TOKENS, keyword.weights_of(a, TOKENS)).select("item_index", r6("score"), "position")


@query
def fuzzy_bigram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles_of(spark, sf_dir)
    return keyword.score_articles(a, FUZZY_TOKENS, keyword.weights_of(a, FUZZY_TOKENS), fuzzy=True).select("item_index", r6("score"), "position")


@query
def attachment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = keyword.weights_of(articles_of(spark, sf_dir), TOKENS)
    return keyword.score_attachments(attachments_of(spark, sf_dir), TOKENS, weights).select("item_index", r6("score"), "position")


@query
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.idf_table(articles_of(spark, sf_dir), TOKENS).select("token", "df", r6("idf"))


@query
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles_of(spark, sf_dir)
    top = keyword.keyword_ranking(a, attachments_of(spark, sf_dir), TOKENS, keyword.weights_of(a, TOKENS))
    return top.select("kind", "item_index", r6("score"), "position")


@query
def keyword_many_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles_of(spark, sf_dir)
    top = keyword.keyword_ranking(a, attachments_of(spark, sf_dir), MANY_TOKENS, keyword.weights_of(a, MANY_TOKENS))
    return top.select("kind", "item_index", r6("score"), "position")


RARE_TOKENS = ["tionble", "quement", "zzz", "ó", "thing-", "mente mente"]


def postings_of(spark: SparkSession, sf_dir: str) -> str:
    """An index of the documents and the benchmark's items in a folder of its own."""
    path = tables.new_folder(spark, "postings")
    postings.build_postings(articles_of(spark, sf_dir), attachments_of(spark, sf_dir), path)
    return path


@query
def keyword_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_many_tokens from the index of n-grams."""
    top = postings.ranking_by_postings(spark, postings_of(spark, sf_dir), MANY_TOKENS)
    return top.select("kind", "item_index", r6("score"), "position")


@query
def postings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and candidates of a search for rare tokens, and which of them hold one."""
    return postings.postings_report(spark, postings_of(spark, sf_dir), RARE_TOKENS).select("kind", "rows", "candidates", "true_candidates")


@query
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_rows(articles_of(spark, sf_dir), attachments_of(spark, sf_dir))
    return rows.select(F.col("type").alias("kind"), "item_index", "source", F.length("body").cast("long").alias("n_chars"))


# texts


@query
def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.token_array(F.col("text"))).alias("place", "token")).select("doc_id", F.col("place").cast("long").alias("place"), "token")


@query
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    own, other = F.array_distinct(T.bigrams(F.col("p_name"))), F.array_distinct(T.bigrams(F.col("p_type")))
    return p.select("p_partkey", F.round(T.jaccard(own, other), 6).alias("similarity"))


@query
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = T.find(F.col("text"), "the")
    return d.select("doc_id", T.snippet(F.col("text"), at).alias("snippet"), T.context(F.col("text"), F.greatest(at, F.lit(0))).alias("context"))


@query
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("<개정 2018.12.28.>  "), "text", F.lit(" [신설 2022.07.12.]<other>"))
    return d.select("doc_id", T.strip_markup(marked).alias("plain"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_text(table(spark, sf_dir, "documents"), "text").select("doc_id", "chunk_no", "start", "end", "chunk")


@query
def reflow_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.reflow(F.col("text")).alias("text"))


@query
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser on all documents, with an article's heading before each line that starts with a capital."""
    plain = F.translate("text", "#[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "xx         ")
    headed = F.transform(F.split(plain, "\n"), lambda x: F.when(F.regexp_like(x, F.lit("^[A-Z]")), F.concat(F.lit("### 제1조(가) "), x)).otherwise(x))
    name = F.col("doc_id").cast("string")
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), name.alias("file"), name.alias("stem"), F.array_join(headed, "\n").alias("text"))
    found, _ = segment.parse_regulations(files)
    return found.select("file", F.col("order.line_no").cast("long").alias("line_no"), "article", F.length(F.regexp_replace("body", r"(?U)\s+", "")).cast("long").alias("n_chars"))


@query
def item_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.item_chunks(articles_of(spark, sf_dir), attachments_of(spark, sf_dir))


@query
def script_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.script_label(F.col("text")).alias("label"))


@query
def classify_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " 시행세칙").when(F.col("p_size") % 3 == 1, "지침 ").otherwise(" 기타것"))
    return p.select("p_partkey", T.ending_label(title).alias("kind"))


@query
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


# lookups


@query
def source_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(T.source_match("src1", F.col("source"))).select("doc_id", "source")


@query
def exact_first_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.select_source(table(spark, sf_dir, "documents"), "src1").select("doc_id", "source")


@query
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.list_sources(articles_of(spark, sf_dir))


@query
def get_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.get_article(rules_of(spark, sf_dir), "src1", "7")
    return lookup.with_citation(rows).select("item_index", "source", "article", "citation", "body", "is_supplementary")


@query
def prefer_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 3 == 0).alias("is_supplementary"))
    return lookup.prefer_main(d)


@query
def article_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.article_ranges(rules_of(spark, sf_dir))


@query
def attachment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.list_attachments(forms_of(spark, sf_dir), source="src1", kind="별표")


@query
def attachment_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_attachment(forms_of(spark, sf_dir), "src1", "별지 제3호 서식").select("item_index", "citation", "title", "body", "deleted")


@query
def verify_equi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asks for one article, of a source that there may not be."""
    i = F.col("doc_id")
    asked = table(spark, sf_dir, "documents").select(
        i.alias("asked_by"), F.concat(F.lit("src"), (i % 25).cast("string")).alias("source"), ((i + 3) % 9 + 1).cast("int").alias("article_no"),
        F.when(i % 2 == 0, 2).otherwise(0).alias("article_sub"),
    )
    found = citations.lookup_by_key(asked, rules_of(spark, sf_dir))
    return found.withColumn("item_index", F.coalesce("item_index", F.lit(-1)))


@query
def nearest_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations of the documents, and the source that each names."""
    rules = rules_of(spark, sf_dir)
    cites = citations.extract_citations(rules, "item_index", "body")
    found = citations.nearest_source(cites, rules.select("source").distinct(), ["item_index", "cite_no"])
    return found.select("item_index", "cite_no", "raw", "cited_title", "source")


@query
def verify_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a request: its citations against all articles, within the limits of a request."""
    rules = rules_of(spark, sf_dir)
    found = citations.verify_citations(rules, rules, "item_index", "body")
    return found.select("item_index", "cite_no", "citation", "status", "article_title", "title_verified", "body_excerpt", "message")


@query
def outgoing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outgoing_references(rules_of(spark, sf_dir, quoted=True)).select("item_index", "scope", "citation", "article_title", "snippet")


@query
def incoming_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rules_of(spark, sf_dir)
    return graph.incoming_references(a, graph.reference_target(a, "src1", 7, 0)).select("item_index", "scope", "citation")


def citing_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles with citations written in: by name for each "the", bare for each "que"."""
    number = lambda shift: F.concat(F.lit("제"), ((F.col("item_index") + shift) % 9 + 1).cast("string"), F.when(F.col("item_index") % 2 == 0, "조의2 ").otherwise("조 "))
    named = F.concat(F.lit(" src"), (F.col("item_index") % 4).cast("string"), F.lit(" "), number(3))
    body = F.replace(F.replace("body", F.lit(" the "), named), F.lit(" que "), F.concat(F.lit(" "), number(5)))
    no, sub = (F.col("item_index") % 9 + 1).cast("int"), (F.col("item_index") % 3).cast("int")
    return articles_of(spark, sf_dir).select(
        "item_index", "category", "source", "revision", "chapter", F.concat(F.lit("제"), no.cast("string"), F.lit("조")).alias("article"), "article_title", body.alias("body"),
        no.alias("article_no"), sub.alias("article_sub"), F.lit(False).alias("is_supplementary"),
    )


@query
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references of the documents with citations, both ways, from one pass."""
    edges = graph.edge_table(citing_articles(spark, sf_dir))
    return edges.select("t_source", "t_no", "t_sub", "item_index", "scope", F.col("at").cast("long").alias("at"))


@query
def reference_edges_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who cites one article, read from the stored edges: a bucket, not the texts."""
    path = tables.new_folder(spark, "edges")
    graph.write_edges(graph.edge_table(citing_articles(spark, sf_dir)), path)
    return graph.edges_of(spark, path, "src1", 7, 0).select("item_index", "scope", "citation", "snippet")


@query
def attachment_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents with marks written in, one for each "the" and each "que"."""
    number = (F.col("doc_id") % 7 + 1).cast("string")
    marked = F.replace("text", F.lit(" the "), F.concat(F.lit(" [별표 "), number, F.lit("-1] ")))
    marked = F.replace(marked, F.lit(" que "), F.concat(F.lit(" [ 별지  제"), number, F.lit("호  서식 ]")))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(marked, "\n")).alias("line_no", "line"))
    found = segment.attachment_headers(lines)
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "mark_no", "kind", "number", "label", "title", F.when(F.col("mark_no") == 0, F.col("before")).alias("before"))


@query
def parse_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser on whole documents with a title, chapters, articles of both forms, marks and supplements written in."""
    a, b = segment.parse_regulations(regulation_files(spark, sf_dir))
    letters = F.md5(F.regexp_replace("body", r"(?U)\s+", "").cast("binary")).alias("letters")
    line_no = F.col("order.line_no").cast("long").alias("line_no")
    first = a.select("file", line_no, "source", "revision", "chapter", F.col("article").alias("label"), F.col("article_title").alias("title"), letters, F.col("is_supplementary").alias("flag"))
    second = b.select("file", line_no, "source", "revision", F.lit("").alias("chapter"), "label", "title", letters, F.col("deleted").alias("flag"))
    return first.unionByName(second)


@query
def normalized_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with headings of all levels written in, brought to the parser's form."""
    nth = lambda i: (i % 9 + 1).cast("string")

    def line(x: Column, i: Column) -> Column:
        k = (F.col("doc_id") + i) % 6
        return (
            F.when(k == 0, F.concat(F.lit("# 제"), nth(i), F.lit("조 (가) "), x))
            .when(k == 1, F.concat(F.lit("# 제"), nth(i), F.lit("장 "), x))
            .when(k == 2, F.concat(F.lit("##### "), x))
            .when(k == 3, F.concat(F.lit("## [별표 1] "), x))
            .when(k == 4, F.concat(F.lit("### "), "source", F.lit("\n"), x))
            .otherwise(x)
        )

    revision = F.when(F.col("doc_id") % 2 == 0, "2025.01.01").otherwise("")
    rows = table(spark, sf_dir, "documents").withColumn("markdown", F.array_join(F.transform(F.split("text", "\n"), line), "\n"))
    return rows.select("doc_id", normalize_headings(F.col("markdown"), F.col("source"), revision).alias("markdown"))


@query
def question_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as a bank of questions, each resting on an article; the best twenty for a query."""
    i, turn = F.col("conv_id"), F.col("turn")
    number = F.concat(F.lit(" 제"), ((i + turn) % 9 + 1).cast("string"), F.lit("조"), F.when((i + turn) % 3 == 0, "").otherwise(F.concat(F.lit("의"), ((i + turn) % 3).cast("string"))))
    bank = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", i.cast("string"), turn.cast("string")).alias("id"), F.col("text").alias("question"), F.lit(None).cast("array<string>").alias("options"),
        F.concat(F.lit("근거: src"), (i % 25).cast("string"), number).alias("explanation"),
    )
    found = questions.find_questions(bank, rules_of(spark, sf_dir), " ".join(TOKENS), limit=20)
    return found.select("id", "score", "citation", "article_title", "body_excerpt")


#: What people say, one of which ends each turn.
SAID = ["주말에 일하면", "피를 뽑으면 주말에", "아무것도", "퇴사하면 돈은 언제", "납품이 늦으면 위약금", "집에서 재택 근무", "공익신고를 하면 보복", "정보 공개를 거절", "견적 없이 계약", ""]


@query
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations, each with something said at its end, as queries."""
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % len(SAID)).cast("int"))
    return expand_queries(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", said).alias("query")))


# dense channel and fusion


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_ranking(chunks_of(spark, sf_dir), query_vector(spark, sf_dir)).select("kind", "item_index", r6("score"), "chunk_no")


@query
def dense_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_of(spark, sf_dir)
    scored = c.withColumn("score", F.round(dense.dot(F.col("embedding"), query_vector(spark, sf_dir)), 6))
    return dense.best_chunks(scored).select("kind", "item_index", "score", "chunk_no", "start", "end")


@query
def allowed_chunks_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_of(spark, sf_dir)
    allowed = c.filter("label < 3 AND chunk_no = 0").select("kind", "item_index")
    return dense.allowed_chunks(c, allowed).select("kind", "item_index", "chunk_no", F.col("label").cast("long").alias("label"))


#: Fifteen queries of the words that the documents' languages have, and the vectors that stand for them.
MANY_QUERIES = [
    "the tionble", "que mente", "der sch", "ado ción", "eux ment", "and thing", "ion ation", "est iert", "or ing", "zzz",
    "hand shand", "nder ander", "elle aux", "ouest", "tion tionble eux",
]


@query
def many_keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten documents of each of fifteen queries, with one scan of the texts."""
    found = keyword.keyword_rankings(articles_of(spark, sf_dir), [T.tokenize(q) for q in MANY_QUERIES], 10)
    return found.select("query", "item_index", r6("score"), "position", "rank")


def query_vectors(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < len(MANY_QUERIES)).orderBy("vec_id").collect()
    return [r["embedding"] for r in rows]


@query
def many_dense_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten items of each of fifteen vectors, with one pass over the vectors."""
    found = dense.dense_rankings(chunks_of(spark, sf_dir), query_vectors(spark, sf_dir), 10)
    return found.select("query", "kind", "item_index", r6("score"), "chunk_no", "rank")


def two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = articles_of(spark, sf_dir)
    words = keyword.keyword_ranking(a, None, TOKENS, keyword.weights_of(a, TOKENS))
    words = words.withColumn("score", F.round("score", 6))
    near = dense.dense_ranking(chunks_of(spark, sf_dir), query_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))
    order = [F.desc("score"), F.col("kind"), F.col("item_index")]
    return dense.row_numbers(words, *order), dense.row_numbers(near, *order)


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf_fusion(*two_rankings(spark, sf_dir)).select("kind", "item_index", r6("fused"), "place")


@query
def channel_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.keep_channel_heads(fusion.rrf_fusion(*two_rankings(spark, sf_dir)), 2).select("kind", "item_index", "place")


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = query_vector(spark, sf_dir)
    found = search(articles_of(spark, sf_dir), attachments_of(spark, sf_dir), " ".join(TOKENS), limit=10, chunks=chunks_of(spark, sf_dir), encode=lambda _: vector)
    return found.select("type", "item_index", "source", "score", "search_mode", "matched_by")


@query
def recall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, near = two_rankings(spark, sf_dir)
    both = fusion.rrf_fusion(words, near).select("kind", "item_index", F.col("place").alias("rank"))
    ranked = words.select(F.lit("keyword").alias("mode"), "item_index", "rank").unionByName(both.select(F.lit("hybrid").alias("mode"), "item_index", "rank"))
    truth = table(spark, sf_dir, "labels").filter("quality = 1").select(F.lit("q").alias("query"), F.col("doc_id").alias("item_index"))
    out = recall_at_k(ranked.withColumn("query", F.lit("q")), truth, 50)
    return out.select("mode", F.col("hits").cast("long").alias("hits"), "queries")


# radar and manifest


@query
def parent_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar on customers as rules and their orders as guidelines, whose first article quotes the rule, alone, with more words or after an unknown one, or only an unknown one."""
    name = lambda c: F.concat(F.lit("규정 C"), F.lpad(F.col(c).cast("string"), 9, "0"))
    day = lambda c: F.date_format(c, "yyyy.MM.dd")
    k = F.col("o_orderkey") % 5
    quote = F.when(k == 0, "「없는 법」").when(k == 1, F.concat(F.lit("「없는 법」과 「"), name("o_custkey"), F.lit(" 본칙」"))).otherwise(F.concat(F.lit("「"), name("o_custkey"), F.lit("」")))
    parent = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item_index"), F.lit("규정").alias("category"), name("c_custkey").alias("source"),
        day(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int"))).alias("revision"), F.lit("목적").alias("body"),
    )
    child = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_index"), F.lit("지침").alias("category"), F.concat(F.lit("주문 "), F.col("o_orderkey").cast("string")).alias("source"),
        day(F.to_date("o_orderdate")).alias("revision"), F.concat(quote, F.lit("에 따른다.")).alias("body"),
    )
    rows = parent.unionByName(child).select("*", F.lit(1).alias("article_no"), F.lit(0).alias("article_sub"), F.lit(False).alias("is_supplementary"))
    return radar.compliance_radar(rows).select("source", "parent", "status", F.coalesce("months", F.lit(0)).cast("long").alias("months"))


@query
def late_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar on orders as rules and their first shipping as a detailed rule below each."""
    day = lambda c: F.date_format(F.to_date(c), "yyyy.MM.dd")
    parent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_index"), F.lit("규정").alias("category"), F.col("o_orderkey").cast("string").alias("source"), day("o_orderdate").alias("revision"))
    child = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    child = child.select(F.col("l_orderkey").alias("item_index"), F.lit("시행세칙").alias("category"), F.concat(F.col("l_orderkey").cast("string"), F.lit(" 시행세칙")).alias("source"), day("first").alias("revision"))
    rows = parent.unionByName(child).select("*", F.lit(1).alias("article_no"), F.lit(0).alias("article_sub"), F.lit(False).alias("is_supplementary"), F.lit("목적").alias("body"))
    return radar.compliance_radar(rows).select("source", "parent", "status", F.coalesce("months", F.lit(0)).cast("long").alias("months"))


@query
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name has the first word of a part's name."""
    p = table(spark, sf_dir, "part")
    first = p.select(F.regexp_extract("p_name", "^[^ ]+", 0).alias("name"))
    return contained(p, "p_name", first, "name").select("p_name", "name", F.col("at").cast("long").alias("at"))


@query
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have the first three words of a benchmark item."""
    names = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "^[^ ]+ [^ ]+ [^ ]+", 0).alias("name"))
    found = name_places(table(spark, sf_dir, "documents"), "doc_id", "text", names, "name")
    return found.select("doc_id", "name", F.col("at").cast("long").alias("at"))


def two_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    row = lambda shift: (
        F.col("o_orderkey").cast("string").alias("name"),
        F.date_format(F.date_sub(F.to_date("o_orderdate"), F.lit(shift)), "yyyy.MM.dd").alias("revision"), F.lit("alio").alias("origin"),
    )
    old = o.filter("o_orderkey % 5 <> 0").select(*row(0))
    new = o.filter("o_orderkey % 7 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    new = new.select(F.col("o_orderkey").cast("string").alias("name"), F.date_format(F.date_sub(F.to_date("o_orderdate"), F.col("s")), "yyyy.MM.dd").alias("revision"), F.lit("alio").alias("origin"))
    return old, new


@query
def manifest_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.removed_names(*two_manifests(spark, sf_dir))


@query
def manifest_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.common_names(*two_manifests(spark, sf_dir))


@query
def manifest_regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.regressed_revisions(*two_manifests(spark, sf_dir))


@query
def manifest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.duplicate_names(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name")))


@query
def dedupe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("position"))
    return manifest.numbered_names(rows)


@query
def collection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = two_manifests(spark, sf_dir)
    return manifest.collection_gate(new, new.filter("name LIKE '1%'"), old)


# usage


@query
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_totals(events_of(spark, sf_dir))


@query
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_daily(events_of(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query
def usage_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_weekly(usage.usage_daily(events_of(spark, sf_dir))).withColumn("week", F.col("week").cast("string"))


@query
def usage_week_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.week_view(usage.usage_daily(events_of(spark, sf_dir)), F.lit("2024-01-10").cast("date"))


@query
def backfill_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_of(spark, sf_dir)
    found = usage.backfill_missing_days(usage.usage_daily(events).filter("day < DATE '2024-01-20'"), usage.usage_totals(events))
    return found.withColumn("day", F.col("day").cast("string"))


@query
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.metrics_lines(events_of(spark, sf_dir)).select("section", "line")


@query
def current_file_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last link of each page, by the reader of detail pages with a wider pattern."""
    found = listing.file_links(table(spark, sf_dir, "pages"), "html", 'href="/([^"]+)"[^>]*>([^<]+)')
    return found.select("page_id", F.col("file_no").alias("link"), "file_name", "ext")


@query
def daily_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = usage.daily_breakdown(events_of(spark, sf_dir))
    entries = lambda kind, c: days.select(F.col("day").cast("string").alias("day"), "total", F.lit(kind).alias("kind"), F.explode(c).alias("key", "count"))
    return entries("tool", "tools").unionByName(entries("lang", "by_language"))


@query
def usage_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streamed daily counts over the whole table, read as a stream until its end."""
    table_schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    raw = tables.stream_table(spark, f"{sf_dir}/events.parquet", table_schema)
    counts = usage_stream.daily_counts(raw.select("ts", F.col("event_type").alias("tool")))
    folder = tables.new_folder(spark, "daily")
    # every batch has all counts so far: the last one's stand
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("day").cast("string").alias("day"), "tool", "count")


@query
def usage_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the whole table, written as a log of eight files, streamed in batches of two and merged batch by batch, one of them twice."""
    folder = tables.new_folder(spark, "usage")
    events_of(spark, sf_dir).repartition(8).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(USAGE_EVENT).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    stored_totals.run_totals(stream, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    said = tables.read_pointer(spark, f"{folder}/counts")["batches"]
    for name, number in said.items():
        stored_totals.merge_batch(events_of(spark, sf_dir), f"{folder}/counts", name, number)  # comes again, and is passed over
    return stored_totals.totals(spark, f"{folder}/counts")


# sources


@query
def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a JSON index of one to three articles, in either form, read back."""
    rules = rules_of(spark, sf_dir)
    article = F.struct("category", "source", "revision", F.col("item_index").cast("string").alias("file"), "article", "article_no", "article_sub", "article_title", "body", "is_supplementary")
    rows = F.array_repeat(article, (F.col("item_index") % 3 + 1).cast("int"))
    whole = F.to_json(F.struct(F.lit(2).alias("version"), rows.alias("articles"), F.array().cast("array<string>").alias("attachments")))
    files = rules.select(F.when(F.col("item_index") % 2 == 0, F.to_json(rows)).otherwise(whole).alias("value"))
    found, _ = corpus.json_tables(files)
    return found.select("file", "item_index", "source", "article", "article_no", "article_sub", "article_title", "body", "is_supplementary")


@query
def staged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listed documents, two thirds of which have a converted text."""
    c = table(spark, sf_dir, "customer")
    number = F.col("c_custkey").cast("string")
    resolved = c.select(F.col("c_mktsegment").alias("title"), F.lit("규정").alias("type"), number.alias("file_no"), F.lit("2026.01.01").alias("revision"), F.col("c_custkey").alias("idx"))
    text = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("# 제1조(가) "), "c_name"))
    return sync.staged_documents(resolved, c.select(number.alias("file_no"), text.alias("markdown")))


# search with filters and fallbacks


def found_rows(rows: DataFrame) -> DataFrame:
    return rows.select("place", "type", "item_index", "source", "score", "search_mode", "matched_by")


@query
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_rows(search(articles_of(spark, sf_dir), attachments_of(spark, sf_dir), " ".join(TOKENS), category="en", source="src1", limit=20, mode="keyword"))


@query
def search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search is paused, so keywords answer."""
    vector = query_vector(spark, sf_dir)
    found = search(articles_of(spark, sf_dir), attachments_of(spark, sf_dir), " ".join(TOKENS), chunks=chunks_of(spark, sf_dir), encode=lambda _: vector, paused=lambda: True)
    return found_rows(found)


@query
def search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = query_vector(spark, sf_dir)
    return found_rows(search(articles_of(spark, sf_dir), attachments_of(spark, sf_dir), " ".join(TOKENS), mode="semantic", chunks=chunks_of(spark, sf_dir), encode=lambda _: vector))
