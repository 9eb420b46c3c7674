"""The public operators over a built index, as rows of plain dictionaries.

Every result is bounded by its limit or by one document's size, so collecting is safe; the
DataFrame forms are in :mod:`lexspark.operators` and :mod:`lexspark.plans.search`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc, parse_article_token
from ..operators import citations, graph, lookup, postings, questions, radar
from ..operators.chunking import item_chunks
from ..operators.dense import HASHED, PAUSE_SECONDS, SemanticUnavailable, check_index, embed_chunks, fingerprint, index_meta, runtime_paused
from ..sources import corpus
from .search import search


class Corpus:
    """Articles and attachments of one index; vectors and questions where there are any."""

    def __init__(
        self, articles: DataFrame, attachments: DataFrame, chunks: DataFrame | None = None, encode: Callable[[str], Sequence[float]] | None = None,
        question_bank: DataFrame | None = None, pause_marker: str | None = None, pause_seconds: float = PAUSE_SECONDS,
    ):
        self.articles, self.attachments, self.chunks, self.encode, self.question_bank = articles, attachments, chunks, encode, question_bank
        self.pause_marker, self.pause_seconds = pause_marker, pause_seconds
        self.semantic_error: str | None = None
        #: Folder of the index of n-grams and the edges, if they are stored and of these tables.
        self.lookups: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, index: str, encode: Callable[[str], Sequence[float]] | None = None, encoder: str = HASHED, pause_marker: str | None = None) -> Corpus:
        """The stored tables, kept in memory; FileNotFoundError before they are built.

        Vectors that aren't of these tables and this encoder are left out, ``semantic_error`` says why,
        and searches fall back to keywords.
        """
        articles, attachments = corpus.read_index(spark, index)
        bank = corpus.read_questions(spark, f"{index}/questions.json") if corpus.exists(spark, f"{index}/questions.json") else None
        out = cls(articles.cache(), attachments.cache(), None, encode, bank, pause_marker)
        try:
            out.chunks = checked_vectors(spark, index, out.articles, out.attachments, encoder)
        except SemanticUnavailable as e:
            out.semantic_error = str(e)
        folder = corpus.index_folder(spark, index)
        said = corpus.read_meta(spark, f"{folder}/lookups.json")
        if said and said.get("index_sha256") == fingerprint(out.articles, out.attachments):
            out.lookups = folder
        return out

    def paused(self) -> bool:
        return runtime_paused(self.pause_marker, time.time(), self.pause_seconds)

    def close(self) -> None:
        self.articles.unpersist()
        self.attachments.unpersist()

    def search_regulation(self, query: str, category: str | None = None, source: str | None = None, limit: int = 10, fuzzy: bool = False, include_attachments: bool = False, mode: str = "hybrid") -> list[dict]:
        found = search(self.articles, self.attachments, query, category, source, limit, fuzzy, include_attachments, mode, self.chunks, self.encode, self.paused, self.lookups and f"{self.lookups}/postings")
        keep = {"article": ("kind", "label", "title"), "attachment": ("chapter", "article", "article_title")}
        return [{k: v for k, v in r.asDict().items() if k not in (*keep[r["type"]], "place", "item_index")} for r in found.collect()]

    def get_article(self, source: str, article: str) -> list[dict]:
        rows = lookup.with_citation(lookup.get_article(self.articles, source, article))
        fields = ("category", "source", "revision", "chapter", "article", "article_title", "citation", "body", "is_supplementary")
        return [r.asDict() for r in rows.orderBy("item_index").select(*fields).collect()]

    def list_attachments(self, source: str | None = None, category: str | None = None, kind: str | None = None, include_deleted: bool = False) -> list[dict]:
        return [r.asDict() for r in lookup.list_attachments(self.attachments, source, category, kind, include_deleted).collect()]

    def get_attachment(self, source: str, label: str) -> list[dict]:
        rows = lookup.get_attachment(self.attachments, source, label)
        if "citation" not in rows.columns:
            return []
        fields = ("category", "source", "revision", "kind", "label", "title", "deleted", "citation", "body")
        return [r.asDict() for r in rows.orderBy("item_index").select(*fields).collect()]

    def verify_citation(self, text: str) -> list[dict]:
        one = self.articles.sparkSession.createDataFrame([(0, nfc(text))], "text_id long, text string")
        rows = citations.verify_citations(one, self.articles).orderBy("cite_no", F.col("status") == "truncated").drop("text_id")
        return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows.collect()]

    def find_references(self, source: str, article: str, limit: int = 20, include_mermaid: bool = False, strict: bool = False) -> dict:
        """target, outgoing, incoming, counts before the limit, status: ok, not_found or invalid_article."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        parsed = parse_article_token(article)
        empty = {"outgoing": [], "incoming": [], "counts": {"outgoing": 0, "incoming": 0}}
        target = graph.reference_target(self.articles, source, *parsed).collect() if parsed else []
        if target:
            row = target[0]
            one = self.articles.filter(F.col("item_index") == row["item_index"])
            edges = graph.outgoing_references(self.articles, strict, citing=one)
            out = [r.asDict() for r in edges.orderBy("pass", "place").drop("item_index", "place", "pass").collect()]
            if self.lookups:
                stored = graph.edges_of(self.articles.sparkSession, f"{self.lookups}/edges", row["source"], row["article_no"], row["article_sub"])
                citing = stored.filter(F.col("item_index") != row["item_index"]).select("item_index", "scope", "citation", "article_title", "snippet")
            else:
                citing = graph.incoming_references(self.articles, one)
            into = [r.asDict() for r in citing.orderBy("item_index").drop("item_index").collect()]
            name = f"{row['source']} {row['article']}"
            result = {
                "target": {"source": row["source"], "article": row["article"], "article_title": row["article_title"], "citation": name},
                "outgoing": out[:limit], "incoming": into[:limit], "counts": {"outgoing": len(out), "incoming": len(into)}, "status": "ok",
            }
        else:
            label = f"제{parsed[0]}조" + (f"의{parsed[1]}" if parsed[1] else "") if parsed else article
            named = {"source": source, "article": label, "article_title": None, "citation": f"{source} {label}".strip()}
            result = {"target": named, **empty, "status": "not_found" if parsed else "invalid_article"}
        if include_mermaid:
            result["mermaid"] = graph.mermaid(result["target"]["citation"], [r["citation"] for r in result["incoming"]], [r["citation"] for r in result["outgoing"]])
        return result

    def compliance_radar(self, source: str | None = None) -> list[dict]:
        return [r.asDict() for r in radar.compliance_radar(self.articles, source).collect()]

    def list_sources(self, category: str | None = None) -> list[dict]:
        return [r.asDict() for r in lookup.list_sources(self.articles, category).collect()]

    def find_questions(self, query: str | None = None, question_id: str | None = None, limit: int = 5) -> list[dict]:
        if self.question_bank is None:
            raise FileNotFoundError("this index has no questions")
        rows = questions.find_questions(self.question_bank, self.articles, query, question_id, limit)
        return [r.asDict() for r in rows.orderBy(F.desc("score"), "place" if "place" in rows.columns else "id").drop("place").collect()]


def build_vectors(spark: SparkSession, index: str, encode: Callable[[list[str]], object], encoder: str = HASHED) -> None:
    """Chunk both tables and store the chunks with their vectors, then what :func:`checked_vectors` needs to know of them.

    They belong to the index's current version and end with it.
    """
    articles, attachments = corpus.read_index(spark, index)
    folder = corpus.index_folder(spark, index)
    corpus.remove(spark, f"{folder}/vectors.json")
    embed_chunks(item_chunks(articles, attachments), encode).write.mode("overwrite").parquet(f"{folder}/vectors")
    corpus.write_meta(spark, index_meta(spark.read.parquet(f"{folder}/vectors"), fingerprint(articles, attachments), encoder), f"{folder}/vectors.json")


def build_lookups(spark: SparkSession, index: str) -> None:
    """Store the index of n-grams and the edges of the current version, which searches and references then read in place of the bodies."""
    articles, attachments = corpus.read_index(spark, index)
    folder = corpus.index_folder(spark, index)
    for name in ("postings", "edges", "lookups.json"):
        corpus.remove(spark, f"{folder}/{name}")
    postings.build_postings(articles, attachments.filter(~F.col("deleted")), f"{folder}/postings")
    graph.write_edges(graph.edge_table(articles), f"{folder}/edges")
    corpus.write_meta(spark, {"index_sha256": fingerprint(articles, attachments)}, f"{folder}/lookups.json")


def checked_vectors(spark: SparkSession, index: str, articles: DataFrame, attachments: DataFrame, encoder: str = HASHED) -> DataFrame:
    """The stored chunks with their vectors; SemanticUnavailable unless they are of these tables and this encoder."""
    folder = corpus.index_folder(spark, index)
    meta = corpus.read_meta(spark, f"{folder}/vectors.json")
    if not meta or not corpus.exists(spark, f"{folder}/vectors"):
        raise SemanticUnavailable("no vectors are stored")
    vectors = spark.read.parquet(f"{folder}/vectors")
    check_index(item_chunks(articles, attachments), vectors, meta, fingerprint(articles, attachments), meta.get("dimension"), encoder=encoder)
    return vectors
