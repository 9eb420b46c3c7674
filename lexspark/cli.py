"""Command line: build, search, get, verify, attachments, attachment, refs, radar, question, sources, stats, update."""

from __future__ import annotations

import argparse
import json

from .operators.dense import hashed_encoder
from .plans.api import Corpus, build_lookups, build_vectors
from .schemas import MANIFEST
from .session import local_session
from .sources import corpus, listing, sync
from .streaming import usage_log


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexspark", description=__doc__)
    top.add_argument("--index", default="index", help="folder of the tables")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build", help="parse a folder of Markdown")
    p.add_argument("folder")
    p.add_argument("--vectors", action="store_true", help="also store chunk vectors")
    p.add_argument("--lookups", action="store_true", help="also store the index of n-grams and the references")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("--category")
    p.add_argument("--source")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--fuzzy", action="store_true")
    p.add_argument("--attachments", action="store_true")
    p.add_argument("--mode", default="hybrid")
    for name, second in (("get", "article"), ("attachment", "label"), ("refs", "article")):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument(second)
        if name == "refs":
            p.add_argument("--limit", type=int, default=20)
            p.add_argument("--mermaid", action="store_true")
    sub.add_parser("verify").add_argument("text")
    p = sub.add_parser("attachments")
    p.add_argument("--source")
    p.add_argument("--category")
    p.add_argument("--kind")
    p.add_argument("--deleted", action="store_true")
    sub.add_parser("radar").add_argument("source", nargs="?")
    sub.add_parser("sources").add_argument("category", nargs="?")
    p = sub.add_parser("question")
    p.add_argument("query", nargs="?")
    p.add_argument("--id")
    p.add_argument("--limit", type=int, default=3)
    p = sub.add_parser("stats", help="counts of a log of usage events")
    p.add_argument("log", help="folder of usage events")
    p.add_argument("view", nargs="?", choices=("all", "week", "backfill"), default="all")
    p.add_argument("--daily", help="backfill: folder of the daily counts (day, tool, count)")
    p.add_argument("--totals", help="backfill: folder of the older totals (tool, count, first_seen, last_seen)")
    p = sub.add_parser("update", help="replace the stored documents from a listing, pages and converted texts, and build the index")
    p.add_argument("listing", help="folder of the listing's pages as JSON")
    p.add_argument("pages", help="Parquet table (idx, html)")
    p.add_argument("converted", help="Parquet table (file_no, markdown)")
    p.add_argument("documents", help="table of the documents that is replaced")
    p.add_argument("--limit", type=int, default=0, help="show the first documents only and change nothing")
    p.add_argument("--no-build", action="store_true", help="leave the index as it is")
    return top


def stats(spark, a: argparse.Namespace) -> dict:
    if a.view == "week":
        return usage_log.week(spark, a.log)
    if a.view == "backfill":
        daily = spark.read.parquet(a.daily)
        new, added = usage_log.backfill(spark, spark.read.parquet(a.totals), daily)
        corpus.swap_in(new, a.daily, lambda _: None)
        return {"ok": True, "inserted": added, "week": usage_log.week(spark, a.log)}
    return usage_log.snapshot(spark, a.log)


def update(spark, a: argparse.Namespace) -> dict:
    listed = listing.read_pages(spark, a.listing)
    resolved = listing.resolved_files(listed, spark.read.parquet(a.pages))
    converted = spark.read.parquet(a.converted)
    if a.limit:
        some = sync.staged_documents(resolved.orderBy("idx").limit(a.limit), converted)
        return {"documents": [r.asDict() for r in some.select("name", "type", "file", "revision").collect()]}
    had = corpus.exists(spark, a.documents)
    previous = spark.read.parquet(a.documents) if had else spark.createDataFrame([], MANIFEST)
    sync.sync(spark, listed, resolved, converted, previous, a.documents)
    stored = spark.read.parquet(a.documents)
    if not a.no_build:
        corpus.build_from(spark, sync.as_files(stored), a.index)
    return {"documents": stored.count(), "built": not a.no_build}


def main(argv: list[str] | None = None) -> object:
    a = parser().parse_args(argv)
    spark = local_session()
    if a.command == "build":
        corpus.build_index(spark, a.folder, a.index)
        if a.vectors:
            build_vectors(spark, a.index, hashed_encoder())
        if a.lookups:
            build_lookups(spark, a.index)
        articles, attachments = corpus.read_index(spark, a.index)
        out: object = {"articles": articles.count(), "attachments": attachments.count()}
    elif a.command == "stats":
        out = stats(spark, a)
    elif a.command == "update":
        out = update(spark, a)
    else:
        encode = hashed_encoder()
        c = Corpus.open(spark, a.index, lambda q: encode([f"query: {q}"])[0].tolist())
        calls = {
            "search": lambda: c.search_regulation(a.query, a.category, a.source, a.limit, a.fuzzy, a.attachments, a.mode),
            "get": lambda: c.get_article(a.source, a.article),
            "verify": lambda: c.verify_citation(a.text),
            "attachments": lambda: c.list_attachments(a.source, a.category, a.kind, a.deleted),
            "attachment": lambda: c.get_attachment(a.source, a.label),
            "refs": lambda: c.find_references(a.source, a.article, a.limit, a.mermaid),
            "radar": lambda: c.compliance_radar(a.source),
            "sources": lambda: c.list_sources(a.category),
            "question": lambda: c.find_questions(a.query, a.id, a.limit),
        }
        out = calls[a.command]()
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str))
    return out


if __name__ == "__main__":
    main()
