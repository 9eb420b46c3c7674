"""Reading and writing: Markdown, index tables, JSON indexes, listings, synchronising, metrics, command line."""

import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from lexspark import cli
from lexspark.operators import manifest
from lexspark.plans import fixture
from lexspark.sources import corpus, listing, metrics_server, sync


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    for _, name, _, text in fixture.FILES:
        (top / name).write_text(text, encoding="utf-8")
    (top / "목차.md").write_text("# 목차\n### 제1조(가) 나\n", encoding="utf-8")
    return str(top)


def test_index(spark, folder, tmp_path):
    index = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        corpus.read_index(spark, index)
    corpus.build_index(spark, folder, index, skip=("목차.md",))
    articles, attachments = corpus.read_index(spark, index)
    rows = articles.orderBy("item_index").collect()
    assert [r.item_index for r in rows] == list(range(5)) and {r.category for r in rows} == {"규정", "시행세칙"}
    assert attachments.count() == 2


def test_json_indexes(spark, tmp_path):
    row = dict(zip([c.split()[0] for c in fixture.ARTICLE_FIELDS.split(", ")], fixture.ARTICLES[0], strict=True)) | {"file": "x.md"}
    del row["item_index"]
    both, bare = tmp_path / "v2.json", tmp_path / "v1.json"
    both.write_text(json.dumps({"version": 2, "articles": [row, row], "attachments": []}, ensure_ascii=False), encoding="utf-8")
    bare.write_text(json.dumps([row, row], ensure_ascii=False), encoding="utf-8")
    for path in (both, bare):
        articles, attachments = corpus.read_json_index(spark, str(path))
        assert [(r.item_index, r.source, r.article_no) for r in articles.orderBy("item_index").collect()] == [(0, "시험규정", 1), (1, "시험규정", 1)]
        assert attachments.count() == 0


def test_manifest_file(spark, tmp_path):
    path = tmp_path / "sources.json"
    assert corpus.read_manifest(spark, str(path)).count() == 0
    path.write_text("broken", encoding="utf-8")
    assert corpus.read_manifest(spark, str(path)).count() == 0
    path.write_text(json.dumps({"sources": [{"name": "가", "revision": "2026.01.01", "origin": "alio"}]}, ensure_ascii=False), encoding="utf-8")
    assert corpus.read_manifest(spark, str(path)).first()["name"] == "가"


def test_retries():
    waits, calls = [], []

    def fails(times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise OSError("late")
            return "done"

        return call

    assert listing.with_retries(fails(2), sleep=waits.append) == "done" and waits == [3, 6]
    calls.clear()
    with pytest.raises(OSError):
        listing.with_retries(fails(9), sleep=waits.append)
    assert len(calls) == 5


def test_listing_and_links(spark, tmp_path):
    for page in (1, 2):
        (tmp_path / f"page{page}.json").write_text(json.dumps({"data": {"result": [{"title": f"시험규정 {page}", "idx": page, "stDate": "2026.01.01"}]}}, ensure_ascii=False), encoding="utf-8")
    items = listing.read_pages(spark, str(tmp_path))
    assert sorted(r.title for r in items.collect()) == ["시험규정 1", "시험규정 2"]
    link = '<a href="/download/rulefiledown.json?fileNo={}" x>{}</a>'
    html = link.format(1, "old.hwp") + link.format(2, " A &amp; B.HWPX")
    pages = spark.createDataFrame([("1", html), ("2", "none")], "idx string, html string")
    rows = listing.resolved_files(items, pages).collect()
    assert [(r.title, r.type, r.file_no, r.file_name, r.ext) for r in rows] == [("시험규정 1", "기타", "2", "A & B.HWP", "hwp")]  # the first ending that fits


def test_vectors_of_another_index(spark, folder, tmp_path):
    from lexspark.operators.dense import hashed_encoder
    from lexspark.plans.api import Corpus, build_vectors

    encode = hashed_encoder()
    one = lambda q: encode([q])[0].tolist()
    index = str(tmp_path / "index")
    corpus.build_index(spark, folder, index)
    mode = lambda c: c.search_regulation("위원회")[0]["search_mode"]
    assert mode(Corpus.open(spark, index, one)) == "keyword_fallback"
    build_vectors(spark, index, encode)
    marker = tmp_path / "pause"
    c = Corpus.open(spark, index, one, pause_marker=str(marker))
    assert c.semantic_error is None and mode(c) == "hybrid"
    marker.write_text("")
    assert mode(c) == "keyword_fallback"
    c.close()
    assert Corpus.open(spark, index, one, encoder="other").semantic_error == "the vectors were made by another encoder"
    # the tables change below the vectors
    articles, attachments = corpus.read_index(spark, index)
    other = spark.createDataFrame(articles.collect(), articles.schema).withColumn("body", F.lit("새 본문 위원회"))
    corpus.write_index(other, spark.createDataFrame(attachments.collect(), attachments.schema), corpus.index_folder(spark, index))
    stale = Corpus.open(spark, index, one)
    assert stale.semantic_error == "the vectors were built for another index" and mode(stale) == "keyword_fallback"
    stale.close()
    corpus.build_index(spark, folder, index)
    assert not corpus.exists(spark, f"{corpus.index_folder(spark, index)}/vectors")


def test_a_build_that_fails_leaves_the_old_version(spark, folder, tmp_path, monkeypatch):
    """Readers see the two tables and the vectors of one version, whatever step of the next fails."""
    from lexspark.operators.dense import hashed_encoder
    from lexspark.plans.api import Corpus, build_vectors

    encode = hashed_encoder()
    index = str(tmp_path / "index")
    corpus.build_index(spark, folder, index)
    build_vectors(spark, index, encode)
    version = corpus.index_folder(spark, index)
    want = [t.count() for t in corpus.read_index(spark, index)]
    fewer = corpus.read_markdown(spark, folder).limit(1)

    def half(articles, attachments, where):
        articles.write.parquet(f"{where}/articles")
        raise OSError("the second table fails")

    with monkeypatch.context() as m:
        m.setattr(corpus, "write_index", half)
        with pytest.raises(OSError, match="second"):
            corpus.build_from(spark, fewer, index)
    assert corpus.index_folder(spark, index) == version and [t.count() for t in corpus.read_index(spark, index)] == want
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.is_dir()) == [version.rpartition("/")[2]]
    c = Corpus.open(spark, index, lambda q: encode([q])[0].tolist())
    assert c.semantic_error is None and len(c.search_regulation("위원회")) > 0
    with monkeypatch.context() as m:
        m.setattr("lexspark.sources.tables._point", lambda *a: (_ for _ in ()).throw(OSError("the pointer fails")))
        with pytest.raises(OSError, match="pointer"):
            corpus.build_from(spark, fewer, index)
    assert corpus.index_folder(spark, index) == version
    corpus.build_from(spark, fewer, index)
    assert corpus.index_folder(spark, index) != version and corpus.read_index(spark, index)[0].count() < want[0]
    assert len(c.search_regulation("위원회")) > 0  # the version before stays for those that opened it
    c.close()
    for _ in range(2):
        corpus.build_index(spark, folder, index)
    assert len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 2


def test_stored_lookups_answer_as_the_bodies_do(spark, folder, tmp_path):
    from lexspark.plans.api import Corpus, build_lookups

    index = str(tmp_path / "index")
    corpus.build_index(spark, folder, index)
    plain = Corpus.open(spark, index)
    build_lookups(spark, index)
    stored = Corpus.open(spark, index)
    assert plain.lookups is None and stored.lookups
    for query in ("위원회", "업무 시행일", "신청서"):
        for more in ({}, {"include_attachments": True}, {"source": "시행세칙"}, {"category": "규정", "fuzzy": True}):
            assert stored.search_regulation(query, **more) == plain.search_regulation(query, **more)
    for article in ("1", "2", "2의2", "9"):
        assert stored.find_references("시험규정", article) == plain.find_references("시험규정", article)
    plain.close()
    stored.close()


def test_swap_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    corpus.swap_in(spark.range(3), path, lambda _: None)
    real = corpus._rename

    def fails(fs, source, target):
        if str(source.toString()).endswith(".staged"):
            raise OSError("no")
        real(fs, source, target)

    monkeypatch.setattr(corpus, "_rename", fails)
    with pytest.raises(OSError):
        corpus.swap_in(spark.range(5), path, lambda _: None)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.undo()
    corpus.swap_in(spark.range(5), path, lambda _: None)
    assert spark.read.parquet(path).count() == 5 and not corpus.exists(spark, f"{path}.old")


def test_listing_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):  # noqa: N802
            page = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["pageNo"]
            self.answer(json.dumps({"data": {"result": [{"title": f"규정{page}", "idx": page}], "page": {"totalPage": 3}}}).encode())

        def do_GET(self):  # noqa: N802
            self.answer(b"content of " + self.path.split("=")[1].encode(), 404 if self.path.endswith("=9") else 200)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_address[1]}"
    spark.dataSource.register(listing.ListingSource)
    rows = spark.read.format("listing").option("payload", '{"apbaId": "x"}').option("retries", "1").load(f"{site}/list.json")
    assert sorted((r.title, r.idx) for r in rows.collect()) == [("규정1", "1"), ("규정2", "2"), ("규정3", "3")]
    wanted = spark.createDataFrame([("7", "hwp"), ("9", None)], "file_no string, ext string")
    got = {r.file_no: r for r in listing.download_files(wanted, site, retries=1).collect()}
    server.shutdown()
    assert bytes(got["7"].content) == b"content of 7" and got["9"].content is None and got["9"].error and got["9"].ext == "hwp"
    (tmp_path / "7.HWP").write_bytes(b"x")
    have = listing.read_landed(spark, str(tmp_path))
    assert [(r.file_no, r.ext) for r in have.collect()] == [("7", "hwp")] and [r.file_no for r in listing.landed(wanted, have).collect()] == ["9"]


def test_sync(spark, tmp_path):
    n = 120
    resolved = spark.range(n).select(F.concat(F.lit("규정"), "id").alias("title"), F.lit("규정").alias("type"), F.col("id").cast("string").alias("file_no"), F.lit("2026.01.01").alias("revision"), F.col("id").alias("idx"))
    converted = spark.range(n).select(F.col("id").cast("string").alias("file_no"), F.lit("# 제1조(가) 나").alias("markdown"))
    nothing = spark.createDataFrame([], "name string, revision string, origin string")
    path = str(tmp_path / "docs")
    sync.sync(spark, resolved, resolved, converted, nothing, path)
    stored = spark.read.parquet(path)
    assert stored.count() == n and "### 제1조(가) 나" in stored.first()["text"]
    previous = spark.createDataFrame(stored.select("name", "revision", "origin").collect())
    with pytest.raises(manifest.UnsafeUpdate):
        sync.sync(spark, resolved, resolved, converted.filter("CAST(file_no AS INT) > 50"), previous, path)
    assert spark.read.parquet(path).count() == n
    sync.sync(spark, resolved, resolved, converted, previous, path)
    assert spark.read.parquet(path).count() == n


def test_update_command(spark, tmp_path):
    pages, n = tmp_path / "pages", 120
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"data": {"result": [{"title": f"규정{i}", "idx": str(i), "stDate": "2026.01.01"} for i in range(n)]}}, ensure_ascii=False), encoding="utf-8")
    link = F.concat(F.lit('<a href="/download/rulefiledown.json?fileNo='), "id", F.lit('">'), "id", F.lit(".hwp</a>"))
    spark.range(n).select(F.col("id").cast("string").alias("idx"), link.alias("html")).write.parquet(f"{tmp_path}/html")
    spark.range(n).select(F.col("id").cast("string").alias("file_no"), F.lit("# 제1조(가) 나").alias("markdown")).write.parquet(f"{tmp_path}/md")
    call = ["--index", f"{tmp_path}/index", "update", str(pages), f"{tmp_path}/html", f"{tmp_path}/md", f"{tmp_path}/docs"]
    assert len(cli.main([*call, "--limit", "3"])["documents"]) == 3 and not (tmp_path / "docs").exists()
    assert cli.main(call) == {"documents": n, "built": True}
    assert corpus.read_index(spark, f"{tmp_path}/index")[0].count() == n
    # documents of another origin stay through an update
    own = spark.createDataFrame([("내것", "규정", "규정_내것.md", "", "", "local", "# 내것")], "name string, type string, file string, revision string, file_no string, origin string, text string")
    own.write.mode("append").parquet(f"{tmp_path}/docs")
    assert cli.main([*call, "--no-build"])["documents"] == n + 1


def test_metrics_server():
    server = metrics_server.start_metrics_server(lambda: "x 1\n# EOF\n", 0)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    assert urllib.request.urlopen(f"{at}/metrics").read() == b"x 1\n# EOF\n"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/other")
    server.shutdown()


def test_command_line(spark, folder, tmp_path, capsys):
    index = str(tmp_path / "index")
    assert cli.main(["--index", index, "build", folder, "--vectors"])["articles"] >= 5
    assert cli.main(["--index", index, "get", "시험규정", "2의2"])[0]["article"] == "제2조의2"
    assert cli.main(["--index", index, "search", "위원회", "--mode", "hybrid"])[0]["search_mode"] == "hybrid"
    assert cli.main(["--index", index, "refs", "시험규정", "1", "--mermaid"])["mermaid"].startswith("flowchart LR")
    assert len(cli.main(["--index", index, "attachments"])) == 2
    assert cli.main(["--index", index, "radar"])[0]["status"] == "review_needed"
    assert json.JSONDecoder().raw_decode(capsys.readouterr().out)[0]["articles"] >= 5
