"""Paginated JSON listings as tables, the links of detail pages, and the files behind them."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import ending_label, strip
from ..functions.unicode import unescape_html

# How often and after how many seconds a request is tried again, how long it may take.
RETRIES, BACKOFF_SECONDS, TIMEOUT_SECONDS = 5, 3, 60

#: A link to a stored file: its number, and its name.
FILE_LINK = r'(?i)href="/download/rulefiledown\.json\?fileNo=(\d+)"[^>]*>([^<]+\.(?:hwp|hwpx|pdf|docx?|xlsx?|zip))'

#: Where a file of that number is, below the site.
FILE_PATH = "/download/rulefiledown.json?fileNo={}"

ITEM = "title string, idx string, stDate string, tableName string"


def with_retries(call: Callable, retries: int = RETRIES, backoff: float = BACKOFF_SECONDS, sleep: Callable = time.sleep):
    """``call()``, tried again after 3, 6, 12 ... seconds; the last failure is raised."""
    for attempt in range(retries):
        try:
            return call()
        except OSError:
            if attempt + 1 == retries:
                raise
            sleep(backoff * 2**attempt)
    return None


def fetch(url: str, payload: dict | None = None, retries: int = RETRIES, backoff: float = BACKOFF_SECONDS) -> bytes:
    """The answer to a GET, or to a POST of ``payload`` as JSON."""
    body = None if payload is None else json.dumps(payload).encode()
    headers = {"User-Agent": "lexspark"} | ({} if body is None else {"Content-Type": "application/json"})

    def call() -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=TIMEOUT_SECONDS) as answer:
            return answer.read()

    return with_retries(call, retries, backoff)


class PagePartition(InputPartition):
    def __init__(self, page: int):
        super().__init__(page)


class PageReader(DataSourceReader):
    """Pages 1 .. totalPage of a listing that is asked for by POST; the first answer tells how many there are."""

    def __init__(self, options: dict):
        self.url = options["path"]
        self.payload = json.loads(options.get("payload", "{}"))
        self.retry = {"retries": int(options.get("retries", RETRIES)), "backoff": float(options.get("backoff", BACKOFF_SECONDS))}

    def page(self, number: int) -> dict:
        return json.loads(fetch(self.url, self.payload | {"pageNo": number}, **self.retry))["data"]

    def partitions(self) -> list[InputPartition]:
        return [PagePartition(n) for n in range(1, int(self.page(1)["page"]["totalPage"]) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self.page(partition.value).get("result", []):
            yield row.get("title"), str(row.get("idx", "")), row.get("stDate"), row.get("tableName")


class ListingSource(DataSource):
    """``spark.read.format("listing").option("payload", json).load(url)``: one partition a page, read by the executors."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The listing kept as JSON files, a page each, in any folder that Spark reads."""
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in ITEM.split(", "))
    page = F.from_json("value", f"struct<data: struct<result: array<struct<{fields}>>>, result: array<struct<{fields}>>>")
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(page.alias("p"))
    return text.select(F.inline(F.coalesce("p.data.result", "p.result")))


def file_links(pages: DataFrame, html: str = "html", pattern: str = FILE_LINK) -> DataFrame:
    """Adds (file_no, file_name, ext) of each page's last link, the current file; pages without one go."""
    numbers = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    names = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    out = pages.withColumns({"file_no": F.try_element_at(numbers, F.lit(-1)), "_name": F.try_element_at(names, F.lit(-1))}).filter(F.col("file_no").isNotNull())
    out = out.withColumn("file_name", strip(unescape_html(F.col("_name")))).drop("_name")
    return out.withColumn("ext", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)))


def resolved_files(listing: DataFrame, pages: DataFrame) -> DataFrame:
    """(title, type, file_no, file_name, revision, idx, ext) of the items whose page has a file."""
    files = file_links(pages).select("idx", "file_no", "file_name", "ext")
    return listing.join(files, "idx").select("title", ending_label(F.col("title")).alias("type"), "file_no", "file_name", F.coalesce("stDate", F.lit("")).alias("revision"), "idx", "ext")


def landed(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """The resolved items of which ``files`` (file_no, content) has no content yet."""
    have = files.filter(F.length("content") > 0).select("file_no").distinct()
    return resolved.join(have, "file_no", "left_anti")


def download_files(resolved: DataFrame, site: str, retries: int = RETRIES, backoff: float = BACKOFF_SECONDS) -> DataFrame:
    """(file_no, ext, content, error) of each item's file, fetched by the executors; a failure leaves content null and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes | None, str | None]] = []
            for number in batch.column("file_no").to_pylist():
                try:
                    found.append((fetch(site + FILE_PATH.format(number), None, retries, backoff), None))
                except OSError as e:
                    found.append((None, str(e)))
            columns = [batch.column("file_no"), batch.column("ext"), pa.array([c for c, _ in found], pa.binary()), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file_no", "ext", "content", "error"])

    return resolved.select("file_no", F.coalesce("ext", F.lit("hwp")).alias("ext")).mapInArrow(run, "file_no string, ext string, content binary, error string")


def read_landed(spark: SparkSession, folder: str) -> DataFrame:
    """(file_no, ext, content) of a folder of downloaded files named ``<number>.<ending>``."""
    name = F.substring_index("path", "/", -1)
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.substring_index(name, ".", 1).alias("file_no"), F.lower(F.substring_index(name, ".", -1)).alias("ext"), "content")
