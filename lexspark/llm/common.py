"""Shared pieces: hashing, the shared folder, tokenizer access, materialisation."""

from __future__ import annotations

import contextlib
import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere are runs of characters other than ASCII white space.
WORD_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset in a session of one machine (a test) is a folder under /tmp chosen and
    set; on a cluster each executor would write to a disk of its own, so that is a RuntimeError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/lexspark-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", folder)
        delete_on_exit(spark, folder)
    return folder


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


#: Paths written inside each open :func:`scratch`, the innermost last.
_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that :func:`materialize` writes inside are deleted at the end, but for those it is told to keep.

    What leaves the block must be kept, or depend on kept tables only.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors: later stages read
    complete files, never one executor's blocks. Inside a :func:`scratch` the table
    goes with it; with ``keep``, with the scratch around that one, if any, or with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    owners = _scratch[:-1] if keep else _scratch
    if owners:
        owners[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; one cheap aggregate over one column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


#: Up to FEW chunks are made whatever the table; more only where a message from each to each takes MESSAGE_BYTES of text or more.
FEW, MESSAGE_BYTES = 16, 1 << 14


def chunk_count(docs: DataFrame, chunk_bytes: int, text: str = "text") -> int:
    """How many chunks of about ``chunk_bytes`` the table makes; at least one per shuffle partition, if the table has text enough.

    Chunks exchange messages with as many buckets, so their number is squared. The session's
    partitions alone don't make many small messages: up to chunk_bytes ** 2 / MESSAGE_BYTES of
    text (9 GB for 12 MB) there is at most one for each MESSAGE_BYTES, or FEW ** 2. The session
    setting ``lexspark.chunk.bytes`` replaces ``chunk_bytes``: executors with more memory take larger chunks.
    """
    conf = docs.sparkSession.conf
    size, total = int(conf.get("lexspark.chunk.bytes", str(chunk_bytes))), text_bytes(docs, text)
    partitions = int(conf.get("spark.sql.shuffle.partitions", "200"))
    return max(min(partitions, max(FEW, math.isqrt(total // MESSAGE_BYTES))), math.ceil(total / size))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
