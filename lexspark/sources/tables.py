"""Tables in folders that the driver and all executors share: intermediate ones, and versions behind one pointer."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session of one machine may leave it unset: it gets a folder that goes with it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/lexspark-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", folder)
        delete_at_end(spark, folder)
    return folder


def delete_at_end(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a session's tables, deleted with the session."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from files in the shared folder: they are computed once, and a lost executor takes none of them along."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table as a stream of what it has now, whether it is a folder or one file (streams read folders)."""
    fs, where = _file_system(spark, path)
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(path.rpartition("/")[0])


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says (``version`` and what was noted with it); None before the first version."""
    fs, where = _file_system(spark, f"{path}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, said: dict) -> None:
    """Replace the pointer in one step: readers see the old one or the new one."""
    jvm = spark._jvm
    fs, fresh = _file_system(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(json.dumps(said).encode()))
    finally:
        out.close()
    overwrite = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), overwrite)


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2, **noted: object) -> str:
    """Make a version: ``write(folder)`` writes all its tables into a new folder, then the pointer moves to it.

    If ``write`` fails, the pointer stays and the half-written folder goes. ``noted`` is kept in
    the pointer. The ``keep`` latest versions that it named stay, so that readers of the one before
    can end; all other version folders go. Only one writer at a time may publish to a path.
    """
    before = read_pointer(spark, path)
    name = f"v{(int(before['version'][1:9]) if before else 0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    fs, folder = _file_system(spark, f"{path}/{name}")
    try:
        write(f"{path}/{name}")
    except BaseException:
        fs.delete(folder, True)
        raise
    history = [name, *((before["history"]) if before else [])][:keep]
    _point(spark, path, {**noted, "version": name, "history": history})
    found = [s.getPath().getName() for s in fs.listStatus(folder.getParent())]
    for old in found:
        if re.fullmatch(r"v\d{8}-[0-9a-f]{8}", old) and old not in history:
            fs.delete(_file_system(spark, f"{path}/{old}")[1], True)
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that the pointer names; FileNotFoundError before the first."""
    said = read_pointer(spark, path)
    if said is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return f"{path}/{said['version']}"
