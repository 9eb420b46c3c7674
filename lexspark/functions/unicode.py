"""The two text functions that Spark has no expression for, as Arrow functions."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(text: Column) -> Column:
    """Unicode NFC, batch by batch; apply once where text comes in."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())

    return run(text)


def unescape_html(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())

    return run(text)
