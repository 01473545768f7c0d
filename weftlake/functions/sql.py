"""Functions for SQL: a scalar one for select lists, a table function for calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .calls import COMMENT, REF, SOURCE
from .select_list import select_columns

_PYTHON = {name: re.compile(p.replace("(?U)", "")) for name, p in (("ref", REF), ("source", SOURCE), ("comment", COMMENT))}


class LineageCalls:
    """A row (kind, package, name, table_name) for each ref and source call of a text."""

    def eval(self, sql: str | None) -> Iterator[tuple]:
        text = _PYTHON["comment"].sub("", sql or "")
        for a, b in _PYTHON["ref"].findall(text):
            yield ("ref", a if b else None, b or a, None)
        for a, b in _PYTHON["source"].findall(text):
            yield ("source", None, a, b)


def register(spark: SparkSession) -> None:
    """Make select_columns(sql) and the table function lineage_calls(sql) known to SQL."""
    spark.udf.register("select_columns", select_columns)
    spark.udtf.register("lineage_calls", F.udtf(LineageCalls, returnType="kind string, package string, name string, table_name string"))
