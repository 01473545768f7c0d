"""Where lineage is cut on a cluster, and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 24 << 20
_WRITTEN: list[list[str]] = []
_TABLES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one only where none is set and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftlake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, by: str | None = None, folders: str | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read back: later failures don't recompute what came before.

    With a column the rows are written in buckets of its values, as many as there are shuffle partitions, so that joins on it
    don't exchange them again. With folders, each value of that column has one of its own, and filters on it read only that.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}"
    if by is None:
        df.write.option("compression", "zstd").partitionBy(*[folders] if folders else []).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"weftlake_{name}"
        df.repartition(parts, by).write.option("compression", "zstd").bucketBy(parts, by).option("path", path).format("parquet").saveAsTable(table)
        _TABLES[path] = table
        out = spark.table(table)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    out._written, out._by = path, by
    return out


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """The table itself if cut() wrote it in buckets of the column, else cut so."""
    return df if getattr(df, "_by", None) == by else cut(df, by)


def held(df: DataFrame) -> DataFrame:
    """A hint for the smaller side of a join: broadcast if light, else each task holds its part, so that the other side isn't sorted."""
    near = light(df)
    return near if near is not df else df.hint("shuffle_hash")


def _delete(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote; nothing that reads it may be run again."""
    _delete(df.sparkSession, df._written)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what cut() has written meanwhile. For callers whose results are written or collected by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            _delete(spark, path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the table's size, from the files' sizes; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def light(df: DataFrame) -> DataFrame:
    """A hint to broadcast a written table, if its measured size allows (in memory it takes several times its size on disk)."""
    return F.broadcast(df) if 4 * plan_bytes(df) <= BROADCAST_BYTES else df
