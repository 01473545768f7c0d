"""Run results that arrive as files, merged into a table of statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import status
from ..runtime import cut
from ..schemas import RUN_RESULTS
from ..sources.artifacts import explode_results


def follow(spark: SparkSession, folder: str, nodes: DataFrame, modified: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Note the statuses that each new file of the folder brings at target, in folders v=0, v=1, ...; processes what is there.

    The first folder has a status of every node, later ones only those of nodes that have new results. A batch that is run
    again after a failure writes the same folder again. compact() makes them one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        results = explode_results(batch.orderBy(F.col("path"))).withColumn("seq", F.monotonically_increasing_id())
        new = status.statuses(nodes, results, modified)
        first = not [v for v in versions(spark, target) if v < number]
        (new if first else new.where("status != 'never_run'")).write.mode("overwrite").parquet(f"{target}/v={number}")

    stream = spark.readStream.schema(RUN_RESULTS).option("multiLine", True).json(folder).withColumn("path", F.col("_metadata.file_path"))
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getName()[2:]) for s in system.listStatus(path) if s.getPath().getName().startswith("v=")] if system.exists(path) else []


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The last status of each node."""
    found = versions(spark, target)
    if not found:
        return None
    table = spark.read.option("basePath", target).parquet(*(f"{target}/v={v}" for v in sorted(found)))
    return table.groupBy("unique_id").agg(F.max_by(F.struct(*[c for c in status.FIELDS if c != "unique_id"]), "v").alias("s")).select("unique_id", "s.*")


def compact(spark: SparkSession, target: str) -> None:
    """Write the last statuses over the newest folder and delete the others, between runs of follow()."""
    found = sorted(versions(spark, target))
    if len(found) > 1:
        cut(current(spark, target)).write.mode("overwrite").parquet(f"{target}/v={found[-1]}")
        for v in found[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
