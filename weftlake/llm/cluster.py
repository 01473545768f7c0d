"""Running on a cluster: how many partitions, and joins that broadcast only what is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import BROADCAST_BYTES, cut, light, plan_bytes, shared_dir

__all__ = ["BROADCAST_BYTES", "cut", "documents", "join_small", "light", "parts", "plan_bytes", "shared_dir"]


def parts(df: DataFrame, bytes_each: int = 12 << 20) -> int:
    """Partitions in proportion to the input, never fewer than the session's."""
    estimate = plan_bytes(df)
    wanted = -(-estimate // bytes_each) if estimate < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted, 1)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a written table, broadcast only if its measured size allows."""
    return big.join(light(small), on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
