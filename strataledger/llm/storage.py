"""Sizes of tables, and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataledger.sources.storage import new_path, remove, shared_dir, written, written_at

__all__ = ["estimated_bytes", "new_path", "partitions_for", "remove", "shared_dir", "shuffle_partitions", "written", "written_at"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for dealing ``df`` out: the session's number, more if each would exceed ``bytes_each``."""
    return max(shuffle_partitions(df.sparkSession), min(200_000, estimated_bytes(df) // bytes_each + 1))
