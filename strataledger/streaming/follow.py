"""A folder of reports as a stream: files are read once each, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataledger.sources.folder import described
from strataledger.sources.tables import Warehouse
from strataledger.sources.warehouse import ingest

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def follow(
    spark: SparkSession, folder: str, house: Warehouse, read: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], checkpoint: str
) -> StreamingQuery:
    """Ingest what has arrived since the last run, and stop.

    ``read`` is as ``warehouse.ingest`` takes it; ids go by the files of a batch. A batch that is run again after a failure
    merges the same rows under the same keys, so nothing counts twice.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).load(folder)

    def step(batch: DataFrame, _: int) -> None:
        ingest(house, described(batch).withColumn("length", F.col("size")), read)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
