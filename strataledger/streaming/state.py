"""Losses as a stream: each once, in sessions, and into a table of a workspace exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataledger.sources.tables import Warehouse


def first_of_each(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row to arrive of each key; a key is remembered until the watermark, ``delay`` behind the latest ``at``,
    has passed its row. Rows behind the watermark are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str) -> DataFrame:
    """``keys, begun, ended, n, hours`` of runs of rows of a key without a ``gap``; one row each, once the watermark has
    passed its end. Rows in time extend or join sessions that are still open; rows behind the watermark are dropped."""
    marked = stream.withWatermark(at, delay)
    groups = marked.groupBy(F.session_window(at, gap).alias("w"), *keys)
    sums = groups.agg(F.count("*").alias("n"), F.sum("hours").alias("hours"))
    return sums.select(*keys, F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "n", "hours")


def into_table(stream: DataFrame, house: Warehouse, table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Merge what has arrived since the last run into a table by its key, and stop.

    A batch that is run again after a failure merges the same rows under the same keys, so each counts once.
    """

    def step(batch: DataFrame, _: int) -> None:
        house.merge(table, batch, key)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
