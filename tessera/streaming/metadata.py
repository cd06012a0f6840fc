"""Streaming forms of the table operators: metadata upserts, and scalars as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import upsert


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a batch."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place", order)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "dataset", order: str = "version") -> StreamingQuery:
    """K7 as a stream: each batch's last rows replace those of the same keys. A batch that runs again gives the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(batch.sparkSession, path, latest(batch, key, order), key)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", tag: str = "event_type", value: str = "value", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """W14's input as a stream: counts and means of tags over windows of event time, late rows within a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), tag).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), tag, "n", "mean")
