"""Streams: late-tolerant daily summaries of events, upserted into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import upsert


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_summary(events: DataFrame, late: str = "2 days", time_col: str = "ts", user_col: str = "user_id", value_col: str = "value") -> DataFrame:
    """(dt, ticker, n, total, high, low) by day and user; events later than ``late`` are left out of a stream."""
    e = events.withColumn(time_col, F.col(time_col).cast("timestamp"))  # a watermark needs an instant
    e = e.withWatermark(time_col, late) if events.isStreaming else e
    g = e.groupBy(F.window(time_col, "1 day").alias("w"), F.concat(F.lit("U"), F.col(user_col).cast("string")).alias("ticker"))
    d = g.agg(F.count("*").alias("n"), F.sum(F.col(value_col).cast("decimal(18,2)")).cast("double").alias("total"), F.max(value_col).alias("high"), F.min(value_col).alias("low"))
    return d.select(F.to_date("w.start").alias("dt"), "ticker", "n", "total", "high", "low")


def upsert_stream(summary: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("dt", "ticker")) -> StreamingQuery:
    """Merges each batch's updated days into the table. A batch that runs again writes the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(batch, path, list(keys))

    return summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
