"""Typed scans of the engine's tables and of landed captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHART, CORRECTIONS, SIGNALS
from .sinks import _exists


def read_table(spark: SparkSession, path: str, schema, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table of a declared schema; only ``columns`` are read."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_panel(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows with a close."""
    return read_table(spark, path, schema, ["dt", "ticker", "close", "high", "low"]).where("close is not null")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals with their sources as an array; no table gives no rows."""
    df = spark.read.schema(SIGNALS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], SIGNALS)
    return df.withColumn("source_list", F.split("sources", ","))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections from CSV; date, ticker and close are required."""
    head = spark.read.option("header", True).csv(path).columns
    missing = {"date", "ticker", "close"} - set(head)
    if missing:
        raise ValueError(f"corrections lack {', '.join(sorted(missing))}")
    types = dict(x.strip().split(" ") for x in CORRECTIONS.split(","))
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in head)
    known = [c for c in head if c in types]
    return spark.read.option("header", True).schema(schema).csv(path).select(*known).withColumnRenamed("date", "dt")


def read_pages(spark: SparkSession, path: str, schema: str, max_pages: int = 25) -> DataFrame:
    """Landed result pages {"page": n, "data": [..]}: rows of the first ``max_pages`` pages."""
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in schema.split(","))
    d = spark.read.schema(f"page int, data array<struct<{fields}>>").option("multiLine", True).json(path)
    return d.where(F.col("page") <= max_pages).select("page", F.explode("data").alias("r")).select("page", "r.*")


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHART).json(path)


def chart_prices(charts: DataFrame) -> DataFrame:
    """Bars of landed charts, long form."""
    from ..functions.scalars import ticker_from_title

    z = F.explode(F.arrays_zip("price.x", "price.open", "price.high", "price.low", "price.close", "volume.y")).alias("b")
    d = charts.select(ticker_from_title("title").alias("ticker"), z)
    return d.select(F.col("b.x").alias("dt"), "ticker", "b.open", "b.high", "b.low", "b.close", F.col("b.y").alias("volume"))


def chart_traces(charts: DataFrame) -> DataFrame:
    """Cumulated lots of each broker, long form."""
    from ..functions.scalars import clean_code, ticker_from_title

    d = charts.select(ticker_from_title("title").alias("ticker"), F.explode("brokers").alias("k"))
    d = d.select("ticker", clean_code("k.name").alias("broker_code"), F.explode(F.arrays_zip("k.x", "k.cum_lot")).alias("p"))
    return d.select(F.col("p.x").alias("dt"), "ticker", "broker_code", "p.cum_lot")
