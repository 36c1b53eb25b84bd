"""The global date axis and per-ticker windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("dt")


def date_spine(prices: DataFrame) -> DataFrame:
    """(dt, pos): every distinct date, numbered from 1. One row a date, so one task is enough."""
    return prices.select("dt").where("dt is not null").distinct().withColumn("pos", F.row_number().over(Window.orderBy("dt")))


def with_position(df: DataFrame, spine: DataFrame) -> DataFrame:
    """``df`` with its place on the axis; the axis has one row a calendar date, 40,000 a century."""
    return df.join(F.broadcast(spine), "dt")


#: Rows of a ticker that one window group holds, and days that one count of rows holds.
BLOCK_ROWS, SPAN_DAYS = 4096, 366
_MARK = "\x1f"


def numbered(df: DataFrame, span_days: int = SPAN_DAYS) -> DataFrame:
    """``df`` with ``__row``, the place of a row in its ticker from 0, by dt.

    Rows are counted in spans of days; only the spans of a ticker are in one window, so no
    task holds a ticker's whole history.
    """
    d = df.withColumn("__span", F.floor(F.datediff("dt", F.lit("1970-01-01").cast("date")) / span_days))
    n = d.groupBy("ticker", "__span").agg(F.count("*").alias("__n"))
    n = n.select("ticker", "__span", (F.sum("__n").over(Window.partitionBy("ticker").orderBy("__span")) - F.col("__n")).alias("__before"))
    d = d.withColumn("__row", F.row_number().over(Window.partitionBy("ticker", "__span").orderBy("dt"))).join(n, ["ticker", "__span"])
    return d.withColumn("__row", F.col("__before") + F.col("__row") - 1).drop("__span", "__before")


def in_blocks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], back: int, ahead: int, rows: int = BLOCK_ROWS, span_days: int = SPAN_DAYS) -> DataFrame:
    """What ``operator`` gives for a table of (dt, ticker), computed in blocks of a ticker's rows.

    For operators whose windows run over one ticker by dt and reach at most ``back`` rows back
    and ``ahead`` rows ahead, and which return dt, ticker and
    one row for each they got. A block is a ticker of its own to the operator: its rows and, as a halo, as many rows before and after as the windows reach.
    The halo's results are dropped. So a long history is many tasks, and the results are the
    same at any size of block. Rows without a date or ticker go; a (dt, ticker) comes once.
    """
    d = numbered(df.where("dt is not null and ticker is not null"), span_days)
    own = F.floor(F.col("__row") / rows)
    lo, hi = F.greatest(F.floor((F.col("__row") - ahead) / rows), F.lit(0).cast("long")), F.floor((F.col("__row") + back) / rows)
    d = d.withColumn("__own", own).withColumn("__block", F.explode(F.sequence(lo, hi)))
    mark = F.concat("ticker", F.lit(_MARK), F.col("__block").cast("string"))
    bounds = d.where("__own = __block").groupBy(mark.alias("ticker")).agg(F.min("dt").alias("__from"), F.max("dt").alias("__to"))
    out = operator(d.withColumn("ticker", mark).drop("__row", "__own", "__block"))
    kept = out.join(bounds, "ticker").where("dt between __from and __to").drop("__from", "__to")
    return kept.withColumn("ticker", F.substring_index("ticker", _MARK, 1)).select(*out.columns)
