"""Position policies played over each ticker's days with exchange limits and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HOLD, COST, LOSS_AVERSION, LEAST_ROWS = 7, 0.0015, 1.5, 10


def _played(days: DataFrame, max_hold: int, cost: float, aversion: float, least: int, path: bool = False) -> DataFrame:
    """(ticker, d, s): a ticker's ordered days and the state after its last step; with the path of filled days, which copies it at each step."""
    day = F.struct("dt", F.coalesce("action", F.lit(0)).cast("int").alias("action"), F.coalesce("at_ara", F.lit(False)).alias("up"), F.coalesce("at_arb", F.lit(False)).alias("down"), F.coalesce("daily_return", F.lit(0.0)).alias("r"))
    g = days.groupBy("ticker").agg(F.array_sort(F.collect_list(day)).alias("d")).where(F.size("d") >= least)
    none = F.array().cast("array<struct<dt:date,pos:int,r:double>>")
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("held"), F.lit(0.0).alias("reward"), F.lit(0).alias("trades"), F.lit(0.0).alias("realized"), *[none.alias("path")] * path)
    d = F.col("d")

    def step(s: Column, t: Column) -> Column:
        now, nxt = F.get(d, t), F.get(d, t + 1)
        wish = F.when((s["pos"] == 1) & (s["held"] >= max_hold), 0).otherwise(now["action"])
        filled = F.when((wish == 1) & (s["pos"] == 0) & ~now["up"], 1).when((wish == 0) & (s["pos"] == 1) & ~now["down"], 0).otherwise(s["pos"])
        changed = (filled != s["pos"]).cast("int")
        r = F.when(t + 1 < F.size(d) - 1, nxt["r"]).otherwise(0.0)
        pnl = filled * r
        gain = F.when(pnl < 0, pnl * aversion).otherwise(pnl)
        return F.struct(
            filled.cast("int").alias("pos"),
            F.when(filled == 1, s["held"] + 1).otherwise(0).cast("int").alias("held"),
            (s["reward"] + gain - changed * cost).cast("double").alias("reward"),
            (s["trades"] + changed).cast("int").alias("trades"),
            (s["realized"] + pnl).cast("double").alias("realized"),
            *([F.array_append(s["path"], F.struct(now["dt"].alias("dt"), filled.cast("int").alias("pos"), pnl.cast("double").alias("r"))).alias("path")] if path else []),
        )

    return g.select("ticker", "d", F.aggregate(F.sequence(F.lit(0), F.size(d) - 2), start, step).alias("s"))


def rollout(days: DataFrame, max_hold: int = MAX_HOLD, cost: float = COST, aversion: float = LOSS_AVERSION, least: int = LEAST_ROWS) -> DataFrame:
    """(ticker, steps, reward, trades, realized): days (dt, ticker, action, at_ara, at_arb, daily_return).

    At each day's close the wished position is filled unless the limit locks it (no buying
    at the upper, no selling at the lower limit); a position held max_hold days is to be
    left; the next day's return is earned, losses weigh more, a change costs. The return of
    the last day is not earned. A ticker's days are one bounded array and one fold.
    """
    p = _played(days, max_hold, cost, aversion, least)
    return p.select("ticker", (F.size("d") - 1).alias("steps"), "s.reward", "s.trades", "s.realized")


def trade_log(days: DataFrame, max_hold: int = MAX_HOLD, least: int = LEAST_ROWS) -> DataFrame:
    """(ticker, trade, entry_dt, exit_dt, days_held, ret): the trades of a rollout; exit_dt is NULL while one is open."""
    p = _played(days, max_hold, COST, LOSS_AVERSION, least, path=True).select("ticker", F.explode("s.path").alias("x")).select("ticker", "x.*")
    w = Window.partitionBy("ticker").orderBy("dt")
    before = F.coalesce(F.lag("pos").over(w), F.lit(0))
    p = p.withColumn("__in", ((F.col("pos") == 1) & (before == 0)).cast("int")).withColumn("trade", F.sum("__in").over(w)).withColumn("__out", F.when((F.col("pos") == 0) & (before == 1), F.col("dt")))
    g = p.where("trade > 0").groupBy("ticker", "trade")
    held = F.col("pos") == 1
    return g.agg(F.min(F.when(held, F.col("dt"))).alias("entry_dt"), F.min("__out").alias("exit_dt"), F.count(F.when(held, 1)).alias("days_held"), (F.product(F.when(held, 1 + F.col("r")).otherwise(1.0)) - 1).alias("ret"))
