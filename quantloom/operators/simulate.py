"""Path-dependent trades as folds over the rows that follow an entry; no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import simple_return
from ..schema import VARIANTS
from .audit import limit_flags
from .metrics import sharpe_returns
from .spine import by_ticker

MAX_HOLD = 7
ROLL = 20


def with_path(prices: DataFrame, rows: int = MAX_HOLD) -> DataFrame:
    """Prices with ``path``: low, high and close of the next rows."""
    return prices.withColumn("path", F.collect_list(F.struct("low", "high", "close")).over(by_ticker().rowsBetween(1, rows)))


def exit_return(entry: Column, path: Column, hold: Column, tp: Column, sl: Column) -> Column:
    """Return of a trade: stop loss first, then take profit, then the close at ``hold`` or the last row."""
    steps = F.slice(path, F.lit(1), hold)
    none = F.lit(None).cast("double")

    def step(acc: Column, day: Column) -> Column:
        hit = F.when(sl.isNotNull() & (day["low"] <= entry * (1 - sl)), -sl).when(tp.isNotNull() & (day["high"] >= entry * (1 + tp)), tp)
        return F.coalesce(acc, hit)

    level = F.aggregate(steps, none, step)
    return F.when(F.size(steps) > 0, F.coalesce(level, simple_return(F.element_at(steps, -1)["close"], entry)))


def tp_sl_trades(prices: DataFrame, hold: int, tp: float | None, sl: float | None) -> DataFrame:
    """(dt, ticker, ret) of a trade entered at every row that has a next one."""
    p = with_path(prices, hold)
    n = lambda v: F.lit(v).cast("double")
    return p.select("dt", "ticker", exit_return(F.col("close"), F.col("path"), F.lit(hold), n(tp), n(sl)).alias("ret")).where("ret is not null")


def limit_aware_trades(prices: DataFrame) -> DataFrame:
    """One-day trades: blocked at the upper limit; an exit locked at the lower limit rolls on, ROLL rows at most."""
    p = limit_flags(prices).withColumn("rn", F.row_number().over(by_ticker()))
    whole = by_ticker().rowsBetween(0, ROLL)
    free = F.min(F.when(~F.col("at_arb"), F.col("rn"))).over(by_ticker().rowsBetween(1, ROLL - 1))
    last = F.max("rn").over(whole)  # min(rn + ROLL, last row)
    p = p.withColumn("exit_rn", F.coalesce(free, last)).withColumn("__path", F.collect_list("close").over(by_ticker().rowsBetween(1, ROLL)))
    p = p.where(F.size("__path") > 0).withColumn("hold_days", F.col("exit_rn") - F.col("rn"))
    exit_close = F.element_at("__path", F.col("hold_days"))
    return p.select("dt", "ticker", F.col("at_ara").alias("blocked"), simple_return(F.element_at("__path", 1), "close").alias("naive_ret"), F.when(~F.col("at_ara"), simple_return(exit_close, "close")).alias("ret"), F.when(~F.col("at_ara"), F.col("hold_days")).alias("hold_days"))


def limit_report(trades: DataFrame) -> DataFrame:
    """Naive against limit-aware scores of the triggered trades, in one row."""
    c = lambda x: F.count(F.when(x, 1))
    base = trades.agg(F.count("*").alias("n_signals"), c(F.col("blocked")).alias("n_entry_blocked"), c(F.col("hold_days") > 1).alias("n_exit_delayed"), F.avg("hold_days").alias("mean_hold_days"))
    naive, real = sharpe_returns(trades, "naive_ret"), sharpe_returns(trades, "ret")
    named = lambda d, k: d.select(*[F.col(x).alias(f"{k}_{x}") for x in d.columns])
    return base.join(F.broadcast(named(naive, "naive"))).join(F.broadcast(named(real, "adjusted")))  # one row each


def search_holdout(df: DataFrame, frac: float = 0.7) -> DataFrame:
    """``df`` with ``part``: search for the first floor(frac * n) dates, holdout after."""
    from .spine import date_spine

    s = date_spine(df)
    n = s.agg(F.max("pos").alias("__n"))
    cut = s.join(F.broadcast(n)).select("dt", F.when(F.col("pos") <= F.floor(F.col("__n") * frac), "search").otherwise("holdout").alias("part"))
    return df.join(F.broadcast(cut), "dt")  # one row a date


def strategy_grid(preds: DataFrame, prices: DataFrame, variants=VARIANTS, frac: float = 0.7) -> DataFrame:
    """Score of every variant on both parts; preds: (dt, ticker, pred)."""
    v = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(t).alias("threshold"), F.lit(h).alias("hold"), F.lit(tp).cast("double").alias("tp"), F.lit(sl).cast("double").alias("sl")) for i, (t, h, tp, sl) in enumerate(variants, 1)])
    d = search_holdout(preds.where("pred is not null"), frac).where(F.col("pred") > min(t for t, *_ in variants))
    d = d.join(with_path(prices).select("dt", "ticker", "close", "path"), ["dt", "ticker"])
    d = d.select("*", F.explode(v).alias("v")).where(F.col("pred") > F.col("v.threshold"))
    d = d.select("part", "v.variant", exit_return(F.col("close"), F.col("path"), F.col("v.hold"), F.col("v.tp"), F.col("v.sl")).alias("ret")).where("ret is not null")
    return sharpe_returns(d, "ret", ["part", "variant"])


def grid_winner(grid: DataFrame) -> DataFrame:
    """The variant with the best search score, missing last, and its holdout score."""
    best = grid.where("part = 'search'").orderBy(F.desc_nulls_last("sharpe"), "variant").limit(1)
    held = grid.where("part = 'holdout'").select("variant", F.col("sharpe").alias("holdout_sharpe"), F.col("n_trades").alias("holdout_n"))
    return best.select("variant", F.col("sharpe").alias("search_sharpe"), F.col("n_trades").alias("search_n")).join(held, "variant", "left")
