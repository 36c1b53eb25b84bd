"""Price audit: contamination detectors, quarantine, gap-guarded returns, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ara_bound, reasons, simple_return
from ..schema import ARB
from .spine import by_ticker, date_spine, with_position

KEYS = ["dt", "ticker"]
BAR = ["open", "high", "low", "close", "volume"]
LIMIT_SLACK = 0.005


def limit_flags(prices: DataFrame, slack: float = 0.01) -> DataFrame:
    """(.., prev_close, pct, at_ara, at_arb): closes locked at the daily limits."""
    p = prices.withColumn("prev_close", F.lag("close").over(by_ticker())).withColumn("pct", simple_return("close", "prev_close"))
    up = F.coalesce(F.col("pct") >= ara_bound("prev_close") - slack, F.lit(False))
    down = F.coalesce(F.col("pct") <= ARB + slack, F.lit(False))
    return p.withColumn("at_ara", up).withColumn("at_arb", down)


def detect(prices: DataFrame) -> DataFrame:
    """Prices with limit_violation, cross_ticker_dup, series_break, suspect and reasons."""
    around = by_ticker().rowsBetween(-10, 10)
    same = Window.partitionBy("dt", *BAR)
    whole = F.lit(True)
    for c in BAR:
        whole = whole & F.col(c).isNotNull()
    p = prices.withColumn("__pct", simple_return("close", prev := F.lag("close").over(by_ticker()))).withColumn("__prev", prev)
    p = p.withColumn("__mid", F.when(F.count("close").over(around) >= 5, F.expr("percentile(close, 0.5)").over(around)))
    no = F.lit(False)
    p = p.withColumn("limit_violation", F.coalesce((F.col("__pct") > ara_bound("__prev") + LIMIT_SLACK) | (F.col("__pct") < ARB - LIMIT_SLACK), no))
    p = p.withColumn("cross_ticker_dup", whole & (F.count("*").over(same) > 1))
    by_mid = F.try_divide(F.col("close"), F.nullif("__mid", F.lit(0.0)))
    p = p.withColumn("series_break", F.coalesce((by_mid > 5) | (by_mid < 0.2), no)).drop("__pct", "__prev", "__mid")
    p = p.withColumn("suspect", F.col("limit_violation") | F.col("cross_ticker_dup") | F.col("series_break"))
    return p.withColumn("reasons", reasons(limit_violation="limit_violation", cross_ticker_dup="cross_ticker_dup", series_break="series_break"))


def suspects_by_ticker(audited: DataFrame, top: int = 15) -> DataFrame:
    bad = F.sum(F.col("suspect").cast("long"))
    g = audited.groupBy("ticker").agg(bad.alias("n_suspect"), F.count("*").alias("n_rows"), (100.0 * bad / F.count("*")).alias("pct"))
    return g.where("n_suspect > 0").orderBy(F.desc("n_suspect"), "ticker").limit(top)


def suspects_by_detector(audited: DataFrame) -> DataFrame:
    return audited.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("limit_violation", "cross_ticker_dup", "series_break", "suspect")])


def collision_groups(audited: DataFrame) -> DataFrame:
    """Tickers that share one bar on one date."""
    g = audited.where("cross_ticker_dup").groupBy("dt", *BAR).agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"), F.count("*").alias("n"))
    return g


def clean_prices(prices: DataFrame, quarantine: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Prices without quarantined keys; without a quarantine table the detectors decide, or strict raises."""
    if quarantine is None:
        if strict:
            raise ValueError("no quarantine table")
        quarantine = detect(prices).where("suspect")
    return prices.join(quarantine.select(*KEYS).distinct(), KEYS, "left_anti")


def suspect_flow_rows(flow: DataFrame, audited: DataFrame) -> DataFrame:
    """Flow rows that ride on suspect prices."""
    return flow.join(audited.where("suspect").select(*KEYS).distinct(), KEYS, "left_semi")


def _guarded(value: Column, ok: Column) -> Column:
    return F.when(ok, value)


def forward_returns(prices: DataFrame, spine: DataFrame, horizons=(1,), extremes: bool = False) -> DataFrame:
    """fwd_h over exactly h positions of the global axis, or NULL; with extremes also max_h and mdd_h of rows +1..+h.

    ``spine`` must come from the unfiltered table: a removed row leaves a gap that no return bridges.
    """
    p = with_position(prices, spine)
    out = []
    for h in horizons:
        ok = F.lead("pos", h).over(by_ticker()) - F.col("pos") == h
        out.append(_guarded(simple_return(F.lead("close", h).over(by_ticker()), "close"), ok).alias(f"fwd_{h}"))
        if extremes:
            w = by_ticker().rowsBetween(1, h)
            out.append(_guarded(simple_return(F.max("high").over(w), "close"), ok).alias(f"max_{h}"))
            out.append(_guarded(simple_return(F.min("low").over(w), "close"), ok).alias(f"mdd_{h}"))
    return p.select(*prices.columns, *out)


def lagged_returns(prices: DataFrame, spine: DataFrame, lags=(1,)) -> DataFrame:
    p = with_position(prices, spine)
    out = [_guarded(simple_return("close", F.lag("close", k).over(by_ticker())), F.col("pos") - F.lag("pos", k).over(by_ticker()) == k).alias(f"lag_{k}") for k in lags]
    return p.select(*prices.columns, *out)


def clean_panel(prices: DataFrame, horizons=(1,), lags=(), extremes: bool = False, quarantine: DataFrame | None = None, strict: bool = False) -> DataFrame:
    spine = date_spine(prices)
    p = forward_returns(clean_prices(prices, quarantine, strict), spine, horizons, extremes)
    return lagged_returns(p, spine, lags) if lags else p


def _unique_corrections(fix: DataFrame) -> DataFrame:
    """Corrections by key; a key given twice raises when it is read."""
    twice = F.raise_error(F.lit("a correction key is given twice")).cast("double")
    g = fix.groupBy(*KEYS).agg(F.count("*").alias("__n"), *[F.first(c, ignorenulls=True).alias(c) for c in BAR if c in fix.columns])
    return g.withColumn("close", F.when(F.col("__n") > 1, twice).otherwise(F.col("close"))).drop("__n")


def repair_prices(prices: DataFrame, fix: DataFrame) -> DataFrame:
    """Bars replaced by corrections of the same key; a missing correction keeps the old value."""
    f = _unique_corrections(fix)
    f = f.select(*KEYS, *[F.col(c).alias(f"__{c}") for c in BAR if c in f.columns])
    j = prices.join(f, KEYS, "left")
    return j.select(*KEYS, *[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in j.columns else F.col(c) for c in BAR])


def rescale_netval(flow: DataFrame, prices: DataFrame, fix: DataFrame) -> DataFrame:
    """Backfilled flows (bval null) scaled by new over old close, where that changed."""
    old = prices.select(*KEYS, F.col("close").alias("__old"))
    s = _unique_corrections(fix).select(*KEYS, F.col("close").alias("__new")).join(old, KEYS).where("__old > 0 and __new > 0")
    s = s.select(*KEYS, (F.col("__new") / F.col("__old")).alias("__scale")).where("abs(__scale - 1) > 1e-9")
    j = flow.join(s, KEYS, "left")
    new = F.when(F.col("bval").isNull() & F.col("__scale").isNotNull(), F.col("netval") * F.col("__scale")).otherwise(F.col("netval"))
    return j.select(*[new.alias("netval") if c == "netval" else F.col(c) for c in flow.columns])
