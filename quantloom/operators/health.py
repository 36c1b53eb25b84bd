"""Quality checks. Each row: check, metric, value, ok. "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_equity_code, weekdays_between
from .audit import detect


def freshness(tables: dict[str, DataFrame], today: str, limit: int = 2, date_col: str = "dt") -> DataFrame:
    """Newest date of each table and the weekdays since."""
    out = None
    for name, df in tables.items():
        d = df.agg(F.max(date_col).alias("latest")).select(F.lit(name).alias("table_name"), "latest")
        out = d if out is None else out.unionByName(d)
    stale = weekdays_between("latest", F.lit(today).cast("date")).cast("long")
    return out.withColumn("stale_weekdays", stale).withColumn("ok", F.coalesce(stale <= limit, F.lit(False)))


def latest_dates(df: DataFrame, n: int, date_col: str = "dt") -> DataFrame:
    return df.select(date_col).distinct().orderBy(F.desc(date_col)).limit(n)


def new_contamination(prices: DataFrame, quarantine: DataFrame, days: int = 10) -> DataFrame:
    """Suspects of the latest price dates that are not quarantined yet."""
    bad = detect(prices).where("suspect").join(F.broadcast(latest_dates(prices, days)), "dt", "left_semi")
    return bad.join(quarantine.select("dt", "ticker"), ["dt", "ticker"], "left_anti").select("dt", "ticker", "reasons")


def cross_source(summary: DataFrame, prices: DataFrame, tolerance: float = 0.001, least: int = 15, offsets=(0, 1, 2)) -> DataFrame:
    """Agreement of two captures of the close at each day offset; is_best marks the first highest."""
    m = summary.where("close > 0").select(F.explode(F.array(*map(F.lit, offsets))).alias("day_offset"), "dt", "ticker", F.col("close").alias("a"))
    m = m.select("day_offset", F.date_sub("dt", F.col("day_offset")).alias("dt"), "ticker", "a")
    p = prices.where("close > 0").select("dt", "ticker", F.col("close").alias("b"))
    agree = (F.abs(F.col("b") / F.col("a") - 1) <= tolerance).cast("double")
    g = m.join(p, ["dt", "ticker"]).groupBy("day_offset").agg(F.count("*").alias("n"), F.avg(agree).alias("agreement"))
    best = g.where(F.col("n") >= least).agg(F.max_by("day_offset", F.struct("agreement", -F.col("day_offset"))).alias("__best"))
    return g.join(F.broadcast(best)).select("day_offset", "n", "agreement", F.coalesce(F.col("day_offset") == F.col("__best"), F.lit(False)).alias("is_best"))


def cross_source_verdict(summary: DataFrame, prices: DataFrame, expected: int = 1, least_share: float = 0.85, tolerance: float = 0.001, least: int = 15) -> DataFrame:
    """(check, ok, metric, value, limit_value, detail): the agreement at the best offset, and that it is the expected one.

    With under ``least`` pairs at every offset one row says that the check was skipped, and with how many.
    """
    best = F.max(F.when(F.col("is_best"), F.struct("day_offset", "n", "agreement")))
    g = cross_source(summary, prices, tolerance, least).agg(best.alias("b"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    row = lambda ok, metric, value, limit, detail: F.struct(F.lit("cross_source").alias("check"), ok.alias("ok"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit_value"), detail.alias("detail"))
    share = row(F.col("b.agreement") >= least_share, "agreement", F.col("b.agreement"), least_share, F.concat(F.lit("pairs: "), F.col("b.n").cast("string")))
    offset = row(F.col("b.day_offset") == expected, "day_offset", F.col("b.day_offset"), expected, F.lit("days between the captures"))
    skipped = row(F.lit(None).cast("boolean"), "skipped", F.col("most"), least, F.lit("too few pairs"))
    return g.select(F.explode(F.when(F.col("b").isNotNull(), F.array(share, offset)).otherwise(F.array(skipped))).alias("r")).select("r.*")


def cross_source_worst(summary: DataFrame, prices: DataFrame, day_offset: int = 1, k: int = 4) -> DataFrame:
    """The k pairs that differ most at an offset; ties by date and ticker."""
    a = summary.where("close > 0").select(F.date_sub("dt", day_offset).alias("dt"), "ticker", F.col("close").alias("a"))
    b = prices.where("close > 0").select("dt", "ticker", F.col("close").alias("b"))
    return a.join(b, ["dt", "ticker"]).withColumn("differs", F.abs(F.col("b") / F.col("a") - 1)).orderBy(F.desc("differs"), "dt", "ticker").limit(k)


def capture_verdict(summary: DataFrame, critical: list[str], signals: DataFrame, today: str, target: str, low: int = 80, high: int = 400, least_share: float = 0.9, stale_limit: int = 2, wanted: int = 100) -> DataFrame:
    """(check, ok, metric, value, limit_value, detail) of the capture, all from the latest date unless it says otherwise.

    Its age in weekdays, rows, codes that are no equity, share of every critical field (NULL
    for one that is no column), signals logged and those outside the panel, and the signals
    projected to the target date. An empty summary gives one row that is not ok.
    """
    span = summary.agg(F.min("dt").alias("__first"), F.max("dt").alias("__last"), F.countDistinct("dt").alias("days"))  # one row
    d = summary.join(F.broadcast(span.select("__last"))).where(F.col("dt") == F.col("__last"))
    present = [c for c in critical if c in summary.columns]
    g = d.agg(F.count("*").cast("double").alias("rows"), F.count(F.when(~is_equity_code("ticker"), 1)).cast("double").alias("junk"), *[F.try_divide(F.count(c), F.count("*")).alias(f"share:{c}") for c in present])
    inside = d.select("ticker", F.lit(1).alias("__in")).distinct()
    s = signals.join(F.broadcast(span.select("__first", "__last"))).where(F.col("flag_date") >= F.col("__first"))
    now = F.col("flag_date") == F.col("__last")
    logged = s.join(inside, "ticker", "left").agg(F.count("*").cast("double").alias("signals"), F.count(F.when(now, 1)).cast("double").alias("logged"), F.count(F.when(now & F.col("__in").isNull(), 1)).cast("double").alias("outside"))
    left = weekdays_between(F.lit(today).cast("date"), F.lit(target).cast("date")).cast("double")
    age = weekdays_between("__last", F.lit(today).cast("date")).cast("double")
    one = span.join(F.broadcast(g)).join(F.broadcast(logged))  # one row each
    row = lambda metric, value, ok, limit, detail: F.struct(F.lit("capture").alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(metric).alias("metric"), value.alias("value"), F.lit(float(limit)).alias("limit_value"), F.lit(detail).alias("detail"))
    projected = F.floor(F.col("signals") + F.col("signals") / F.greatest("days", F.lit(1)) * left).cast("double")
    rows = [
        row("stale_weekdays", age, age <= stale_limit, stale_limit, "weekdays since the newest day"),
        row("rows", F.col("rows"), F.col("rows").between(low, high), low, f"{low} to {high}"),
        row("junk_codes", F.col("junk"), F.col("junk") == 0, 0, "codes that are no equity"),
        row("signals_logged", F.col("logged"), F.col("logged") > 0, 1, "signals of the newest day"),
        row("signals_outside", F.col("outside"), F.col("outside") == 0, 0, "signals of names that were not captured"),
        row("projected_signals", projected, (projected >= wanted) | (left <= 0), wanted, f"by {target} at the rate so far"),
        *[row(f"share:{c}", F.col(f"`share:{c}`"), F.col(f"`share:{c}`") >= least_share, least_share, "share populated") for c in present],
        *[row(f"share:{c}", F.lit(None).cast("double"), F.lit(False), least_share, "no such field") for c in sorted(set(critical) - set(present))],
    ]
    empty = F.array(row("rows", F.lit(0.0), F.lit(False), low, "the summary is empty"))
    return one.select(F.explode(F.when(F.col("__last").isNull(), empty).otherwise(F.array(*rows))).alias("r")).select("r.*")


def coverage(summary: DataFrame, fields: list[str], days: int = 10, floor: float = 0.9, least_days: int = 2) -> DataFrame:
    """Per field: share populated on the latest date, mean of the daily shares before, and whether it regressed."""
    recent = summary.join(F.broadcast(latest_dates(summary, days)), "dt", "left_semi")
    daily = recent.groupBy("dt").agg(*[(F.count(f) / F.count("*")).alias(f) for f in fields]).unpivot("dt", fields, "field", "share")
    last = recent.agg(F.max("dt").alias("__last"))
    d = daily.join(F.broadcast(last))
    now, base = F.max(F.when(F.col("dt") == F.col("__last"), F.col("share"))), F.avg(F.when(F.col("dt") < F.col("__last"), F.col("share")))
    n = F.count(F.when(F.col("dt") < F.col("__last"), 1))
    g = d.groupBy("field").agg(now.alias("latest_share"), base.alias("baseline_share"), n.alias("baseline_days"))
    bad = (F.col("baseline_days") >= least_days) & (F.col("baseline_share") >= floor) & (F.col("latest_share") < floor)
    return g.withColumn("regressed", F.coalesce(bad, F.lit(False)))


def signals_measurable(summary: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of the latest flag date without a captured close."""
    last = signals.agg(F.max("flag_date").alias("__last"))
    s = signals.join(F.broadcast(last)).where(F.col("flag_date") == F.col("__last")).select("flag_date", "ticker")
    return s.join(summary.where("close is not null").select(F.col("dt").alias("flag_date"), "ticker"), ["flag_date", "ticker"], "left_anti")


def value_sanity(prices: DataFrame, days: int = 10) -> DataFrame:
    """Rows of the latest dates with impossible values."""
    recent = prices.join(F.broadcast(latest_dates(prices, days)), "dt", "left_semi")
    return recent.where("close is null or close <= 0 or volume < 0 or high < low").select("dt", "ticker", "high", "low", "close", "volume")


def capture_shape(summary: DataFrame, low: int = 80, high: int = 400) -> DataFrame:
    """Rows of the latest date, codes that are no equity, and whether the count is plausible."""
    last = summary.agg(F.max("dt").alias("__last"))
    d = summary.join(F.broadcast(last)).where(F.col("dt") == F.col("__last"))
    g = d.groupBy("dt").agg(F.count("*").alias("n_rows"), F.count(F.when(~is_equity_code("ticker"), 1)).alias("n_junk"))
    return g.withColumn("ok", F.col("n_rows").between(low, high))


def signal_projection(signals: DataFrame, summary: DataFrame, today: str, target: str) -> DataFrame:
    """Signals so far, by day, and projected to the target date at that rate."""
    days = summary.agg(F.min("dt").alias("__first"), F.countDistinct("dt").alias("days"))
    n = signals.join(F.broadcast(days)).where(F.col("flag_date") >= F.col("__first")).agg(F.count("*").alias("signals"))
    left = weekdays_between(F.lit(today).cast("date"), F.lit(target).cast("date"))
    d = days.join(F.broadcast(n))
    per_day = F.col("signals") / F.greatest(F.col("days"), F.lit(1))
    return d.select("signals", "days", left.cast("long").alias("weekdays_left"), F.floor(F.col("signals") + per_day * left).alias("projected"))


def panel_invariants(panel: DataFrame, features: list[str], least_rows: int = 5000, least_dates: int = 150, least_tickers: int = 30, most_missing: float = 0.15, budget: int = 82) -> DataFrame:
    """(metric, value, limit_value, ok) of the training panel."""
    a = panel.agg(
        F.count("*").cast("double").alias("rows"),
        F.countDistinct("dt").cast("double").alias("dates"),
        F.countDistinct("ticker").cast("double").alias("tickers"),
        F.greatest(*[F.avg(F.col(f).isNull().cast("double")) for f in features]).alias("worst_missing"),
        F.count(F.when((F.col("target") > 0.355) | (F.col("target") < -0.155), 1)).cast("double").alias("impossible_targets"),
    )
    limits = {"rows": (least_rows, 1), "dates": (least_dates, 1), "tickers": (least_tickers, 1), "worst_missing": (most_missing, -1), "impossible_targets": (budget, -1)}
    lim, sign = F.lit(None).cast("double"), F.lit(1)
    for k, (v, s) in limits.items():
        lim = F.when(F.col("metric") == k, float(v)).otherwise(lim)
        sign = F.when(F.col("metric") == k, s).otherwise(sign)
    u = a.unpivot([], list(limits), "metric", "value").withColumn("limit_value", lim)
    return u.withColumn("ok", F.coalesce((F.col("value") - F.col("limit_value")) * sign >= 0, F.lit(False)))




def latest_slice(panel: DataFrame, days: int = 60) -> DataFrame:
    """The rows of the last ``days`` dates."""
    return panel.join(F.broadcast(latest_dates(panel, days)), "dt", "left_semi")


def model_smoke(cycles: DataFrame, held_out: DataFrame, panel: DataFrame, most_sharpe: float = 4.0, least_edge: float = 0.005) -> DataFrame:
    """(check, ok, metric, value, limit_value, detail) of a walk-forward over the last dates.

    Folds that ran and errors that are numbers; a Sharpe ratio that no strategy sustains is a
    fault of the metric, a hit rate at the base rate of the whole panel is no information.
    Without a fold there is one row that is not ok, without trades the last two are NULL.
    """
    from .metrics import sharpe_trigger

    folds = cycles.agg(F.count("*").cast("double").alias("folds"), F.count(F.when(F.col("test_mae").isNotNull() & ~F.isnan("test_mae"), 1)).cast("double").alias("finite"))
    base = panel.agg(F.avg((F.col("target") > 0).cast("double")).alias("base"))
    one = folds.join(F.broadcast(sharpe_trigger(held_out))).join(F.broadcast(base))  # one row each
    row = lambda metric, value, ok, limit, detail: F.struct(F.lit("model").alias("check"), ok.alias("ok"), F.lit(metric).alias("metric"), value.alias("value"), F.lit(float(limit)).alias("limit_value"), F.lit(detail).alias("detail"))
    edge = F.col("hit_rate") - F.col("base")
    rows = [
        row("folds", F.col("folds"), F.col("folds") > 0, 1, "folds of the last dates"),
        row("finite_errors", F.col("finite"), F.col("finite") == F.col("folds"), 0, "folds whose error is a number"),
        row("pooled_sharpe", F.col("sharpe"), F.abs("sharpe") <= most_sharpe, most_sharpe, "beyond it the metric is wrong, not the edge right"),
        row("hit_vs_base", edge, F.abs(edge) >= least_edge, least_edge, "hit rate less the share of rising names"),
    ]
    return one.select(F.explode(F.when(F.col("folds") > 0, F.array(*rows)).otherwise(F.array(rows[0]))).alias("r")).select("r.*")
