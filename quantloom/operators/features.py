"""Flow and price features, one row a (dt, ticker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, simple_return
from ..schema import ABSORBERS, CLUSTERS, FOREIGN, RETAIL, SMART_MONEY
from .spine import by_ticker

KEYS = ["dt", "ticker"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.where("dt is not null and ticker is not null")


def _sum(value: Column, codes: list[str] | None = None) -> Column:
    return F.coalesce(F.sum(value if codes is None else F.when(F.col("broker_code").isin(codes), value)), F.lit(0.0))


def broker_day_aggregates(flow: DataFrame) -> DataFrame:
    """Concentration in the three largest brokers, net flow, rows, share of buyers, retail presence.

    Rows with a null netval count as rows and as not buying.
    """
    size = F.abs("netval")
    top = Window.partitionBy(*KEYS).orderBy(size.desc_nulls_last(), "broker_code")
    g = _keyed(flow).withColumn("__rn", F.row_number().over(top)).groupBy(*KEYS)
    total = _sum(size)
    return g.agg(
        ratio(_sum(F.when(F.col("__rn") <= 3, size)), total).alias("broker_concentration"),
        _sum(F.col("netval")).alias("net_flow_total"),
        F.count("*").alias("n_brokers"),
        F.avg(F.when(F.col("netval") > 0, 1.0).otherwise(0.0)).alias("net_buy_ratio"),
        ratio(_sum(size, RETAIL), total).alias("retail_presence_pct"),
    )


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation; NULL for constant input (corr() raises there)."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def broker_correlation_1d(flow: DataFrame) -> DataFrame:
    """Correlation of brokers' flows with the ticker's previous date; NULL under 3 common brokers, no row on the first date."""
    f = _keyed(flow)
    steps = f.select(*KEYS).distinct().withColumn("prev_dt", F.lag("dt").over(by_ticker())).where("prev_dt is not null")
    v = f.where("netval is not null and broker_code is not null").groupBy(*KEYS, "broker_code").agg(F.avg("netval").alias("v"))
    now = v.join(steps, KEYS)
    before = v.select(F.col("dt").alias("prev_dt"), "ticker", "broker_code", F.col("v").alias("pv"))
    both = now.join(before, ["prev_dt", "ticker", "broker_code"]).groupBy(*KEYS)
    r = both.agg(F.when(F.count("*") >= 3, pearson("v", "pv")).alias("broker_correlation_1d"))
    return steps.select(*KEYS).join(r, KEYS, "left")


def smart_money_features(flow: DataFrame) -> DataFrame:
    n = F.col("netval")
    g = _keyed(flow).groupBy(*KEYS).agg(_sum(n, SMART_MONEY).alias("smart_money_net"), _sum(n, RETAIL).alias("retail_net"), _sum(n, ABSORBERS).alias("absorber_net"))
    smart, retail = F.col("smart_money_net"), F.col("retail_net")
    return g.select(
        "*",
        (smart - retail).alias("tod_divergence"),
        F.when((smart > 0) & (retail < 0), 1.0).otherwise(0.0).alias("tod_signal"),
        (F.col("absorber_net") - retail).alias("absorber_vs_retail"),
    )


def cluster_features(flow: DataFrame) -> DataFrame:
    """Net flow of each broker cluster by all absolute flow, and the largest of them, in one pass."""
    n = F.col("netval")
    total = F.sum(F.abs("netval"))
    cols = {f"cl_{k}": v for k, v in CLUSTERS.items()} | {"cl_foreign": FOREIGN}
    g = _keyed(flow).groupBy(*KEYS).agg(*[ratio(_sum(n, v), total).alias(k) for k, v in cols.items()])
    return g.withColumn("cl_max", F.greatest(*cols))


def _framed_mean(x: Column, lo: int, hi: int, need: int) -> Column:
    w = by_ticker().rowsBetween(lo, hi)
    return F.when(F.count(x).over(w) >= need, F.avg(x).over(w))


def price_features(prices: DataFrame) -> DataFrame:
    """momentum_1d, volume_ratio (by the five rows before), and the next row's return as target."""
    p = prices.select(
        *KEYS,
        simple_return("close", F.lag("close").over(by_ticker())).alias("momentum_1d"),
        ratio("volume", _framed_mean(F.col("volume"), -5, -1, 5)).alias("volume_ratio"),
        simple_return(F.lead("close").over(by_ticker()), "close").alias("target"),
    )
    return p


#: Days ahead of the forward returns.
HORIZONS = (1, 3, 5, 10, 20)


def multi_horizon_targets(prices: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Unguarded forward returns by row."""
    return prices.select(*KEYS, *[simple_return(F.lead("close", h).over(by_ticker()), "close").alias(f"target_{h}") for h in horizons])


def rolling_features(daily: DataFrame, cols=("net_flow_total", "broker_concentration"), windows=(5, 10), streak="net_flow_total") -> DataFrame:
    """Means of the w rows before, and how many of the last w rows followed a day of net buying.

    The first row has no day before; it counts as a row that followed none.
    """
    out = []
    for c in cols:
        out += [_framed_mean(F.col(c), -w, -1, max(2, w // 2)).alias(f"{c}_roll{w}") for w in windows]
    d = daily.withColumn("__b", F.when(F.lag(streak).over(by_ticker()) > 0, 1.0).otherwise(0.0))
    for w in windows:
        frame = by_ticker().rowsBetween(-(w - 1), 0)
        out.append(F.when(F.count("__b").over(frame) >= max(2, w // 2), F.sum("__b").over(frame)).alias(f"buy_days_{w}"))
    return d.select(*KEYS, *out)


def atr_pct(prices: DataFrame, rows: int = 10) -> DataFrame:
    span = ratio(F.col("high") - F.col("low"), "close")
    return prices.select(*KEYS, _framed_mean(span, -(rows - 1), 0, rows).alias("atr_pct"))


def training_panel(flow: DataFrame, prices: DataFrame) -> DataFrame:
    """Flow features, correlation and price features of the days that have a target."""
    a = broker_day_aggregates(flow).join(broker_correlation_1d(flow), KEYS, "left")
    return a.join(price_features(prices), KEYS).where("target is not null")


def smart_money_panel(flow: DataFrame, prices: DataFrame) -> DataFrame:
    return training_panel(flow, prices).join(smart_money_features(flow), KEYS, "left")


def multi_day_panel(flow: DataFrame, prices: DataFrame) -> DataFrame:
    a = broker_day_aggregates(flow)
    return training_panel(flow, prices).join(rolling_features(a), KEYS, "left")


def ablation_panel(flow: DataFrame, prices: DataFrame, horizons=HORIZONS) -> DataFrame:
    """All flow features (of the day, of the days before, of smart money), price features, and ``target_h`` of every horizon."""
    a = broker_day_aggregates(flow)
    x = a.join(broker_correlation_1d(flow), KEYS, "left").join(rolling_features(a), KEYS, "left").join(smart_money_features(flow), KEYS, "left")
    return x.join(price_features(prices).drop("target"), KEYS).join(multi_horizon_targets(prices, horizons), KEYS)


def scan_panel(flow: DataFrame, clean: DataFrame) -> DataFrame:
    """Flow and cluster features, price features of clean bars, and their guarded returns.

    ``clean`` has the bars with lag_1, lag_5 and the returns to scan; everything else of a bar goes.
    """
    a = broker_day_aggregates(flow).join(broker_correlation_1d(flow), KEYS, "left").join(cluster_features(flow), KEYS, "left")
    p = clean.select(
        *KEYS,
        F.col("lag_1").alias("momentum_1d"),
        F.col("lag_5").alias("momentum_5d"),
        ratio("volume", _framed_mean(F.col("volume"), -5, -1, 5)).alias("volume_ratio"),
        _framed_mean(ratio(F.col("high") - F.col("low"), "close"), -9, 0, 10).alias("atr_pct"),
        *[c for c in clean.columns if c.startswith(("fwd_", "max_", "mdd_"))],
    )
    return a.join(p, KEYS)
