"""Scores of predictions and trades. No input gives counts of 0 and NULL scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import kelly_fraction, ratio, t_two_sided
from .features import pearson
from .order import quantiles, with_average_rank

YEAR = math.sqrt(252.0)


def _sharpe(r, std):
    return F.try_divide(F.avg(r), F.when(std(r) > 0, std(r))) * YEAR


def sharpe_trigger(df: DataFrame, pred: str = "pred", actual: str = "actual", threshold: float = 0.005, by: list[str] | None = None) -> DataFrame:
    """Sharpe (sample deviation), trades and hits of the rows predicted above the threshold."""
    a = F.when(F.col(pred) > threshold, F.col(actual))
    agg = [_sharpe(a, F.stddev_samp).alias("sharpe"), F.count(a).alias("n_trades"), F.avg(F.when(a.isNotNull(), (a > 0).cast("double"))).alias("hit_rate")]
    return (df.groupBy(*by) if by else df).agg(*agg)


def sharpe_returns(df: DataFrame, ret: str = "ret", by: list[str] | None = None) -> DataFrame:
    """Sharpe (population deviation), trades and hits of returns."""
    r = F.col(ret)
    agg = [_sharpe(r, F.stddev_pop).alias("sharpe"), F.count(r).alias("n_trades"), F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("hit_rate")]
    return (df.groupBy(*by) if by else df).agg(*agg)


def mae_vs_naive(df: DataFrame, pred: str = "pred", actual: str = "actual", cycle: str | None = None) -> DataFrame:
    """Mean absolute error and that of predicting 0; with ``cycle`` the mean of the cycles' means."""
    m = [F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"), F.avg(F.abs(actual)).alias("naive_mae")]
    if cycle is None:
        return df.agg(*m)
    return df.groupBy(cycle).agg(*m).agg(F.avg("mae").alias("mae"), F.avg("naive_mae").alias("naive_mae"))


def spearman_ic(df: DataFrame, pred: str = "pred", actual: str = "actual") -> DataFrame:
    """Pooled rank correlation of predictions and outcomes."""
    d = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(pred, actual)
    d = with_average_rank(with_average_rank(d, pred, "rp"), actual, "ra")
    return d.agg(pearson("rp", "ra").alias("ic"), F.count("*").alias("n"))


def top_decile_edge(df: DataFrame, pred: str = "pred", actual: str = "actual", q: float = 0.9) -> DataFrame:
    """Hit rate and mean return of predictions at or above the interpolated quantile, and their edge."""
    cut = quantiles(df, pred, {"cut": q})
    top = F.col(pred) >= F.col("cut")
    d = df.join(F.broadcast(cut))  # one row
    out = d.agg(
        F.max("cut").alias("cut"),
        F.count(F.when(top, 1)).alias("n_top"),
        F.avg(F.when(top, (F.col(actual) > 0).cast("double"))).alias("hit"),
        F.avg(F.when(top, F.col(actual))).alias("top_ret"),
        F.avg(actual).alias("base_ret"),
    )
    return out.withColumn("edge", F.col("top_ret") - F.col("base_ret"))


def drawdown_quantiles(df: DataFrame, col: str) -> DataFrame:
    return quantiles(df, col, {"median_dd": 0.5, "p25_dd": 0.25})


def summarise(df: DataFrame, by: list[str], ret: str = "ret", mfe: str = "mfe", mae: str = "mae") -> DataFrame:
    """Returns of each group of known keys and what came before them: n, mean, exact median, hits, excursions."""
    r = F.col(ret)
    g = df.groupBy(*by).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        (100.0 * F.avg(F.when(r.isNotNull(), (r > 0).cast("double")))).alias("hit_pct"),
        F.avg(mfe).alias("mfe"),
        F.avg(mae).alias("mae"),
    )
    return g.join(quantiles(df, ret, {"median": 0.5}, by), by, "left")


def kelly_from_trades(df: DataFrame, ret: str = "ret", cap: float = 0.5) -> DataFrame:
    """Win rate over all trades, mean win and loss, and the stake; no wins or no losses stakes 0."""
    r = F.col(ret)
    s = df.agg(F.try_divide(F.count(F.when(r > 0, 1)), F.count(r)).alias("p"), F.avg(F.when(r > 0, r)).alias("win"), F.avg(F.when(r < 0, -r)).alias("loss"))
    return s.withColumn("kelly", F.when(F.col("win").isNull() | F.col("loss").isNull(), 0.0).otherwise(kelly_fraction("p", F.coalesce("win", F.lit(1.0)), F.coalesce("loss", F.lit(1.0)), cap)))


def welch_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """t, degrees of freedom and two-sided p-value of group 1 against group 0, unequal variances."""
    v = lambda k: F.when(F.col(group) == k, F.col(value))
    d = df.agg(*[f(v(k)).alias(f"{n}{k}") for k in (1, 0) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    s1, s0 = ratio("v1", F.col("n1").cast("double")), ratio("v0", F.col("n0").cast("double"))
    t = ratio(F.col("m1") - F.col("m0"), F.sqrt(s1 + s0))
    dof = ratio((s1 + s0) * (s1 + s0), ratio(s1 * s1, F.col("n1") - 1.0) + ratio(s0 * s0, F.col("n0") - 1.0))
    return d.select(F.col("m1").alias("mean_on"), F.col("m0").alias("mean_off"), F.col("n1").alias("n_on"), F.col("n0").alias("n_off"), t.alias("t"), dof.alias("dof")).withColumn("p", t_two_sided("t", "dof"))


def target_shape(df: DataFrame, col: str) -> DataFrame:
    """Rows, share missing, share positive, unbiased excess kurtosis."""
    n = F.count(col).cast("double")
    g2 = F.kurtosis(col)
    unbiased = ratio((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return df.agg(F.count("*").alias("n"), F.avg(F.col(col).isNull().cast("double")).alias("missing"), F.avg((F.col(col) > 0).cast("double")).alias("base_rate"), F.when(n > 3, unbiased).alias("kurtosis"))


def feature_correlation(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Pairwise-complete Pearson of each feature with the target, in one pass."""
    pair = lambda f: (F.when(F.col(target).isNotNull(), F.col(f).cast("double")), F.when(F.col(f).isNotNull(), F.col(target)))
    wide = df.agg(*[pearson(*pair(f)).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "r")


def normalise(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores by the training rows' mean and deviation, clipped at 5, missing as 0."""
    from ..functions.scalars import zscore

    s = train.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    d = df.join(F.broadcast(s))  # one row
    return d.select(*[zscore(c, f"__m_{c}", f"__s_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def top_drivers(df: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """``df`` with ``drivers``: its k columns of largest absolute value, names in order (ties by name, nulls last)."""
    size = lambda c: F.coalesce(F.abs(c), F.lit(-1.0))
    ordered = F.array_sort(F.array(*[F.struct((-size(c)).alias("size"), F.lit(c).alias("name")) for c in cols]))
    return df.withColumn("drivers", F.array_join(F.transform(F.slice(ordered, 1, k), lambda x: x["name"]), ","))


def top_contributions(values: str, names: list[str], k: int = 3) -> Column:
    """The k largest of an array of contributions by size, as an array of (name, value); ties by name."""
    v = F.col(values)
    each = F.array(*[F.struct((-F.abs(v[i])).alias("size"), F.lit(n).alias("name"), v[i].alias("value")) for i, n in enumerate(names)])
    return F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
