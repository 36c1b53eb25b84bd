"""Walk-forward folds, a closed-form predictor and boosted trees over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from . import boosting
from .metrics import feature_correlation, sharpe_trigger, top_contributions
from .spine import date_spine, with_position

#: Writes a table where all executors can read it and reads it back.
Keep = Callable[[DataFrame], DataFrame]


def folds(spine: DataFrame, train_min: int = 30, test_window: int = 6) -> DataFrame:
    """(cycle, train_hi, test_lo, test_hi): positions of expanding training and following test dates."""
    n = spine.agg(F.max("pos").alias("n"))
    last = F.floor((F.col("n") - train_min) / test_window).cast("int")
    c = n.select(F.explode(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))).alias("cycle"))
    hi = train_min + (F.col("cycle") - 1) * test_window
    return c.select("cycle", hi.alias("train_hi"), (hi + 1).alias("test_lo"), (hi + test_window).alias("test_hi"))


def linear_walk_forward(panel: DataFrame, feature: str, target: str = "target", train_min: int = 30, test_window: int = 6, least_rows: int = 0) -> DataFrame:
    """Out-of-sample predictions of a least-squares line on one feature, refitted for each fold.

    Folds with ``least_rows`` training rows or fewer are left out. The sums of a fold's training dates are running sums over dates, so no fold reads the
    panel again: one aggregation by date, one window over dates, one join.
    """
    known = panel.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    spine = date_spine(panel)
    p = with_position(known, spine)
    x, y = F.col(feature).cast("double"), F.col(target)
    sums = p.groupBy("pos").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    daily = spine.join(sums, "pos", "left")
    total = daily.select("pos", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = total.withColumn("slope", slope).withColumn("intercept", ratio(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n").cast("double")))
    cycle = F.floor((F.col("pos") - train_min - 1) / test_window).cast("int") + 1
    n = spine.agg(F.max("pos").alias("__n"))
    q = p.withColumn("cycle", cycle).join(F.broadcast(n)).where((F.col("cycle") >= 1) & (train_min + F.col("cycle") * test_window <= F.col("__n")))
    q = q.withColumn("train_hi", train_min + (F.col("cycle") - 1) * test_window)
    q = q.join(F.broadcast(fit.where(F.col("n") > least_rows).select(F.col("pos").alias("train_hi"), "slope", "intercept")), "train_hi")  # one row a date
    return q.select("cycle", "dt", "ticker", (F.col("intercept") + F.col("slope") * x).alias("pred"), y.alias("actual"))


def chronological_split(df: DataFrame, frac: float = 0.8) -> DataFrame:
    """``df`` with ``fit``: the first floor(n * frac) rows by (dt, ticker).

    Row positions come from counts of earlier dates, so only rows of one date are sorted together.
    """
    per = df.groupBy("dt").agg(F.count("*").alias("c"))
    before = per.select("dt", (F.sum("c").over(Window.orderBy("dt")) - F.col("c")).alias("__b"), F.sum("c").over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    d = df.join(F.broadcast(before), "dt")  # one row a date
    rn = F.col("__b") + F.row_number().over(Window.partitionBy("dt").orderBy("ticker"))
    return d.withColumn("fit", rn <= F.floor(F.col("__n") * frac)).drop("__b", "__n")


def tree_instances(panel: DataFrame, features: list[str], target: str = "target", train_min: int = 30, test_window: int = 6, frac: float = 0.8) -> tuple[DataFrame, dict[str, list[float]]]:
    """Rows of the panel in every fold that reads them, for :mod:`boosting`, and the borders of their bins.

    (model, dt, ticker, rid, part, y, bins): model is the fold, rid the row's place by (dt, ticker).
    The first ``frac`` of a fold's training rows fit, the rest stop it. Borders are quantiles of the
    first training window, which every fold reads.
    """
    known = panel.where(F.col(target).isNotNull())
    spine = date_spine(known)
    per = with_position(known.groupBy("dt").agg(F.count("*").alias("c")), spine)
    run, whole = Window.orderBy("pos"), Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a date
    dates = per.select("dt", "pos", (F.sum("c").over(run) - F.col("c")).alias("before"), F.sum("c").over(run).alias("upto"), F.max("pos").over(whole).alias("n"))
    sizes = dates.where((F.col("pos") >= train_min) & ((F.col("pos") - train_min) % test_window == 0)).select((F.floor((F.col("pos") - train_min) / test_window) + 1).cast("int").alias("model"), F.floor(F.col("upto") * frac).alias("fits"))
    d = known.select("dt", "ticker", *features, F.col(target).cast("double").alias("y")).join(F.broadcast(dates), "dt")
    d = d.withColumn("rid", F.col("before") + F.row_number().over(Window.partitionBy("dt").orderBy("ticker")))
    edges = boosting.borders(d.where(F.col("pos") <= train_min), features, boosting.Params.bins)
    d = boosting.binned(d.select("dt", "ticker", "pos", "n", "rid", "y", *features), edges)
    last = F.floor((F.col("n") - train_min) / test_window).cast("int")
    tested = F.greatest(F.ceil((F.col("pos") - train_min) / test_window), F.lit(0)).cast("int")
    d = d.withColumn("tested", tested).withColumn("model", F.explode(F.when(F.greatest("tested", F.lit(1)) <= last, F.sequence(F.greatest("tested", F.lit(1)), last)).otherwise(F.array().cast("array<int>"))))
    d = d.join(F.broadcast(sizes), "model")
    part = F.when(F.col("model") == F.col("tested"), boosting.TEST).when(F.col("rid") <= F.col("fits"), boosting.FIT).otherwise(boosting.EVAL)
    return d.select("model", "dt", "ticker", "rid", part.alias("part"), "y", "bins"), edges


def tree_walk_forward(panel: DataFrame, features: list[str], keep: Keep, target: str = "target", train_min: int = 30, test_window: int = 6, params: boosting.Params | None = None, contributions: bool = False) -> DataFrame:
    """(cycle, dt, ticker, part, pred, actual) of boosted trees of every fold; with ``contributions`` also phi.

    ``part`` tells rows that fitted a fold (0), stopped it (1) and were held out (2). ``keep`` writes
    a table to a shared folder and reads it back.
    """
    inst, _ = tree_instances(panel, features, target, train_min, test_window)
    inst = keep(inst)
    trees = boosting.fit(inst, len(features), params, keep=keep)
    out = boosting.predict(inst, trees, len(features), contributions)
    return out.select(F.col("model").alias("cycle"), "dt", "ticker", "part", "pred", F.col("y").alias("actual"), *(["phi"] if contributions else []))


def cycle_report(scored: DataFrame, threshold: float = 0.005) -> DataFrame:
    """One row a fold: its days, errors on the three parts, and trades of the held-out days."""
    part, error = F.col("part"), F.abs(F.col("pred") - F.col("actual"))
    held = part == boosting.TEST
    days = scored.groupBy("cycle").agg(
        F.countDistinct(F.when(~held, F.col("dt"))).alias("train_days"),
        F.countDistinct(F.when(held, F.col("dt"))).alias("test_days"),
        *[F.avg(F.when(part == k, error)).alias(f"{n}_mae") for n, k in (("train", boosting.FIT), ("eval", boosting.EVAL), ("test", boosting.TEST))],
    )
    return days.join(sharpe_trigger(scored.where(held), threshold=threshold, by=["cycle"]), "cycle")


def trade_log(scored: DataFrame, features: list[str], k: int = 3, threshold: float = 0.005) -> DataFrame:
    """Held-out rows predicted above the threshold with the k features that moved them most, as (name, value)."""
    d = scored.where((F.col("part") == boosting.TEST) & (F.col("pred") > threshold))
    return d.select("cycle", "dt", "ticker", "pred", "actual", top_contributions("phi", features, k).alias("drivers"))


def importance(panel: DataFrame, features: list[str], keep: Keep, target: str = "target", params: boosting.Params | None = None) -> DataFrame:
    """One row a feature, of trees fitted on all rows with missing values as 0.

    Mean size of its contributions and rank by it, its mean gain a split as a share of all, the
    rise of the absolute error when its values move to other rows of the date, and its plain
    correlation with the target.
    """
    d = panel.where(F.col(target).isNotNull())
    zeros = d.select("dt", "ticker", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(target).cast("double").alias("y"), F.lit(0).alias("model"), F.xxhash64("dt", "ticker").alias("rid"), F.lit(boosting.FIT).alias("part"))
    inst = keep(boosting.binned(zeros, boosting.borders(zeros, features, boosting.Params.bins)).drop(*features))
    width = len(features)
    trees = boosting.fit(inst, width, params, keep=keep)
    phi = boosting.predict(inst, trees, width, True).select(F.posexplode(F.slice("phi", 1, width)).alias("f", "v")).groupBy("f").agg(F.avg(F.abs("v")).alias("mean_abs_shap"))

    # A row once as it is, and once a feature with that feature's bin from the next row of its date.
    moved = [F.struct(F.lit(-1).alias("f"), F.col("bins").alias("b"))]
    for i in range(width):
        w = Window.partitionBy("dt").orderBy(F.xxhash64("ticker", F.lit(i)))
        other = F.coalesce(F.lead("bins").over(w), F.first("bins").over(w))
        moved.append(F.struct(F.lit(i).alias("f"), F.concat(F.substring("bins", 1, i), F.substring(other, i + 1, 1), F.substring("bins", i + 2, width)).alias("b")))
    tall = inst.select("model", "y", F.array(*moved).alias("all")).select("model", "y", F.explode("all").alias("s")).select("model", "y", "s.f", F.col("s.b").alias("bins"))
    error = boosting.predict(tall, trees, width).groupBy("f").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("error"))
    base = error.where("f = -1").select(F.col("error").alias("whole"))
    rise = error.where("f >= 0").join(F.broadcast(base)).select("f", (F.col("error") - F.col("whole")).alias("importance"))  # one row

    gains = [np.concatenate([g[f == i] for g, f in zip(trees.gain, trees.feature, strict=True)] or [np.zeros(0)]) for i in range(width)]
    mean = np.array([g.mean() if len(g) else 0.0 for g in gains])
    table = panel.sparkSession.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(zip(features, mean / (mean.sum() or 1.0), strict=True))], "f int, feature string, gain double")
    out = table.join(phi, "f").join(rise, "f").join(feature_correlation(d, features, target), "feature")
    return out.select("feature", "mean_abs_shap", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")).alias("rank"), "gain", "importance", "r")  # one row a feature
