"""Walk-forward of least-squares lines on sets of features, all sets and targets in one pass.

A row of the panel becomes one instance a (set, target) in which nothing is missing. An
instance adds to its date's Gram matrix in the task that reads it; a fold's normal
equations are the running sum of its training dates, so the panel is read once for all
folds, sets and targets, and what is shuffled is a small matrix a date. A group has the
matrices of one date, or one matrix a calendar date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import pearson
from .metrics import sharpe_trigger
from .order import all_of, quantiles, with_average_rank

PROBLEM = ["features", "h"]
#: What is left of a feature's own sum of squares where the features before it determine it.
TINY = 1e-10


def instances(panel: DataFrame, sets: dict[str, list[str]], targets: dict[str, str]) -> DataFrame:
    """(dt, ticker, features, h, x, y): one row a set and target whose values are all there; x is padded with zeros."""
    width = max(map(len, sets.values()))
    parts = []
    for name, feats in sets.items():
        x = F.array(*[F.col(f).cast("double") for f in feats], *[F.lit(0.0)] * (width - len(feats)))
        whole = all_of([F.col(f).isNotNull() for f in feats])
        for h, target in targets.items():
            parts.append(F.when(whole & F.col(target).isNotNull(), F.struct(F.lit(name).alias("features"), F.lit(h).alias("h"), x.alias("x"), F.col(target).cast("double").alias("y"))))
    return panel.select("dt", "ticker", F.explode(F.array_compact(F.array(*parts))).alias("i")).select("dt", "ticker", "i.*")


_DAILY = "features string, h string, dt date, n long, size double, gram array<double>"


def _summed(p: pd.DataFrame, grams: np.ndarray) -> pd.DataFrame:
    """One row a problem and date of ``p`` with the sums of n, size and the matrices."""
    place = p.groupby([*PROBLEM, "dt"], sort=False).ngroup().to_numpy()
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    rows = p.iloc[order[first]]
    add = lambda v: np.add.reduceat(v[order], first, axis=0)
    return pd.DataFrame({"features": rows["features"].to_numpy(), "h": rows["h"].to_numpy(), "dt": rows["dt"].to_numpy(), "n": add(p["n"].to_numpy()), "size": add(p["size"].to_numpy()), "gram": list(add(grams))})


def _grams(width: int):
    """Products of 1, x, y summed by problem and date, one row for each that a batch holds: what leaves a task is a matrix a date."""
    i, j = np.triu_indices(width + 2)

    def run(batches):
        for p in batches:
            if len(p):
                z = np.column_stack([np.ones(len(p)), np.stack(p["x"].to_numpy()), p["y"]])
                yield _summed(p.assign(n=1, size=p["y"].abs()), z[:, i] * z[:, j])

    return run


def _added(batches):
    """Adds the matrices of one problem and date, which follow one another."""
    held = None
    for p in batches:
        if not len(p):
            continue
        p = p if held is None else pd.concat([held, p], ignore_index=True)
        p = _summed(p, np.stack(p["gram"].to_numpy()))
        held = p.iloc[-1:]
        if len(p) > 1:
            yield p.iloc[:-1]
    if held is not None:
        yield held


def solve(gram: np.ndarray, width: int) -> np.ndarray:
    """Coefficients (intercept first) from the upper triangle of the products of 1, x, y; a feature that those before it determine has none."""
    g = np.zeros((width + 2, width + 2))
    g[np.triu_indices(width + 2)] = gram
    g += np.triu(g, 1).T
    scale = np.sqrt(np.diag(g)[:-1])
    scale[scale == 0] = 1.0
    m = g[:-1] / np.append(scale, 1.0) / scale[:, None]
    out = np.zeros(width + 1, bool)
    for k in range(width + 1):
        out[k] = m[k, k] < TINY
        if not out[k]:
            m[k] /= m[k, k]
            rest = np.arange(width + 1) != k
            m[rest] -= np.outer(m[rest, k], m[k])
    return np.where(out, 0.0, m[:, -1]) / scale


def _fitted(width: int, train_min: int, test_window: int, least_rows: int):
    """The dates of one problem (one row each) with the line that predicts them, fitted on the dates before their fold."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("dt", ignore_index=True)
        sums, n = np.cumsum(np.stack(p["gram"].to_numpy()), axis=0), p["n"].cumsum().to_numpy()
        beta: list[np.ndarray | None] = [None] * len(p)
        cycle = np.zeros(len(p), np.int32)
        for c, hi in enumerate(range(train_min, len(p) - test_window + 1, test_window), 1):
            if n[hi - 1] > least_rows:
                line = solve(sums[hi - 1], width)
                beta[hi : hi + test_window] = [line] * test_window
                cycle[hi : hi + test_window] = c
        return pd.DataFrame({"features": key[0], "h": key[1], "dt": p["dt"], "cycle": cycle, "beta": beta, "n": n[-1], "size": p["size"].sum()})

    return run


def ablate(panel: DataFrame, sets: dict[str, list[str]], targets: dict[str, str], train_min: int = 30, test_window: int = 6, least_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(predictions, problems): out-of-sample predictions of every set and target, and one row each of (n, naive_mae).

    Rows in which a feature of the set or the target is missing are dropped before the
    set's dates are numbered. Folds with ``least_rows`` training rows or fewer are left out.
    """
    width = max(map(len, sets.values()))
    inst = instances(panel, sets, targets)
    daily = inst.select(*PROBLEM, "dt", "x", "y").mapInPandas(_grams(width), _DAILY)
    daily = daily.repartition(*PROBLEM, "dt").sortWithinPartitions(*PROBLEM, "dt").mapInPandas(_added, _DAILY)
    dates = daily.groupBy(*PROBLEM).applyInPandas(_fitted(width, train_min, test_window, least_rows), "features string, h string, dt date, cycle int, beta array<double>, n long, size double")
    q = inst.join(dates.where("beta is not null").select(*PROBLEM, "dt", "cycle", "beta"), [*PROBLEM, "dt"])
    line = F.element_at("beta", 1) + F.aggregate(F.zip_with("x", F.slice("beta", 2, width), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    problems = dates.groupBy(*PROBLEM).agg(F.max("n").alias("n"), (F.max("size") / F.max("n")).alias("naive_mae"))
    return q.select(*PROBLEM, "cycle", "dt", "ticker", line.alias("pred"), F.col("y").alias("actual")), problems


def ablation_scores(preds: DataFrame, problems: DataFrame) -> DataFrame:
    """One row a (features, h): rows of its panel, mean of the folds' errors against that of 0 on the whole panel, pooled trades.

    A set without a fold keeps its row, with NULL errors and no trades.
    """
    errors = preds.groupBy(*PROBLEM, "cycle").agg(F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"), F.count("*").alias("n"))
    errors = errors.groupBy(*PROBLEM).agg(F.avg("mae").alias("mae"), F.count("*").alias("n_cycles"), F.sum("n").alias("n_preds"))
    d = problems.join(errors, PROBLEM, "left").join(sharpe_trigger(preds, by=PROBLEM), PROBLEM, "left")
    zero = F.lit(0).cast("long")
    return d.select(*PROBLEM, "n", "mae", "naive_mae", (F.col("mae") < F.col("naive_mae")).alias("beats_naive"), *[F.coalesce(c, zero).alias(c) for c in ("n_cycles", "n_preds", "n_trades")], "sharpe", "hit_rate")


def horizon_scores(preds: DataFrame, q: float = 0.9) -> DataFrame:
    """One row a (features, h) with predictions: rank correlation, and hits and returns at or above the interpolated quantile."""
    ranked = with_average_rank(with_average_rank(preds, "pred", "rp", PROBLEM), "actual", "ra", PROBLEM)
    ic = ranked.groupBy(*PROBLEM).agg(F.count("*").alias("n"), pearson("rp", "ra").alias("ic"))
    d = preds.join(quantiles(preds, "pred", {"cut": q}, PROBLEM), PROBLEM)
    top, a = F.col("pred") >= F.col("cut"), F.col("actual")
    g = d.groupBy(*PROBLEM).agg(F.count(F.when(top, 1)).alias("n_top"), F.avg(F.when(top, (a > 0).cast("double"))).alias("hit"), F.avg(F.when(top, a)).alias("top_ret"), F.avg(a).alias("base_ret"))
    return ic.join(g, PROBLEM).withColumn("edge", F.col("top_ret") - F.col("base_ret"))
