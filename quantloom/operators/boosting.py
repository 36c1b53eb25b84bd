"""Gradient-boosted regression trees for many models at once.

A model is a fold of a walk-forward, a set of features, a horizon, or all of these: an
instance is a row of one model, with its part (fit, evaluation, test) and the bin of
every feature. One aggregation a level grows that level of one tree of all models: each
task adds its instances to histograms of (model, node, feature, bin), the histograms of
a model meet in one group of fixed size, and the best split of each node comes back. The
driver holds trees, never rows.

Trees follow the usual regularised form for squared error: gain G_L^2/(n_L+l2) +
G_R^2/(n_R+l2) - G^2/(n+l2), leaves -G/(n+l2) times the rate, each split with a learnt
side for missing values, rows and features drawn for each tree by hash. A model stops
when its absolute error on the evaluation rows has not fallen for ``patience`` trees,
and keeps the trees up to its best.

Bins come from the rows that every model may see (the first training window), so no
border knows a later value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIT, EVAL, TEST = 0, 1, 2
#: Bin of a missing value.
MISSING = 255


@dataclass(frozen=True)
class Params:
    trees: int = 100
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    patience: int = 10
    bins: int = 64


@dataclass
class Trees:
    """Trees of many models as arrays [model, tree, node]; node k has the children 2k+1 and 2k+2.

    ``feature`` is -1 at a leaf; bins up to ``bin`` go left, a missing value goes left where
    ``left`` is set; ``value`` is what a leaf adds; ``cover`` counts the drawn rows of a node.
    """

    ids: np.ndarray
    base: np.ndarray
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    cover: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    used: np.ndarray | None = None

    @property
    def nodes(self) -> int:
        return (2 << self.depth) - 1

    def row(self, model: np.ndarray) -> np.ndarray:
        """Places of models; -1 for one without trees."""
        at = np.minimum(np.searchsorted(self.ids, model), len(self.ids) - 1)
        return np.where(self.ids[at] == model, at, -1)

    def leaf(self, t: int, m: np.ndarray, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row reaches in tree t after so many levels; -1 where the path ended above."""
        at = np.zeros(len(m), np.int64)
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[t][m, at]
            inner = f >= 0
            b = x[np.arange(len(m)), np.maximum(f, 0)]
            left = np.where(b == MISSING, self.left[t][m, at], b <= self.bin[t][m, at])
            at = np.where(inner, 2 * at + 2 - left, at)
        return at

    def since(self, first: int) -> Trees:
        """The trees from ``first`` on, which start from 0 if there are others before."""
        base = self.base if first == 0 else np.zeros_like(self.base)
        return Trees(self.ids, base, self.depth, self.feature[first:], self.bin[first:], self.left[first:], self.value[first:], self.cover[first:], self.gain[first:], self.used)

    def predict(self, m: np.ndarray, x: np.ndarray, best: bool = False, growing: bool = False) -> np.ndarray:
        """Base and sum of all trees; with ``best`` of those each model kept, while the last is ``growing`` of those before it."""
        out = self.base[m].copy()
        for t in range(len(self.feature) - growing):
            v = self.value[t][m, self.leaf(t, m, x)]
            out += np.where(t < self.used[m], v, 0.0) if best else v
        return out


def drawn(rid: np.ndarray, t: int, share: float) -> np.ndarray:
    """Which of these row numbers are drawn for tree t."""
    if share >= 1:
        return np.ones(len(rid), bool)
    own, place = np.unique(rid, return_inverse=True)
    return np.fromiter((zlib.crc32(b"%d:%d" % (n, t)) < share * (1 << 32) for n in own.tolist()), bool, len(own))[place]


def drawn_columns(features: list[int], t: int, share: float) -> list[int]:
    """The features of tree t: a share of those of its model, at least one."""
    order = sorted(features, key=lambda f: zlib.crc32(b"c%d:%d" % (f, t)))
    return sorted(order[: max(1, int(share * len(features)))])


def split_of(g: np.ndarray, n: np.ndarray, p: Params) -> tuple[float, int, int, bool]:
    """(gain, feature, bin, missing goes left) of the best split of a node's histograms [feature, bins + missing].

    Ties go to the first feature, bin and side; no gain gives feature -1.
    """
    total_g, total_n = g[0].sum(), n[0].sum()
    best = (1e-12, -1, 0, False)
    whole = total_g * total_g / (total_n + p.l2)
    for f in range(len(g)):
        gl, nl = np.cumsum(g[f, :-1])[:-1], np.cumsum(n[f, :-1])[:-1]
        for left in (False, True):
            a, b = (gl + g[f, -1], nl + n[f, -1]) if left else (gl, nl)
            ok = (b >= 1) & (total_n - b >= 1)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, a * a / (b + p.l2) + (total_g - a) ** 2 / (total_n - b + p.l2) - whole, -np.inf)
            k = int(np.argmax(np.round(gain, 12)))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, k, left)
    return best


def borders(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Ascending inner borders of every feature: values at or below the k-th go to bin k or lower."""
    from .order import quantiles

    tall = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])).alias("s")).select("s.*")
    q = quantiles(tall, "v", {f"q{k}": k / bins for k in range(1, bins)}, ["f"])
    found = {r["f"]: sorted({r[f"q{k}"] for k in range(1, bins)}) for r in q.collect()}  # bins x features numbers
    return {f: found.get(f, []) for f in features}


def binned(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``df`` with ``bins``: one byte a feature, the number of borders below its value."""
    names = list(edges)
    cuts = [np.array(edges[f]) for f in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            out = np.full((rows, len(names)), MISSING, np.uint8)
            for i, c in enumerate(cuts):
                v = b.column(len(keep) + i).to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(v), MISSING, np.searchsorted(c, v, "left"))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array([r.tobytes() for r in out], pa.binary())], names=[*keep, "bins"])

    keep = df.columns
    d = df.select(*keep, *[F.col(f).cast("double").alias(f"__{f}") for f in names])
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", bins binary"
    return d.mapInArrow(run, schema)


def _arrays(b: pa.RecordBatch, trees: Trees, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = trees.row(b.column(b.schema.get_field_index("model")).to_numpy())
    raw = b.column(b.schema.get_field_index("bins")).to_pylist()
    return m, np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)


def _level(inst: DataFrame, trees: Trees, level: int, t: int, width: int, columns: list[list[int]], p: Params, active: np.ndarray) -> pd.DataFrame:
    """Splits of every node of one level of the last tree (number t), and at level 0 the evaluation errors so far: one row a (model, node).

    A task's histograms have models x nodes x features x bins cells, whatever its rows.
    """
    cells, nodes = p.bins + 1, 1 << level
    shape = (len(trees.ids), nodes, width, cells)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros(shape).ravel(), np.zeros(shape).ravel()
        err = np.zeros((len(trees.ids), 2))
        for b in batches:
            m, x = _arrays(b, trees, width)
            y, part, rid, held = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("y", "part", "rid", "held"))
            on = (m >= 0) & active[m] & (part != TEST)
            m, x, y, part, rid, held = (v[on] for v in (m, x, y, part, rid, held))
            pred = held + trees.predict(m, x, growing=True)
            if level == 0:
                e = part == EVAL
                np.add.at(err, m[e], np.stack([np.abs(pred[e] - y[e]), np.ones(e.sum())], 1))
            use = (part == FIT) & drawn(rid, t, p.rows)
            m, x, grad = m[use], x[use], (pred - y)[use]
            at = trees.leaf(len(trees.feature) - 1, m, x, level) - (nodes - 1)
            m, x, grad, at = (v[at >= 0] for v in (m, x, grad, at))
            for f in range(width):
                cell = ((m * nodes + at) * width + f) * cells + np.where(x[:, f] == MISSING, p.bins, x[:, f])
                g += np.bincount(cell, grad, len(g))
                n += np.bincount(cell, None, len(n))
        g, n = g.reshape(shape), n.reshape(shape)
        seen = np.flatnonzero(n.any((1, 2, 3)) | (err[:, 1] > 0))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array([g[i].tobytes() for i in seen]), pa.array([n[i].tobytes() for i in seen]), pa.array(err[seen, 0]), pa.array(err[seen, 1])], names=["m", "g", "n", "err", "rows"])

    def best(key: tuple, table: pa.Table) -> pa.Table:
        g, n = (sum(np.frombuffer(v, float) for v in table[c].to_pylist()).reshape(shape[1:]) for c in ("g", "n"))
        own = columns[key[0].as_py()]
        err, rows = (float(sum(table[c].to_pylist())) for c in ("err", "rows"))
        out = []
        for node in range(nodes):
            total = float(n[node, 0].sum())
            gain, f, cut, left, lg, ln = 0.0, -1, 0, False, 0.0, 0.0
            if total:
                gain, f, cut, left = split_of(g[node][own], n[node][own], p)
            if f >= 0:
                f = own[f]
                lg, ln = (float(h[node, f, : cut + 1].sum() + left * h[node, f, -1]) for h in (g, n))
            if total or node == 0:
                out.append((key[0].as_py(), node, f, cut, left, gain, float(g[node, 0].sum()), total, lg, ln, err, rows))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _SPLITS.types, strict=True)], schema=_SPLITS)

    part = inst.select("model", "bins", "y", "part", "rid", "held").mapInArrow(histograms, "m int, g binary, n binary, err double, rows double")
    return part.groupBy("m").applyInArrow(best, "m int, node int, feature int, bin int, left boolean, gain double, g double, n double, lg double, ln double, err double, rows double").toPandas()


_SPLITS = pa.schema([("m", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.bool_()), ("gain", pa.float64()), ("g", pa.float64()), ("n", pa.float64()), ("lg", pa.float64()), ("ln", pa.float64()), ("err", pa.float64()), ("rows", pa.float64())])


@contextmanager
def _small_jobs(spark: SparkSession, groups: int) -> Iterator[None]:
    """A fit is hundreds of passes with one shuffle of a few rows a model; planning them anew while they run costs more than they do."""
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(groups, 1))
    want = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(n)}
    before = {k: spark.conf.get(k) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Trees after which the predictions so far are written, so that no pass walks through more of them.
WRITE_EACH = 10


def fit(inst: DataFrame, width: int, params: Params | None = None, masks: dict[int, list[int]] | None = None, keep=None) -> Trees:
    """The trees of every model among the instances (model int, rid long, part int, y double, bins binary).

    ``masks`` has the features that a model may use (all, where it names none). ``keep`` writes
    a table and reads it back; with it, predictions are written every ``WRITE_EACH`` trees.
    """
    p = params or Params()
    base = inst.where(F.col("part") == FIT).groupBy("model").agg(F.avg("y").alias("base")).orderBy("model").toPandas()  # one row a model
    ids, models = base["model"].to_numpy(np.int64), len(base)
    trees = Trees(ids, base["base"].to_numpy(float), p.depth)
    allowed = [(masks or {}).get(i, list(range(width))) for i in ids.tolist()]
    trees.used = np.zeros(models, np.int64)
    with _small_jobs(inst.sparkSession, models):
        _grow(inst.withColumn("held", F.lit(0.0)), trees, width, allowed, p, keep)
    last = int(trees.used.max(initial=0))
    for a in (trees.feature, trees.bin, trees.left, trees.value, trees.cover, trees.gain):
        del a[last:]
    return trees


def _grow(inst: DataFrame, trees: Trees, width: int, allowed: list[list[int]], p: Params, keep) -> None:
    """Adds trees until every model has stopped; one pass a level."""
    models = len(trees.ids)
    least, active, done = np.full(models, np.inf), np.ones(models, bool), 0
    none = lambda kind=float: np.zeros((models, trees.nodes), kind)
    for t in range(p.trees + 1 if models else 0):
        for a, new in ((trees.feature, none(np.int64) - 1), (trees.bin, none(np.int64)), (trees.left, none(bool)), (trees.value, none()), (trees.cover, none()), (trees.gain, none())):
            a.append(new)
        columns = [drawn_columns(f, t, p.columns) for f in allowed]
        for level in range(p.depth):
            r = _level(inst, trees.since(done), level, t, width, columns, p, active)
            if level == 0:
                one = r[r["node"] == 0]
                m = one["m"].to_numpy()
                error = one["err"].to_numpy() / np.where(one["rows"] > 0, one["rows"], np.nan)
                better = np.isnan(error) | (error < least[m])
                if t:
                    least[m[better]], trees.used[m[better]] = error[better], t
                active &= t - trees.used < p.patience
                if t == p.trees or not active.any():
                    break
                r = r[active[r["m"].to_numpy()]]
            m, at = r["m"].to_numpy(), (1 << level) - 1 + r["node"].to_numpy()
            f = r["feature"].to_numpy()
            inner = f >= 0
            trees.feature[t][m, at], trees.bin[t][m, at], trees.left[t][m, at], trees.gain[t][m, at] = f, r["bin"], r["left"], np.where(inner, r["gain"], 0.0)
            trees.cover[t][m, at] = r["n"]
            trees.value[t][m, at] = np.where(inner, 0.0, -p.rate * r["g"] / (r["n"] + p.l2))
            m, at, r = m[inner], at[inner], r[inner]
            for child, g, n in ((2 * at + 1, r["lg"], r["ln"]), (2 * at + 2, r["g"] - r["lg"], r["n"] - r["ln"])):
                trees.value[t][m, child] = -p.rate * g / (n + p.l2)
                trees.cover[t][m, child] = n
            if not inner.any():
                break
        if t == p.trees or not active.any():
            break
        if keep is not None and len(trees.feature) - done == WRITE_EACH:
            inst, done = keep(_held(inst, trees, width, done)), len(trees.feature)


def _held(inst: DataFrame, trees: Trees, width: int, done: int) -> DataFrame:
    cols, recent = ["model", "rid", "part", "y", "bins", "held"], trees.since(done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, x = _arrays(b, trees, width)
            now = np.where(m >= 0, recent.predict(m, x), 0.0) + b.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(now)], names=cols)

    return inst.select(*cols).mapInArrow(run, "model int, rid long, part int, y double, bins binary, held double")


def predict(inst: DataFrame, trees: Trees, width: int, contributions: bool = False) -> DataFrame:
    """Instances of models with trees, with ``pred`` and, where asked for, ``phi``: each feature's share of it, and the mean they start from last."""
    cols = inst.columns
    extra = "pred double" + (", phi array<double>" if contributions else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, x = _arrays(b, trees, width)
            b = b.filter(pa.array(m >= 0))
            m, x = m[m >= 0], x[m >= 0]
            out = [pa.array(trees.predict(m, x, best=True))]
            if contributions:
                out.append(pa.array(list(shapley(trees, m, x)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), *out], names=[*cols, "pred", "phi"][: len(cols) + 1 + contributions])

    if not len(trees.ids):
        inst = inst.limit(0)
    return inst.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in inst.dtypes) + ", " + extra)


def paths(trees: Trees, t: int, i: int) -> list[tuple[float, dict[int, list[tuple[int, bool, bool]]], dict[int, float]]]:
    """Leaves of tree t of the i-th model: (value, {feature: its tests as (bin, missing left, goes left)}, {feature: share of rows that its tests let through})."""
    out = []

    def walk(at: int, tests: dict, shares: dict) -> None:
        f = int(trees.feature[t][i, at])
        if f < 0:
            out.append((float(trees.value[t][i, at]), tests, shares))
            return
        for left in (True, False):
            child = 2 * at + (1 if left else 2)
            share = float(trees.cover[t][i, child] / trees.cover[t][i, at])
            walk(child, tests | {f: [*tests.get(f, []), (int(trees.bin[t][i, at]), bool(trees.left[t][i, at]), left)]}, shares | {f: shares.get(f, 1.0) * share})

    walk(0, {}, {})
    return out


_WEIGHTS: dict[int, list[float]] = {}


def _weights(k: int) -> list[float]:
    """Shapley weight of a coalition by its size, of k players."""
    from math import factorial

    return _WEIGHTS.setdefault(k, [factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])


def shapley(trees: Trees, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[row, feature + 1]: path-dependent Shapley values of every row's prediction, the expected prediction last.

    A leaf is a game of the features on its path: one that is in the coalition lets the row
    through or not, one outside lets through the share of training rows that went that way.
    Rows sum to their prediction.
    """
    width = x.shape[1]
    phi = np.zeros((len(m), width + 1))
    for i in np.unique(m):
        rows = np.flatnonzero(m == i)
        xs = x[rows]
        own = np.zeros((len(rows), width + 1))
        own[:, -1] = trees.base[i]
        for t in range(int(trees.used[i])):
            for value, tests, shares in paths(trees, t, i):
                fs = list(tests)
                own[:, -1] += value * np.prod([shares[f] for f in fs]) if fs else value
                if not fs or not value:
                    continue
                ones = [np.all([(np.where(xs[:, f] == MISSING, miss, xs[:, f] <= cut)) == left for cut, miss, left in tests[f]], axis=0).astype(float) for f in fs]
                for a, f in enumerate(fs):
                    rest = [b for b in range(len(fs)) if b != a]
                    # Sums over coalitions by size: a polynomial with one factor a feature.
                    poly = [np.ones(len(rows))]
                    for b in rest:
                        grown = [np.zeros(len(rows)) for _ in range(len(poly) + 1)]
                        for s, c in enumerate(poly):
                            grown[s] += c * shares[fs[b]]
                            grown[s + 1] += c * ones[b]
                        poly = grown
                    own[:, f] += value * (ones[a] - shares[f]) * sum(w * c for w, c in zip(_weights(len(fs)), poly, strict=True))
        phi[rows] = own
    return phi
