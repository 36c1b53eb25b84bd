"""Ranks, quantiles, lines on sets of features, boosted trees and their contributions against plain versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import ablation, boosting, metrics, order, walkforward
from quantloom.sources.scratch import keeper


def values(n, seed):
    random.seed(seed)
    return [(random.choice("ab"), random.choice([0.0, 0.0, 1.5, -2.0, None]) if random.random() < 0.4 else random.gauss(0, 1)) for _ in range(n)]


@pytest.mark.parametrize("each", [1, 2, 7, 4096])
def test_ranks_and_quantiles_do_not_depend_on_bins(spark, monkeypatch, each):
    monkeypatch.setattr(order, "EACH", each)
    rows = values(700, 2) + [("c", 3.0), ("d", None)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(3)
    p = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    got = {(r.k, r.v): r.r for r in order.with_average_rank(d, "v", "r", ["k"]).collect()}
    p["r"] = p.groupby("k").v.rank()
    assert got == {(k, v): r for k, v, r in p[["k", "v", "r"]].itertuples(index=False)}
    q = {r.k: r for r in order.quantiles(d, "v", {"a": 0.1, "m": 0.5, "z": 1.0}, ["k"]).collect()}
    assert set(q) == {"a", "b", "c"}
    for k, g in p.groupby("k"):
        assert [q[k].a, q[k].m, q[k].z] == pytest.approx([g.v.quantile(x) for x in (0.1, 0.5, 1.0)])
    whole = order.quantiles(d, "v", {"m": 0.25}).first()
    assert whole.m == pytest.approx(p.v.quantile(0.25))
    assert order.quantiles(d.limit(0), "v", {"m": 0.5}).first().m is None


def test_nothing_runs_while_a_rank_is_planned(spark):
    d = spark.range(50).selectExpr("cast(id as double) as pred", "cast(raise_error('ran') as double) as actual")
    metrics.spearman_ic(d)
    metrics.top_decile_edge(d)


def frame(n_dates=20, tickers="ABCDE", k=8, seed=1, missing=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_dates):
        for t in tickers:
            x = [None if rng.random() < missing else float(v) for v in rng.normal(size=k)]
            y = None if rng.random() < missing else float(0.3 * (x[0] or 0) - 0.2 * (x[1] or 0) + rng.normal() * 0.1)
            rows.append((pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), t, *x, y, None if y is None else y * 2 + 1))
    return rows, [f"f{i}" for i in range(k)]


def test_lines_on_sets_against_numpy(spark):
    rows, names = frame()
    d = spark.createDataFrame([(r[0].date(), *r[1:]) for r in rows], "dt date, ticker string, " + ", ".join(f"{f} double" for f in names) + ", y1 double, y2 double").repartition(3)
    sets = {"two": names[:2], "all": names, "same": [names[0], names[0]]}
    preds, problems = ablation.ablate(d, sets, {"1": "y1", "2": "y2"}, 6, 4, least_rows=10)
    got = {(r.features, r.h, r.cycle, str(r.dt), r.ticker): r.pred for r in preds.collect()}
    p = pd.DataFrame(rows, columns=["dt", "ticker", *names, "y1", "y2"])
    scores = {(r.features, r.h): r for r in ablation.ablation_scores(preds, problems).collect()}
    want = {}
    for (name, fs), (h, y) in itertools.product(sets.items(), {"1": "y1", "2": "y2"}.items()):
        own = p.dropna(subset=[*set(fs), y])
        dates = sorted(own.dt.unique())
        maes = []
        for c, lo in enumerate(range(6, len(dates) - 3, 4), 1):
            tr, ts = own[own.dt.isin(dates[:lo])], own[own.dt.isin(dates[lo : lo + 4])]
            if len(tr) <= 10:
                continue
            beta = np.linalg.lstsq(np.column_stack([np.ones(len(tr)), tr[fs]]), tr[y], rcond=None)[0]
            pred = np.column_stack([np.ones(len(ts)), ts[fs]]) @ beta
            maes.append(np.abs(pred - ts[y]).mean())
            want |= {(name, h, c, str(a.date()), b): v for a, b, v in zip(ts.dt, ts.ticker, pred, strict=True)}
        s = scores[name, h]
        assert (s.n, s.n_cycles) == (len(own), len(maes)) and s.naive_mae == pytest.approx(own[y].abs().mean())
        assert s.mae == pytest.approx(np.mean(maes), rel=1e-7) if maes else s.mae is None
    assert set(got) == set(want) and len(want) > 100
    assert [got[k] for k in want] == pytest.approx(list(want.values()), rel=1e-6, abs=1e-8)


def plain_boost(rows, width, p):
    """One model's trees by loops: rows are (rid, part, y, bins)."""
    fit, held = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
    base = sum(r[2] for r in fit) / len(fit)
    pred = {r[0]: base for r in rows}
    trees, errors = [], []

    def reach(tree, bins, at=0):
        while at in tree and tree[at][0] >= 0:
            f, cut, left = tree[at][:3]
            goes = left if bins[f] == boosting.MISSING else bins[f] <= cut
            at = 2 * at + (1 if goes else 2)
        return at

    for t in range(p.trees):
        cols = boosting.drawn_columns(list(range(width)), t, p.columns)
        use = [r for r in fit if boosting.drawn(np.array([r[0]]), t, p.rows)[0]]
        tree = {}

        def grow(at, own, level, tree=tree, cols=cols):
            g, n = sum(pred[r[0]] - r[2] for r in own), len(own)
            best = (1e-12, None)
            if level < p.depth:
                for f in cols:
                    for left in (False, True):
                        for cut in range(p.bins - 1):
                            a = [r for r in own if (left if r[3][f] == boosting.MISSING else r[3][f] <= cut)]
                            if a and len(a) < n:
                                ga = sum(pred[r[0]] - r[2] for r in a)
                                gain = ga**2 / (len(a) + p.l2) + (g - ga) ** 2 / (n - len(a) + p.l2) - g**2 / (n + p.l2)
                                if gain > best[0] + 1e-12:
                                    best = (gain, (f, cut, left))
            if best[1] is None:
                tree[at] = (-1, 0, False, -p.rate * g / (n + p.l2), n)
                return
            f, cut, left = best[1]
            tree[at] = (f, cut, left, 0.0, n)
            goes = lambda r: left if r[3][f] == boosting.MISSING else r[3][f] <= cut
            grow(2 * at + 1, [r for r in own if goes(r)], level + 1)
            grow(2 * at + 2, [r for r in own if not goes(r)], level + 1)

        grow(0, use, 0)
        trees.append(tree)
        for r in rows:
            pred[r[0]] += tree[reach(tree, r[3])][3]
        errors.append(sum(abs(pred[r[0]] - r[2]) for r in held) / len(held) if held else -t)
        if t - int(np.argmin(errors)) >= p.patience:
            break
    best = int(np.argmin(errors)) + 1
    return base, trees[:best], lambda bins: base + sum(x[reach(x, bins)][3] for x in trees[:best])


def instances(spark, n, width, seed, models=(1, 4)):
    rng = np.random.default_rng(seed)
    rows = []
    for m in models:
        for i in range(n):
            x = rng.integers(0, 6, width).astype(np.uint8)
            x[rng.random(width) < 0.1] = boosting.MISSING
            y = float(x[0] < 3) - 0.5 * float(x[1] == boosting.MISSING) + 0.3 * m * float(x[2] > 4) + rng.normal() * 0.2
            rows.append((m, i, 0 if i < 0.6 * n else 1 if i < 0.8 * n else 2, float(y), bytearray(x.tobytes())))
    d = spark.createDataFrame([*rows, (9, 1, 2, 0.0, bytearray(width))], "model int, rid long, part int, y double, bins binary")
    return rows, d.repartition(3)


@pytest.mark.parametrize("p", [boosting.Params(trees=12, depth=3, rate=0.3, bins=8, patience=3), boosting.Params(trees=4, depth=2, rows=1.0, columns=1.0, l2=0.0, rate=0.5, bins=8)])
def test_trees_equal_a_plain_booster(spark, p):
    rows, d = instances(spark, 150, 4, 3)
    trees = boosting.fit(d, 4, p, keep=keeper(spark, "test"))
    got = {(r.model, r.rid): r.pred for r in boosting.predict(d, trees, 4).collect()}
    assert len(got) == len(rows)  # a model that nothing fits has no predictions
    for i, m in enumerate((1, 4)):
        own = [(r[1], r[2], r[3], r[4]) for r in rows if r[0] == m]
        base, plain, predict = plain_boost(own, 4, p)
        assert trees.used[i] == len(plain) and trees.base[i] == pytest.approx(base)
        assert [got[m, r[0]] for r in own] == pytest.approx([predict(r[3]) for r in own], abs=1e-9)


def test_predictions_written_on_the_way_change_nothing(spark, monkeypatch):
    _, d = instances(spark, 60, 3, 5)
    p = boosting.Params(trees=7, depth=2, bins=8)
    whole = boosting.fit(d, 3, p)
    monkeypatch.setattr(boosting, "WRITE_EACH", 2)
    parts = boosting.fit(d, 3, p, keep=keeper(spark, "test"))
    assert all((a == b).all() for a, b in zip(whole.feature, parts.feature, strict=True))
    assert all(np.allclose(a, b) for a, b in zip(whole.value, parts.value, strict=True))


def test_a_model_takes_only_its_features(spark):
    _, d = instances(spark, 80, 4, 6)
    trees = boosting.fit(d, 4, boosting.Params(trees=5, depth=3, bins=8), masks={4: [1, 3]})
    assert {int(f) for t in trees.feature for f in t[1]} <= {-1, 1, 3} and any((t[0] == 0).any() for t in trees.feature)


def test_contributions_equal_all_coalitions(spark):
    _, d = instances(spark, 120, 4, 7, models=(1,))
    trees = boosting.fit(d, 4, boosting.Params(trees=6, depth=4, rate=0.4, bins=8, patience=50))
    rng = np.random.default_rng(1)
    x = np.array([[boosting.MISSING if rng.random() < 0.1 else rng.integers(0, 6) for _ in range(4)] for _ in range(25)], np.uint8)
    m = np.zeros(len(x), int)
    phi = boosting.shapley(trees, m, x)
    assert phi.sum(1) == pytest.approx(trees.predict(m, x, best=True))

    def expected(t, row, known, at=0):
        f = int(trees.feature[t][0, at])
        if f < 0:
            return trees.value[t][0, at]
        kids = (2 * at + 1, 2 * at + 2)
        if f in known:
            left = trees.left[t][0, at] if row[f] == boosting.MISSING else row[f] <= trees.bin[t][0, at]
            return expected(t, row, known, kids[0] if left else kids[1])
        share = [trees.cover[t][0, k] / trees.cover[t][0, at] for k in kids]
        return sum(s * expected(t, row, known, k) for s, k in zip(share, kids, strict=True))

    for r, row in enumerate(x):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            total = 0.0
            for n in range(4):
                for s in itertools.combinations(others, n):
                    w = math.factorial(n) * math.factorial(3 - n) / math.factorial(4)
                    total += w * sum(expected(t, row, {*s, f}) - expected(t, row, set(s)) for t in range(int(trees.used[0])))
            assert phi[r, f] == pytest.approx(total, abs=1e-9)


def test_walk_forward_reads_nothing_ahead(spark):
    rows, names = frame(24, "ABCDEF", 3, 9)
    schema = "dt date, ticker string, f0 double, f1 double, f2 double, target double, y2 double"
    d = spark.createDataFrame([(r[0].date(), *r[1:]) for r in rows], schema)
    p = boosting.Params(trees=6, depth=2, rate=0.3)
    keep = keeper(spark, "test")
    scored = walkforward.tree_walk_forward(d, names, keep, train_min=12, test_window=4, params=p, contributions=True)
    a = {(r.cycle, r.part, r.dt, r.ticker): (r.pred, r.actual) for r in scored.collect()}
    assert {k[0] for k in a} == {1, 2, 3}
    dates = sorted({k[2] for k in a})
    for c in (1, 2, 3):
        hi = 12 + (c - 1) * 4
        train = sorted((k[2], k[3]) for k in a if k[0] == c and k[1] != 2)
        assert {x[0] for x in train} == set(dates[:hi]) and {k[2] for k in a if k[0] == c and k[1] == 2} == set(dates[hi : hi + 4])
        assert sorted((k[2], k[3]) for k in a if k[0] == c and k[1] == 0) == train[: int(len(train) * 0.8)]
    # Later values change no earlier prediction.
    late = dates[16]
    changed = spark.createDataFrame([(r[0].date(), r[1], *[v if v is None or r[0].date() < late else v * 7 + 1 for v in r[2:]]) for r in rows], schema)
    b = {(r.cycle, r.part, r.dt, r.ticker): r.pred for r in walkforward.tree_walk_forward(changed, names, keep, train_min=12, test_window=4, params=p).collect()}
    assert all(b[k] == pytest.approx(v[0]) for k, v in a.items() if k[0] == 1)
    report = {r.cycle: r for r in walkforward.cycle_report(scored).collect()}
    for c in (1, 2, 3):
        for part, name in ((0, "train_mae"), (1, "eval_mae"), (2, "test_mae")):
            e = [abs(v[0] - v[1]) for k, v in a.items() if k[0] == c and k[1] == part]
            assert report[c][name] == pytest.approx(sum(e) / len(e))
        held = [v for k, v in a.items() if k[0] == c and k[1] == 2 and v[0] > 0.005]
        assert report[c].n_trades == len(held) and report[c].train_days == 12 + (c - 1) * 4
    log = walkforward.trade_log(scored, names, 2).collect()
    assert len(log) == sum(1 for k, v in a.items() if k[1] == 2 and v[0] > 0.005)
    assert all(len(r.drivers) == 2 and abs(r.drivers[0].value) >= abs(r.drivers[1].value) for r in log)


def test_importance(spark):
    rows, names = frame(20, "ABCDEF", 3, 11)
    d = spark.createDataFrame([(r[0].date(), *r[1:6]) for r in rows], "dt date, ticker string, f0 double, f1 double, f2 double, target double")
    got = {r.feature: r for r in walkforward.importance(d, names, keeper(spark, "test"), params=boosting.Params(trees=15, depth=3, rate=0.3)).collect()}
    assert [got[f]["rank"] for f in names] == [1, 2, 3] and sum(r.gain for r in got.values()) == pytest.approx(1)
    assert got["f0"].importance > got["f2"].importance and got["f0"].r > 0 > got["f1"].r
