import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import metrics, policy, signals, simulate, walkforward
from quantloom.operators.spine import date_spine

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
PRICE = "dt date, ticker string, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, PRICE)


def test_sharpe_of_triggered(spark):
    d = spark.createDataFrame([(0.01, 0.02), (0.02, -0.01), (-0.01, 0.03), (0.006, 0.01), (0.001, -0.05)], "pred double, actual double")
    r = metrics.sharpe_trigger(d).first()
    x = np.array([0.02, -0.01, 0.01])
    assert r.n_trades == 3 and r.hit_rate == pytest.approx(2 / 3) and r.sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    none = metrics.sharpe_trigger(d.where("pred < 0.005")).first()
    assert (none.n_trades, none.sharpe, none.hit_rate) == (0, None, None)


def test_single_trade_has_no_sharpe(spark):
    d = spark.createDataFrame([(0.01,)], "ret double")
    assert metrics.sharpe_returns(d).first().sharpe is None


def test_kelly(spark):
    one = lambda *a: spark.range(1).select(S.kelly_fraction(*map(F.lit, a[:3]), a[3]).alias("k")).first().k
    assert one(0.6, 1.0, 1.0, 1.0) == pytest.approx(0.2) and one(0.4, 1.0, 1.0, 1.0) == 0.0
    with pytest.raises(Exception, match="positive"):
        one(0.5, 0.0, 1.0, 1.0)
    d = spark.createDataFrame([(x,) for x in (0.05, -0.02, 0.03, -0.01, 0.04, -0.02)], "ret double")
    p, w, loss = 0.5, 0.04, 0.05 / 3
    assert metrics.kelly_from_trades(d, cap=1.0).first().kelly == pytest.approx(p - (1 - p) / (w / loss))
    assert metrics.kelly_from_trades(d.where("ret > 0")).first().kelly == 0.0


def test_ranks_quantiles_and_kurtosis_against_pandas(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"pred": rng.integers(0, 9, 200) / 3, "actual": rng.normal(size=200)})
    d = spark.createDataFrame(p)
    assert metrics.spearman_ic(d).first().ic == pytest.approx(p.pred.rank().corr(p.actual.rank()))
    assert metrics.top_decile_edge(d).first().cut == pytest.approx(np.quantile(p.pred, 0.9))
    assert metrics.target_shape(d, "actual").first().kurtosis == pytest.approx(p.actual.kurt())


def test_welch_p_value(spark):
    """Known quantiles of Student's t, both tails of the fraction, and what has no value."""
    from quantloom.functions.scalars import lgamma, t_two_sided

    def by_integration(t, dof):
        tail = lambda lo: np.trapezoid(np.cos(u := np.linspace(lo, math.pi / 2, 400_001)) ** (dof - 1), u)
        return float(tail(math.atan(abs(t) / math.sqrt(dof))) / tail(0.0))

    known = [(0.0, 5.0, 1.0), (12.7062047362, 1.0, 0.05), (2.2281388520, 10.0, 0.05), (-3.1692726726, 10.0, 0.01), (1.9599639845, 1e7, 0.05), (None, 3.0, None), (1.0, None, None)]
    known += [(t, dof, by_integration(t, dof)) for t in (1e-6, 0.3, -1.0, 2.5, 9.0, 60.0) for dof in (1.0, 2.5, 3.0, 17.0, 755.9, 9000.0)]
    d = spark.createDataFrame(known, "t double, dof double, p double")
    for r in d.withColumn("got", t_two_sided("t", "dof")).collect():
        assert r.got == (None if r.p is None else pytest.approx(r.p, rel=1e-5, abs=1e-9)), r
    x = [0.01, 0.5, 1.0, 3.7, 42.0, 1e5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(lgamma("x").alias("g")).collect()
    assert [r.g for r in got] == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def plain_trade(rows, i, hold, tp, sl):
    e = rows[i][5]
    for k in range(1, hold + 1):
        if i + k >= len(rows):
            return None
        _, _, _, high, low, close, _ = rows[i + k]
        if sl is not None and low <= e * (1 - sl):
            return -sl
        if tp is not None and high >= e * (1 + tp):
            return tp
        if k == hold or i + k == len(rows) - 1:
            return (close - e) / e


def test_trades_against_a_loop(spark):
    rng = np.random.default_rng(5)
    c = 100 * np.cumprod(1 + rng.normal(0, 0.03, 60))
    rows = [(D[i], "A", float(x), float(x * 1.03), float(x * 0.97), float(x), 1.0) for i, x in enumerate(c)]
    for hold, tp, sl in ((1, None, None), (3, 0.05, 0.03), (5, 0.03, 0.05)):
        got = {r.dt: r.ret for r in simulate.tp_sl_trades(frame(spark, rows), hold, tp, sl).collect()}
        want = {rows[i][0]: plain_trade(rows, i, hold, tp, sl) for i in range(len(rows))}
        assert got == pytest.approx({k: v for k, v in want.items() if v is not None})


def test_both_levels_on_one_day_is_the_stop(spark):
    rows = [(D[0], "A", 100.0, 100.0, 100.0, 100.0, 1.0), (D[1], "A", 100.0, 120.0, 80.0, 100.0, 1.0)]
    assert simulate.tp_sl_trades(frame(spark, rows), 3, 0.05, 0.03).first().ret == -0.03


def test_locked_exits_roll_on(spark):
    c = [100.0, 100.0] + [100 * 0.85**k for k in range(1, 31)]
    rows = [(D[i], "A", x, x, x, x, 1.0) for i, x in enumerate(c)]
    r = {x.dt: x for x in simulate.limit_aware_trades(frame(spark, rows)).collect()}
    assert r[D[0]].hold_days == 1 and r[D[1]].hold_days == 20
    assert r[D[20]].hold_days == 11  # to the end of the series
    up = [(D[0], "B", 100.0, 100.0, 100.0, 100.0, 1.0), (D[1], "B", 135.0, 135.0, 135.0, 135.0, 1.0), (D[2], "B", 135.0, 135.0, 135.0, 135.0, 1.0)]
    b = {x.dt: x for x in simulate.limit_aware_trades(frame(spark, up)).collect()}
    assert b[D[1]].blocked and b[D[1]].ret is None and D[2] not in b


def test_outcome_needs_every_bar(spark):
    rows = [(D[i], "A", 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1.0) for i in range(6) if i != 3] + [(D[i], "B", 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(6)]
    s = spark.createDataFrame([(D[0], "A", "x,y"), (D[3], "A", "x"), (D[0], "Z", "x")], "flag_date date, ticker string, sources string")
    got = sorted((r.flag_date, r.h) for r in signals.signal_outcomes(frame(spark, rows), s, (1, 2)).collect())
    assert got == [(D[0], 1), (D[3], 1)]  # the bar of the flag day itself may be missing


def test_folds_and_line(spark):
    px = frame(spark, [(D[i], t, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(50) for t in "AB"])
    f = [tuple(r) for r in walkforward.folds(date_spine(px)).orderBy("cycle").collect()]
    assert f == [(1, 30, 31, 36), (2, 36, 37, 42), (3, 42, 43, 48)]
    rng = np.random.default_rng(6)
    rows = [(D[i], t, float(x), float(2 * x + 1)) for i in range(50) for t in "AB" for x in [rng.normal()]]
    out = walkforward.linear_walk_forward(spark.createDataFrame(rows, "dt date, ticker string, x double, target double"), "x").collect()
    assert len(out) == 36 and all(r.pred == pytest.approx(r.actual) for r in out)


def test_folds_of_a_short_axis(spark):
    px = frame(spark, [(D[i], "A", 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(10)])
    assert walkforward.folds(date_spine(px)).count() == 0


def plain_rollout(days):
    pos = held = trades = 0
    reward = 0.0
    for t in range(len(days) - 1):
        wish, up, down, _ = days[t]
        if pos and held >= 7:
            wish = 0
        new = 1 if wish and not pos and not up else 0 if not wish and pos and not down else pos
        cost = 0.0015 if new != pos else 0.0
        r = days[t + 1][3] if t + 1 < len(days) - 1 else 0.0
        pnl = new * r
        reward += (pnl * 1.5 if pnl < 0 else pnl) - cost
        trades += new != pos
        held, pos = (held + 1 if new else 0), new
    return reward, trades


def test_policy_against_a_loop(spark):
    rng = np.random.default_rng(7)
    days = [(int(rng.random() < 0.7), bool(rng.random() < 0.2), bool(rng.random() < 0.2), float(rng.normal(0, 0.02))) for _ in range(60)]
    d = spark.createDataFrame([(D[i], "A", *x) for i, x in enumerate(days)] + [(D[0], "S", 1, False, False, 0.1)], "dt date, ticker string, action int, at_ara boolean, at_arb boolean, daily_return double")
    r = policy.rollout(d).collect()
    assert len(r) == 1 and (r[0].reward, r[0].trades) == pytest.approx(plain_rollout(days))
