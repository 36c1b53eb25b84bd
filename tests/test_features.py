"""Feature semantics on small frames, and the leakage property."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import features

D = [dt.date(2024, 1, d) for d in range(1, 20)]
FLOW = "dt date, ticker string, broker_code string, netval double"
PRICE = "dt date, ticker string, open double, high double, low double, close double, volume double"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def prices(spark, closes, ticker="A"):
    return spark.createDataFrame([(D[i], ticker, c, c * 1.05, c * 0.95, c, 1000.0) for i, c in enumerate(map(float, closes))], PRICE)


def test_broker_day_aggregates(spark):
    r = one(features.broker_day_aggregates(spark.createDataFrame([(D[0], "A", b, v) for b, v in (("X", 10.0), ("Y", -5.0), ("Z", 2.0))], FLOW)))
    assert (r.n_brokers, r.net_flow_total, r.broker_concentration) == (3, 7.0, 1.0)
    assert r.net_buy_ratio == pytest.approx(2 / 3)


def test_null_netval_counts_as_a_row_and_not_as_buying(spark):
    r = one(features.broker_day_aggregates(spark.createDataFrame([(D[0], "A", "X", None), (D[0], "A", "XL", None)], FLOW)))
    assert (r.n_brokers, r.net_flow_total, r.net_buy_ratio) == (2, 0.0, 0.0)
    assert r.broker_concentration is None and r.retail_presence_pct is None


def test_correlation_has_no_first_day_and_guards_flat_vectors(spark):
    rows = [(D[0], "A", b, v) for b, v in (("X", 10.0), ("Y", -5.0), ("Z", 3.0))]
    rows += [(D[1], "A", b, v) for b, v in (("X", 8.0), ("Y", -4.0), ("Z", 1.0))]
    rows += [(D[2], "A", b, 1.0) for b in "XYZ"] + [(D[3], "A", "X", 1.0)]
    got = {r.dt: r.broker_correlation_1d for r in features.broker_correlation_1d(spark.createDataFrame(rows, FLOW)).collect()}
    assert set(got) == {D[1], D[2], D[3]}
    assert got[D[1]] > 0.9 and got[D[2]] is None and got[D[3]] is None


def test_price_features(spark):
    c = [100.0, 101, 99, 105, 98, 110, 90, 120, 80, 130]
    r = features.price_features(prices(spark, c)).orderBy("dt").collect()
    assert r[1].momentum_1d == pytest.approx(0.01) and r[1].target == pytest.approx((99 - 101) / 101)
    assert [x.volume_ratio for x in r[:5]] == [None] * 5 and r[5].volume_ratio == 1.0
    assert r[-1].target is None


def test_zero_previous_close_gives_null(spark):
    r = features.price_features(prices(spark, [0.0, 5.0])).orderBy("dt").collect()
    assert r[0].target is None and r[1].momentum_1d is None


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(1)
    s = pd.Series(rng.normal(size=15))
    d = spark.createDataFrame([(D[i], "A", float(v), float(v) / 2) for i, v in enumerate(s)], "dt date, ticker string, net_flow_total double, broker_concentration double")
    got = features.rolling_features(d).orderBy("dt").toPandas()
    for w in (5, 10):
        np.testing.assert_allclose(got[f"net_flow_total_roll{w}"], s.shift(1).rolling(w, min_periods=max(2, w // 2)).mean())
        np.testing.assert_allclose(got[f"buy_days_{w}"], (s.shift(1) > 0).astype(float).rolling(w, min_periods=max(2, w // 2)).sum())


def test_clusters_skip_missing(spark):
    r = one(features.cluster_features(spark.createDataFrame([(D[0], "A", "DX", 3.0), (D[0], "A", "AK", -1.0)], FLOW)))
    assert r.cl_prajogo == 0.75 and r.cl_foreign == -0.25 and r.cl_max == 0.75


def test_later_rows_change_no_earlier_feature(spark):
    random.seed(2)
    rows = [(D[i], t, b, random.uniform(-5, 5)) for i in range(8) for t in "AB" for b in ("XL", "IF", "AK", "YP")]
    px = prices(spark, [100.0 + i for i in range(8)]).unionByName(prices(spark, [50.0 - i for i in range(8)], "B"))
    changed = [(d, t, b, v * 9 if d > D[5] else v) for d, t, b, v in rows]
    px2 = px.withColumn("close", F.when(F.col("dt") > F.lit(D[5]), F.col("close") * 3).otherwise(F.col("close")))

    def at(flow, p):
        d = features.multi_day_panel(spark.createDataFrame(flow, FLOW), p).drop("target").where(F.col("dt") <= F.lit(D[5]))
        return sorted(map(tuple, d.collect()), key=lambda r: r[:2])

    for a, b in zip(at(rows, px), at(changed, px2), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_partitioning_changes_nothing(spark):
    rows = [(D[i], t, b, float(i * 3 - len(b) + ord(b[0]) % 7)) for i in range(6) for t in "AB" for b in ("XL", "IF", "AK")]
    d = spark.createDataFrame(rows, FLOW)
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert key(features.broker_day_aggregates(d)) == key(features.broker_day_aggregates(d.repartition(7).orderBy(F.rand(3))))


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_blocks_give_what_whole_histories_give(spark, rows):
    from quantloom.operators.spine import in_blocks, numbered

    random.seed(rows)
    bars = [(D[0] + dt.timedelta(days=d), t, random.random() + 1, random.random() * 100) for t, n in (("A", 60), ("B", 1), ("C", 23)) for d in sorted(random.sample(range(400), n))]
    p = spark.createDataFrame(bars, "dt date, ticker string, close double, volume double")
    assert sorted(r["__row"] for r in numbered(p, 30).where("ticker = 'A'").collect()) == list(range(60))
    want = {(r.dt, r.ticker): tuple(r) for r in features.price_features(p).collect()}
    got = in_blocks(p, features.price_features, 5, 1, rows, 30)
    assert {(r.dt, r.ticker): tuple(r) for r in got.collect()} == want and got.count() == len(want)
    daily = p.select("dt", "ticker", F.col("close").alias("net_flow_total"), F.col("volume").alias("broker_concentration"))
    want = sorted(tuple(r) for r in features.rolling_features(daily).collect())
    same = sorted(tuple(r) for r in in_blocks(daily, features.rolling_features, 10, 0, rows, 30).collect())
    assert [r[:2] for r in same] == [r[:2] for r in want]
    assert all(a == b or a == pytest.approx(b, rel=1e-12) for x, y in zip(same, want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))
