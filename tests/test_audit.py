import datetime as dt

import pytest

from quantloom.operators import audit
from quantloom.operators.spine import date_spine

D = [dt.date(2024, 1, d) for d in range(1, 30)]
PRICE = "dt date, ticker string, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    return spark.createDataFrame(rows, PRICE)


def bars(closes, ticker="A", days=None):
    return [(D[i], ticker, c, c * 1.05, c * 0.95, c, 10.0 + i + (ticker > "A")) for i, c in zip(days or range(len(closes)), map(float, closes))]


def removed_row(spark):
    hi, lo = {0: 105.0, 1: 115.0, 3: 520.0, 4: 515.0}, {0: 95.0, 1: 105.0, 3: 480.0, 4: 495.0}
    px = frame(spark, [(D[i], "A", c, hi[i], lo[i], c, 1.0) for i, c in ((0, 100.0), (1, 110.0), (3, 500.0), (4, 505.0))])
    return px, date_spine(frame(spark, bars([1.0] * 5, "B")))


def test_forward_returns_never_bridge_a_removed_row(spark):
    px, spine = removed_row(spark)
    r = [x.fwd_1 for x in audit.forward_returns(px, spine).orderBy("dt").collect()]
    assert r[0] == pytest.approx(0.10) and r[1] is None and r[2] == pytest.approx(0.01) and r[3] is None


def test_lagged_returns_are_guarded_too(spark):
    px, spine = removed_row(spark)
    r = [x.lag_1 for x in audit.lagged_returns(px, spine).orderBy("dt").collect()]
    assert r[0] is None and r[1] == pytest.approx(0.10) and r[2] is None and r[3] == pytest.approx(0.01)


def test_extremes_share_the_guard(spark):
    px, spine = removed_row(spark)
    r = audit.forward_returns(px, spine, extremes=True).orderBy("dt").collect()
    assert r[0].max_1 == pytest.approx(0.15) and r[0].mdd_1 == pytest.approx(0.05) and r[1].max_1 is None


def test_extremes_use_exactly_the_next_rows_from_the_first_row_on(spark):
    px = frame(spark, [(D[i], "A", c, c, c, c, 1.0) for i, c in enumerate((10.0, 9.0, 8.0, 7.0, 6.0))])
    r = audit.forward_returns(px, date_spine(px), (3,), extremes=True).orderBy("dt").collect()
    assert r[0].max_3 == pytest.approx(-0.1) and r[0].mdd_3 == pytest.approx(-0.3)


def test_detectors(spark):
    px = frame(spark, bars([100.0, 100, 100, 100, 100, 100, 1000, 100, 100, 100]) + [(D[0], "B", 100.0, 105.0, 95.0, 100.0, 10.0)])
    r = {(x.dt, x.ticker): x for x in audit.detect(px).collect()}
    assert r[D[6], "A"].series_break and r[D[6], "A"].limit_violation and r[D[7], "A"].limit_violation
    assert r[D[0], "A"].cross_ticker_dup and r[D[0], "B"].cross_ticker_dup
    assert r[D[6], "A"].reasons == "limit_violation+series_break" and r[D[3], "A"].reasons == ""


def test_tier_borders(spark):
    px = frame(spark, bars([200.0, 250.0]) + bars([199.0, 199 * 1.349], "B") + bars([5000.0, 6250.0], "C") + bars([5001.0, 6001.0], "E"))
    got = {x.ticker: x.at_ara for x in audit.limit_flags(px).where("prev_close is not null").collect()}
    assert got == {"A": True, "B": True, "C": True, "E": True}


def test_clean_prices_strict(spark):
    with pytest.raises(ValueError):
        audit.clean_prices(frame(spark, bars([1.0])), strict=True)


def test_repair_keeps_what_a_correction_lacks_and_rejects_twice(spark):
    px = frame(spark, bars([100.0, 1000.0]))
    fix = spark.createDataFrame([(D[1], "A", 100.0)], "dt date, ticker string, close double")
    r = audit.repair_prices(px, fix).orderBy("dt").collect()
    assert r[1].close == 100.0 and r[1].open == 1000.0
    flow = spark.createDataFrame([(D[1], "A", "X", None, 5.0), (D[1], "A", "Y", 1.0, 5.0)], "dt date, ticker string, broker_code string, bval double, netval double")
    got = {x.broker_code: x.netval for x in audit.rescale_netval(flow, px, fix).collect()}
    assert got == {"X": 0.5, "Y": 5.0}
    with pytest.raises(Exception, match="given twice"):
        audit.repair_prices(px, fix.union(fix)).collect()
