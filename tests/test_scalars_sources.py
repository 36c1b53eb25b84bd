import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quantloom import schema
from quantloom.functions import scalars as S
from quantloom.operators import health, signals
from quantloom.sources import sinks, tables

D = [dt.date(2024, 1, d) for d in range(1, 30)]


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("1,234.5", 1234.5), ("(12.5)", -12.5), ("", 0.0), (None, 0.0), ("x", 0.0), ("nan", 0.0)])
def test_parse_num(spark, text, want):
    assert value(spark, S.parse_num(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("CDIA - daily", "CDIA"), ("Inventory chart: COIN", "COIN"), ("", None), (None, None), ("cdia daily chart", None), ("PT ABC", None)])
def test_ticker_from_title(spark, text, want):
    assert value(spark, S.ticker_from_title(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("failed", "total", "want"), [(0, 45, False), (5, 45, False), (13, 45, False), (14, 45, True), (45, 45, True), (0, 0, True)])
def test_should_fail_run(spark, failed, total, want):
    assert value(spark, S.should_fail_run(F.lit(failed), F.lit(total))) is want


def test_weekdays(spark):
    w = lambda a, b: value(spark, S.weekdays_between(F.lit(a), F.lit(b)))
    assert (w(D[4], D[7]), w(D[7], D[4]), w(D[4], D[4])) == (1, 0, 0)


def test_series_signature(spark):
    sig = lambda c: value(spark, S.series_signature(F.array(*[F.lit(d) for d in D[: len(c)]]), F.array(*map(F.lit, c))))
    assert sig([700.0, 715.0]) != sig([2560.0, 2600.0])
    assert value(spark, S.series_signature(F.array().cast("array<date>"), F.array().cast("array<double>"))) is None
    assert sig([1.0, 2.0, 3.0, 4.0, 5.0]).c_tail == [3.0, 4.0, 5.0]


def test_constants():
    assert len(schema.BROKER_CODES) == 30 and len(schema.TRACKED) == 45 and schema.ABSORBERS == ["IF", "AZ", "BB", "AK", "BK", "ZP", "RX", "YU", "AI", "CC"]


def test_upsert_replaces_whole_rows_and_keeps_live_ones(spark, tmp_path):
    p = str(tmp_path / "flow")
    row = lambda d, v, b: (d, "A", "X", b, v)
    ddl = "dt date, ticker string, broker_code string, bval double, netval double"
    sinks.upsert(spark.createDataFrame([row(D[0], 1.0, 9.0), row(D[1], 2.0, None)], ddl), p, ["dt", "ticker", "broker_code"])
    sinks.upsert(spark.createDataFrame([row(D[0], 5.0, None), row(D[1], 6.0, None)], ddl), p, ["dt", "ticker", "broker_code"], provenance="bval")
    got = {r.dt: (r.netval, r.bval) for r in spark.read.parquet(p).collect()}
    assert got == {D[0]: (1.0, 9.0), D[1]: (6.0, None)}


def test_wide_upsert_adds_columns(spark, tmp_path):
    p = str(tmp_path / "wide")
    sinks.wide_upsert(spark.createDataFrame([(D[0], "A", 1.0)], "dt date, ticker string, close double"), p, ["dt", "ticker"])
    sinks.wide_upsert(spark.createDataFrame([(D[1], "A", [1, 2])], "dt date, ticker string, buyers array<int>"), p, ["dt", "ticker"])
    d = spark.read.option("mergeSchema", "true").parquet(p)
    got = {r.dt: (r.close, r.buyers) for r in d.collect()}
    assert got == {D[0]: (1.0, None), D[1]: (None, "[1,2]")}


def test_wide_upsert_keeps_types_in_variants(spark, tmp_path):
    p = str(tmp_path / "wide")
    sinks.wide_upsert(spark.createDataFrame([(D[0], "A", (1.5, ["x"]))], "dt date, ticker string, info struct<a:double,b:array<string>>"), p, ["dt", "ticker"], variant=True)
    sinks.wide_upsert(spark.createDataFrame([(D[0], "B", ("text", 7)), (D[1], "A", (None, None))], "dt date, ticker string, info struct<a:string,c:long>"), p, ["dt", "ticker"], variant=True)
    d = sinks.variant_fields(spark.read.parquet(p), "info", {"a": ("$.a", "double"), "s": ("$.a", "string"), "b0": ("$.b[0]", "string"), "c": ("$.c", "bigint")})
    got = {(r.dt, r.ticker): tuple(r)[-4:] for r in d.select("dt", "ticker", "a", "s", "b0", "c").collect()}
    assert got == {(D[0], "A"): (1.5, "1.5", "x", None), (D[0], "B"): (None, "text", None, 7), (D[1], "A"): (None, None, None, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,ticker,close\n2024-01-02,A,5.5\n")
    r = tables.read_corrections(spark, str(tmp_path / "c.csv")).first()
    assert (r.dt, r.ticker, r.close) == (D[1], "A", 5.5)
    (tmp_path / "bad.csv").write_text("date,close\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="ticker"):
        tables.read_corrections(spark, str(tmp_path / "bad.csv"))
    assert tables.read_signals(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "p1.json").write_text(json.dumps({"page": 1, "data": [{"symbol": "A", "close": 1.5}]}))
    (tmp_path / "p2.json").write_text(json.dumps({"page": 30, "data": [{"symbol": "B", "close": 2.5}]}))
    assert [tuple(r) for r in tables.read_pages(spark, str(tmp_path / "p*.json"), "symbol string, close double").collect()] == [(1, "A", 1.5)]
    chart = {"title": "CDIA - x", "price": {"x": ["2024-01-02"], "open": [1.0], "high": [2.0], "low": [0.5], "close": [1.5]}, "volume": {"x": ["2024-01-02"], "y": [9.0]}, "brokers": [{"name": "A.K", "x": ["2024-01-02"], "cum_lot": [3.0]}]}
    (tmp_path / "chart.jsonl").write_text(json.dumps(chart))
    c = tables.read_charts(spark, str(tmp_path / "chart.jsonl"))
    assert tuple(tables.chart_prices(c).first()) == (D[1], "CDIA", 1.0, 2.0, 0.5, 1.5, 9.0)
    assert tuple(tables.chart_traces(c).first()) == (D[1], "CDIA", "AK", 3.0)


def test_scans_prune_and_push_down(spark, tmp_path, capsys):
    p = str(tmp_path / "px")
    spark.createDataFrame([(D[0], "A", 1.0, 1.0, 1.0, 1.0, 1.0)], schema.PRICE_HISTORY).write.parquet(p)
    tables.read_panel(spark, p, schema.PRICE_HISTORY).explain("formatted")
    plan = capsys.readouterr().out
    assert "IsNotNull(close)" in plan and "volume" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_cross_source_prefers_the_first_best_offset(spark):
    ph = spark.createDataFrame([(D[i], f"T{i}{k}", 100.0 + i + k) for i in range(5) for k in range(10)], "dt date, ticker string, close double")
    ms = ph.select(F.date_add("dt", 1).alias("dt"), "ticker", "close")
    got = {r.day_offset: (r.n, r.is_best) for r in health.cross_source(ms, ph).collect()}
    assert got == {1: (50, True)}


def test_backfill_progress_fills_zeros(spark):
    f = spark.createDataFrame([(D[0], "A"), (D[1], "A")], "dt date, ticker string")
    got = {r.ticker: (r.days, r.pending) for r in signals.backfill_progress(f, ["A", "B"], 3).collect()}
    assert got == {"A": (2, 1), "B": (0, 3)}


def test_backfill_takes_differences_before_filters(spark):
    t = spark.createDataFrame([(D[0], "A", "X", 10.0), (D[1], "A", "X", 30.0), (D[2], "A", "X", 60.0)], "dt date, ticker string, broker_code string, cum_lot double")
    px = spark.createDataFrame([(D[2], "A", 1e7)], "dt date, ticker string, close double")
    assert [(r.dt, r.netval) for r in signals.backfill_netval(t, px).collect()] == [(D[2], 30.0)]
