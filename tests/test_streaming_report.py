from pyspark.sql import functions as F

from quantloom import report
from quantloom.operators import health
from quantloom.streaming import ingest


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    s = ingest.event_stream(spark, src, events.schema, files_per_batch=1)
    q = ingest.upsert_stream(ingest.daily_summary(s, late="60 days"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    key = lambda d: sorted(map(tuple, d.select("dt", "ticker", "n", "total", "high", "low").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(ingest.daily_summary(events))


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("A", 1.23456, None)], "ticker string, x double, y int")
    assert report.markdown(d).splitlines()[-1] == "| A | 1.235 | - |"
    m = spark.range(3).select(F.lit("2024-01-05").cast("date").alias("dt"), F.lit("A").alias("ticker"))
    text = report.health_text({"freshness": health.freshness({"m": m}, "2024-02-05"), "shape": health.capture_shape(m)})
    assert "freshness" in text and "shape" in text
    report.append(str(tmp_path / "s.md"), "T", text)
    assert (tmp_path / "s.md").read_text().startswith("## T")
