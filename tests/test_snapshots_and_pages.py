"""Snapshot tables through crashes, and result pages as a data source."""

import json

import pytest

from quantloom.sources import paged, snapshots

ROWS = "dt date, ticker string, close double"


def rows(spark, *r, schema=ROWS):
    return spark.createDataFrame(list(r), schema)


def day(k):
    import datetime

    return datetime.date(2024, 1, k)


def content(spark, path, **kw):
    return {(r.dt, r.ticker): r.close for r in snapshots.read_snapshot(spark, path, **kw).collect()}


def test_upserts_and_versions(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, p)
    assert snapshots.upsert_snapshot(rows(spark, (day(1), "A", 1.0), (day(2), "A", 2.0), (None, "A", 0.5)), p, ["dt", "ticker"]) == 1
    assert snapshots.upsert_snapshot(rows(spark, (day(2), "A", 3.0), (day(2), "B", 4.0)), p, ["dt", "ticker"]) == 2
    assert content(spark, p) == {(day(1), "A"): 1.0, (day(2), "A"): 3.0, (day(2), "B"): 4.0, (None, "A"): 0.5}
    assert content(spark, p, version=1)[day(2), "A"] == 2.0
    assert content(spark, p, partitions=["2024-01-01"]) == {(day(1), "A"): 1.0}
    before = snapshots.manifest(spark, p, 1)["parts"]["2024-01-01"]
    assert snapshots.manifest(spark, p)["parts"]["2024-01-01"] == before  # an untouched partition is not written again
    snapshots.upsert_snapshot(rows(spark, (day(2), "C", 1.0, "x"), schema=ROWS + ", note string"), p, ["dt", "ticker"])
    assert {(r.ticker, r.note) for r in snapshots.read_snapshot(spark, p).where("dt = date '2024-01-02'").collect()} == {("A", None), ("B", None), ("C", "x")}
    assert snapshots.vacuum(spark, p, keep=1) == 1 and len(content(spark, p)) == 5 and snapshots.versions(spark, p) == [3]


@pytest.mark.parametrize("where", ["stage", "draft", "rename"])
def test_a_crash_leaves_the_old_table(spark, tmp_path, monkeypatch, where):
    p = str(tmp_path / "t")
    snapshots.upsert_snapshot(rows(spark, (day(1), "A", 1.0)), p, ["dt", "ticker"])
    new = rows(spark, (day(1), "A", 9.0), (day(2), "B", 2.0))
    if where == "stage":
        bad = new.selectExpr("dt", "ticker", "case when ticker = 'B' then raise_error('lost') else close end as close")
        with pytest.raises(Exception, match="lost"):
            snapshots.upsert_snapshot(bad, p, ["dt", "ticker"])
    elif where == "draft":
        snapshots.stage(new, p, ["dt", "ticker"])
        (tmp_path / "t/manifests/.2-half").write_text('{"schema":')
    else:
        version, made = snapshots.stage(new, p, ["dt", "ticker"])
        snapshots.upsert_snapshot(rows(spark, (day(3), "C", 3.0)), p, ["dt", "ticker"])  # another writer was first
        with pytest.raises(Exception, match="(?i)exist"):
            snapshots._commit(spark, p, version, made)
    old = {(day(1), "A"): 1.0} | ({(day(3), "C"): 3.0} if where == "rename" else {})
    assert content(spark, p) == old
    snapshots.upsert_snapshot(new, p, ["dt", "ticker"])
    assert content(spark, p) == old | {(day(1), "A"): 9.0, (day(2), "B"): 2.0}
    assert snapshots.vacuum(spark, p, keep=1) >= 1 and content(spark, p)[day(1), "A"] == 9.0


def land(spark, sf, folder, size):
    """The events table as result pages."""
    events = [r.asDict() for r in spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id", "event_type", "value").orderBy("event_id").collect()]
    pages = [events[i : i + size] for i in range(0, len(events), size)]
    for k, own in enumerate(pages, 1):
        body = own if k % 2 else {"data": own}
        (folder / f"{k}.json").write_text(json.dumps({"success": True, "meta": {"last_page": len(pages)}, "data": body}))
    return events, pages


def test_pages_of_events(spark, sf, tmp_path):
    events, pages = land(spark, sf, tmp_path, 100)
    kinds = dict(spark.read.parquet(f"{sf}/events.parquet").dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("event_id", "user_id", "event_type", "value"))
    read = lambda **kw: paged.read_paged(spark, str(tmp_path / "{page}.json"), schema, **kw)
    whole = read(max_pages=10**6)
    key = lambda r: r["event_id"]
    assert sorted([{k: v for k, v in r.asDict().items() if k != "page"} for r in whole.collect()], key=key) == sorted(events, key=key)
    assert spark.read.format("pages").schema(f"page int, success boolean, {schema}").option("path", str(tmp_path / "{page}.json")).option("maxPages", "3").load().rdd.getNumPartitions() == 3
    assert {r.page for r in read(max_pages=4).select("page").distinct().collect()} == {1, 2, 3, 4}
    (tmp_path / "3.json").write_text(json.dumps({"success": False, "message": "limit"}))
    assert read(max_pages=6).count() == sum(map(len, pages[:2]))
    (tmp_path / "2.json").unlink()
    assert read(max_pages=6).count() == len(pages[0])
    (tmp_path / "1.json").write_text("{broken")
    assert read().count() == 0
    (tmp_path / "1.json").write_text(json.dumps({"success": True, "data": [{"event_id": "x", "value": 1}]}))
    assert [tuple(r)[1:] for r in read().collect()] == [(None, None, None, 1.0)]
