"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from quantloom.plans import oracle, queries

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    df = queries.queries()[name](spark, sf)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    kinds = dict(df.dtypes)
    assert {c[0]: str(c[1]) for c in cur.description} == {c: TYPES[kinds[c]] for c in cols}
    key = lambda r: [(v is not None, str(v) if not isinstance(v, float) else f"{v:.4f}") for v in r]
    ours, theirs = sorted(([r[c] for c in cols] for r in df.collect()), key=key), sorted(map(list, cur.fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert all(close(a, b) for x, y in zip(ours, theirs, strict=True) for a, b in zip(x, y, strict=True))


def test_boosted_walk_forward_and_its_views(monkeypatch, spark, sf):
    """The three outputs come from one fit of the whole panel; fewer trees than the query's, so that the test is short."""
    from quantloom.operators import boosting

    assert queries.walkforward.tree_walk_forward.__defaults__ == ("target", 30, 6, None, False)
    assert boosting.Params() == boosting.Params(100, 4, 0.05, 0.8, 0.8, 1.0, 10, 64) and len(set(queries.FEATURES)) == 8
    monkeypatch.setattr(boosting.Params, "__init__", lambda self: [object.__setattr__(self, k, v) for k, v in zip(("trees", "depth", "rate", "rows", "columns", "l2", "patience", "bins"), (3, 3, 0.3, 0.8, 0.8, 1.0, 10, 64), strict=True)] and None)
    q = queries.queries()
    cycles, preds = q["walk_forward_cycles"](spark, sf).collect(), q["gbt_walk_forward"](spark, sf)
    panel = queries.features.training_panel(queries.StandIn(spark, sf).B, queries.StandIn(spark, sf).P)
    dates = sorted(r.dt for r in panel.select("dt").distinct().collect())
    assert [r.cycle for r in sorted(cycles, key=lambda r: r.cycle)] == list(range(1, (len(dates) - 30) // 6 + 1))
    assert preds.count() == panel.where(panel.dt.isin(dates[30 : 30 + 6 * len(cycles)])).count()
    pooled = q["walk_forward_pooled"](spark, sf).first()
    trades = q["walk_forward_trades"](spark, sf)
    assert pooled.n_trades == sum(r.n_trades for r in cycles) == trades.where("place = 0").count() > 0
    assert trades.count() == 3 * pooled.n_trades
    assert q["permutation_importance"](spark, sf).count() == 8


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
