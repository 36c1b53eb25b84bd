import duckdb
import pytest

from quantloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = c.execute(ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r[x] for x in cols) for r in got.collect()), key=key) == sorted(cur.fetchall(), key=key)
