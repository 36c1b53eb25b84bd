import re

import corpus_pipeline
from pyspark.sql.classic.dataframe import DataFrame
from quantloom.llm.queries import QUERIES


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before.count()
    key = lambda d: sorted((r.doc_id, r.text, r.n_tokens, tuple(r.token_ids)) for r in d.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(docs)


def test_documents_stay_where_no_language_can_be_learnt(spark, sf, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars")
    out = corpus_pipeline.identify_language(spark, docs, sf)
    assert out.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in out.collect()} == {1, 2, 6, 7, 8, 10, None}


def test_stages_on_odd_rows(spark, sf, odd_docs):
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars", "h")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    got = {r.doc_id for r in docs.collect()}
    assert {1, 7, None} <= got and not got & {2, 3, 4, 5, 9}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def _workers_at_once(plan):
    """Most Python nodes that one task runs, from the text of a plan."""
    most, above = 0, []  # (column of the node, Python nodes from it up to the exchange over it)
    for line in plan.split("\n"):
        at = re.search(r"[A-Za-z]", line)
        if at is None:
            continue
        above = [x for x in above if x[0] < at.start()]
        n = above[-1][1] if above else 0
        name = re.sub(r"^\*?\(\d+\) ", "", line[at.start() :])
        n = 0 if "Exchange" in name.split(" ")[0] else n + name.startswith(("MapInArrow", "PythonMapInArrow", "FlatMapGroups"))
        above.append((at.start(), n))
        most = max(most, n)
    return most


def test_a_task_has_one_python_worker_at_a_time(spark, sf, monkeypatch):
    """Every further one costs an executor a process for each of its cores."""
    seen = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, f=DataFrame.mapInArrow, **b: seen.append(out := f(self, *a, **b)) or out)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        seen.append(stage(spark, docs, sf))
    assert len(seen) > 12
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert max(map(_workers_at_once, plans)) == 1
