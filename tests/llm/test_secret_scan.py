"""Trigram queries and secret spans against a plain scan of every text."""

import hashlib
import random
import re

import pytest

from quantloom.llm import secret_scan as X


def plain_spans(text, rules):
    out = []
    for order, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), order, r.kind, m.end()))
    return sorted(out)


def holds(query, text):
    if query is None:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_queries():
    q = X.trigram_query
    assert q(r"[0-9a-f]{32,}") is None and q("ab") is None and q("(abc)*") is None
    assert q("abc") == "abc" and q("(?i)aBc") == "abc"
    assert q("abcd[0-9]+xyz") == ("and", frozenset(["abc", "bcd", "xyz"]))
    assert q("(abc|xyz)d") == ("or", frozenset([("and", frozenset(["abc", "bcd"])), ("and", frozenset(["xyz", "yzd"]))]))
    assert q("api_?key")[0] == "or" and "pi_" in X.trigrams(q("api_?key"))
    assert q("(abc)+.*") == "abc" and q("(abc|.)x") is None


ALPHABET = ["password", "PassWord", "passwd", "secret", "Token", "api_key", "APIKEY", " ", "  ", "=", ":", '"', "'", "x", "é", "😀", "abcdefgh", "AKIA", "ABCD1234EFGH", "0a1b2c3d", "deadbeef" * 4, "\n", ".", "ghp_" + "a1" * 18, "K", "ſ", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefghijklm", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 35]


def random_texts(n, seed):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 14))) for _ in range(n)]


def test_a_query_holds_for_every_match():
    for r in X.BASE + X.ADDED:
        query = X.trigram_query(r.pattern)
        texts = random_texts(3000, 1)
        assert any(re.search(r.pattern, t) for t in texts) or r.kind in ("slack", "stripe")
        assert all(holds(query, t) for t in texts if re.search(r.pattern, t, re.ASCII))


def test_spans(spark):
    texts = random_texts(1500, 2) + [None, "", "token=secret: abcdefghij", "token = abcdefghé" * 700, "deadbeef" * 40000, "a" * 300000 + "AKIA" + "X" * 12, "AKIAAKIA" * 2 + "_" + "AKIA1"]
    rows = [(i, t, "k", "s") for i, t in enumerate(texts)] + [(None, "token: 12345678", "k", "s"), (5, "passwd=abcdefgh", "k", "s"), (5, "passwd=abcdefgh", "k", "s"), (1 << 40, "secret='abcdefgh'", "k", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string, id string").repartition(4)
    rules = X.BASE + X.ADDED
    got = X.secret_spans(df).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, [tuple(s) for s in r.spans]) for r in got), key=str) == sorted(((i is not None, i or 0, plain_spans(t, rules)) for i, t, *_ in rows), key=str)
    want = sorted(",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_spans(t, X.BASE)) for _, t, *_ in rows)
    assert sorted(r.base_sha256 for r in X.secret_digest(df).collect()) == sorted(hashlib.sha256(s.encode()).hexdigest() for s in want)
    assert X.secret_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_places_in_two_levels(spark, n):
    from pyspark.sql import functions as F

    d = spark.range(1).select(F.array_repeat(F.lit(3).cast("long"), n).alias("a"))
    assert d.select(X.before_each(F.col("a")).alias("b")).first().b == [3 * i for i in range(n)]


def test_main_path_is_native(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = X.secret_digest(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn|CartesianProduct|NestedLoop", plan)
