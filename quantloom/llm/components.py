"""Connected components by alternating large-star and small-star rounds.

Every round is joins and map-side combined aggregations over the edge list. The
per-node minima are written out before they are joined, so both sides of each join are
plain shuffles that adaptive execution may split where one node has very many edges.
Nothing but two scalars a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a long, b long), in any direction and with repeats -> (node, component).

    One row for every node of an edge between two different nodes; component is the
    smallest node reachable. No edges: no rows.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("v").alias("s"), F.col("u").alias("d")).union(e.select(F.col("u").alias("s"), F.col("v").alias("d")))
        low = scratch.keep(both.groupBy("s").agg(F.min("d").alias("m")).select("s", F.least("s", "m").alias("m")), "min")
        large = scratch.keep(both.where("d > s").join(low, "s").select(F.col("d").alias("v"), F.col("m").alias("u")).distinct(), "large")
        least = scratch.keep(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = scratch.keep(small.union(least.select("v", F.col("m").alias("u"))).distinct(), "small")
        for old in (e, low, large, least):
            scratch.drop(old)
        e, before = new, state
        state = _state(e)
        if state == before:
            break
    return scratch.keep(e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct()), "components")
