"""SimHash near-duplicates by multi-index hashing.

A fingerprint sets each of 64 bits that more than half of the shingles' XXH64 hashes set.
Distinct fingerprints are linked where at most ``RADIUS`` = 3 bits differ: the
fingerprint is cut into two 32-bit segments, one of which then differs in at most one
bit. Each segment is a table; a fingerprint probes it with its own segment and with
every segment that sets one more bit (of two segments one bit apart, exactly one has
that bit unset), and whole distances are verified. Equal fingerprints are one node, so a
large group of copies costs one row, and pairs are only made of different fingerprints
that are verified links. Both sides of the table join are plain shuffles, which adaptive
execution splits where a segment is very common.

Defined cases: text that is null or has no words has fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; rows without an id get a fingerprint
and no component; rows that share an id are kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, Scratch, as_bytes, rows_within
from .components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Shingles hashed at a time, so that a very long text stays small in memory.
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    total = n - shingle + 1
    begin = np.concatenate([[0], ends[: total - 1]]).tolist()
    end = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, total, _BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin[lo : lo + _BLOCK], end[lo : lo + _BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fp long) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_within(batches, 2 << 20, 1):
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(nodes: DataFrame) -> DataFrame:
    return nodes.select("*", F.explode(F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))).alias("s")).select("node", "fp", "s.seg", "s.key")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node long, fp long, distinct fingerprints) at 1 to RADIUS differing bits."""
    table = _segments(nodes)
    bit = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0), lambda i: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    probe = table.select(F.col("node").alias("a"), F.col("fp").alias("fa"), "seg", F.col("key").alias("own"), F.explode(F.concat(F.array("key"), bit)).alias("key"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fp"))) <= RADIUS
    once = (F.col("own") != F.col("key")) | (F.col("a") < F.col("node"))
    return probe.join(table, ["seg", "key"]).where(near & once).select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = scratch.keep(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = scratch.keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    groups = connected_components(links(nodes), scratch)
    label = scratch.keep(nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "labels")
    out = fps.join(label, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    d = near_duplicates(docs, Scratch(spark, "simhash"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows without an id stay."""
    d = near_duplicates(docs, scratch, shingle)
    gone = scratch.keep(d.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
