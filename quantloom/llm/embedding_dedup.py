"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt on a bounded, repeatable sample (``SAMPLE``
vectors), alternating between the nearest binary codes and the rotation that fits them
best (Procrustes by SVD). A code has as many bits as the vectors have numbers (up to
``BITS``) and is cut into segments of about log2(rows of the largest label) bits, so that
a segment's value stays rare whatever the table's size. Each segment is a table, probed
with the segment itself and with each that sets one more bit (of two segments one bit
apart, exactly one has that bit unset, so the two directions meet once). There are as many
tables as it takes for a pair at the threshold to meet in one with all but a chance of
``MISS``; where one code has too few segments, further rotations give more.

What meets at a table's entry is compared in tiles: the rows of an entry with many are
dealt to tiles of about ``TILE``, and each two tiles are a unit of work of their own. A
unit compares the original vectors in double precision, counts a pair only in the first
table where it meets, and returns for each vector its number of links and one edge of a
spanning forest: pairs are never rows. No false link is returned; recall against brute
force is measured in the tests.

Equal vectors of a label are one class with a multiplicity: copies are never expanded
into pairs, and two members of a class are linked by definition.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite value
links with nothing, and so does a null label; vectors of different lengths never link;
rows without an id are returned without a component; rows that share an id are kept and
share a component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .components import connected_components

THRESHOLD = 0.93
#: Bounds of the sample that the rotation is learnt on: vectors, and numbers in them.
SAMPLE = 20_000
SAMPLE_VALUES = 4_000_000
#: Most bits of a code, and of a segment.
BITS = 128
WIDEST = 28
ROUNDS = 30
#: Chance that a pair at the threshold meets in no table.
MISS = 0.01
#: Rows of a table's entry that one unit of work compares with as many others.
TILE = 256


class Itq:
    """Mean, principal axes and rotation of one vector length."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 3):
        n, d = x.shape
        c = min(bits, d)
        self.mean = x.mean(0) if n else np.zeros(d)
        values, axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean) / max(1, n))
        axes = axes[:, np.argsort(-values)[:c]]
        v = (x - self.mean) @ axes
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(c, c)))[0]
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            r = (left @ right).T
        self.rotation = axes @ r

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation >= 0


class Tables:
    """The tables of one vector length: rotations, and the segments of their codes."""

    def __init__(self, x: np.ndarray, rows: int, threshold: float = THRESHOLD, miss: float = MISS):
        c = min(BITS, x.shape[1])
        self.width = min(c, WIDEST, max(8, math.ceil(math.log2(max(2, rows)))))
        flip = math.acos(min(1.0, threshold)) / math.pi
        meet = (1 - flip) ** self.width + self.width * flip * (1 - flip) ** (self.width - 1)
        self.count = max(1, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - meet))))
        self.rotations = [Itq(x, seed=3 + k) for k in range(math.ceil(self.count / (c // self.width)))]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) segments as integers."""
        place = np.int64(1) << np.arange(self.width, dtype=np.int64)
        out = []
        for r in self.rotations:
            bits = r.bits(x)
            out += [bits[:, k : k + self.width].astype(np.int64) @ place for k in range(0, bits.shape[1] - self.width + 1, self.width)]
        return np.stack(out[: self.count], 1)


def _unit(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and unit vectors of the usable ones."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v:
            by.setdefault(len(v), []).append(i)
    out = {}
    for d, at in by.items():
        x = np.array([vectors[i] for i in at], np.float64)  # a null becomes nan
        with np.errstate(all="ignore"):
            scale = np.abs(x).max(1)
            y = x / scale[:, None]
            y /= np.linalg.norm(y, axis=1)[:, None]
            good = np.isfinite(x).all(1) & (scale > 0) & np.isfinite(y).all(1)
        if good.any():
            out[d] = np.array(at)[good], y[good]
    return out


def fit(vectors: DataFrame, emb_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE) -> dict[int, Tables]:
    """Tables for each vector length, from the vectors with the lowest hashes; only counts and the sample reach the driver."""
    width = vectors.agg(F.max(F.size(emb_col)).alias("n")).first()["n"] or 0
    rows = vectors.groupBy(label_col).count().agg(F.max("count").alias("n")).first()["n"] or 0
    sample = min(sample, SAMPLE_VALUES // max(1, width))
    taken = vectors.where(F.col(emb_col).isNotNull()).select(F.xxhash64(emb_col).alias("h"), F.col(emb_col).alias("e")).orderBy("h").limit(sample).collect()
    return {d: Tables(x, rows, threshold) for d, (_, x) in _unit([r["e"] for r in taken]).items()}


def classes(vectors: DataFrame, models: dict[int, Tables], id_col: str, emb_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, width, keys, unit) of every row; equal vectors have equal units, null where nothing can link."""
    bc = vectors.sparkSession.sparkContext.broadcast(models)  # bounded: some rotations a vector length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, width, keys, unit = ([None] * b.num_rows for _ in range(4))
            for d, (at, x) in _unit(b.column(2).to_pylist()).items():
                own = bc.value.get(d)  # a length outside the sample is one entry, compared whole
                keyed = own.keys(x).tolist() if own else [[0]] * len(x)
                for i, k, u in zip(at.tolist(), keyed, x, strict=True):
                    dim[i], width[i], keys[i], unit[i] = d, own.width if own else 0, k, u.tobytes()
            cols = [b.column(0), b.column(1), pa.array(dim, pa.int32()), pa.array(width, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(unit, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "dim", "width", "keys", "unit"])

    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(emb_col).cast("array<double>").alias("e"))
    return plain.mapInArrow(run, "vec_id long, label string, dim int, width int, keys array<long>, unit binary")


ENTRY = ["label", "dim", "tab", "key"]


def units_of_work(nodes: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(label, dim, tab, key, x, y, s, node, h): who meets whom; s = 0 are the rows that the others meet.

    nodes: (label, dim, node, h, width, keys). In a unit with x = y the rows with s = 0 also meet each other.
    """
    own = nodes.select("label", "dim", "node", "h", "width", F.posexplode("keys").alias("tab", "key"))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    unset = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.col("key").bitwiseAND(one(i)) == 0)
    probes = own.where("width > 0").select("label", "dim", "node", "h", "tab", F.explode(F.transform(unset, lambda i: F.col("key").bitwiseOR(one(i)))).alias("key"))
    return tiled(own.drop("width"), probes, scratch, tile)


def tiled(own: DataFrame, probes: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """The units of work of a table's rows and what probes it, both (label, dim, tab, key, node, h)."""
    held = own.groupBy(*ENTRY).agg(F.count("*").alias("t"))
    met = scratch.keep(probes.join(held.hint("merge"), ENTRY), "probes")
    asked = scratch.keep(met.groupBy(*ENTRY).agg(F.count("*").alias("p")), "asked")
    base = own.join(held.hint("merge"), ENTRY).join(asked.hint("merge"), ENTRY, "left").withColumn("p", F.coalesce("p", F.lit(0).cast("long"))).where("t + p > 1")
    both = base.withColumn("s", F.lit(0)).unionByName(met.join(asked.hint("merge"), ENTRY).withColumn("s", F.lit(1)))
    # entries that fit into one tile are one unit; else the rows' tiles 0 .. n_t - 1 and the probes' n_t .. n_t + n_p - 1
    small = F.col("t") + F.col("p") <= tile
    n_t, n_p = (F.when(small, least).otherwise(F.ceil(F.col(c) / tile)).cast("int") for c, least in (("t", 1), ("p", 0)))
    both = both.withColumn("n_t", n_t).withColumn("n_p", n_p)
    spread = lambda n: F.pmod(F.xxhash64("node", "h"), F.col(n)).cast("int")
    both = both.withColumn("r", F.when(F.col("s") == 0, spread("n_t")).when(small, 0).otherwise(F.col("n_t") + spread("n_p")))
    partners = F.sequence(F.lit(0), F.when(F.col("s") == 0, F.col("n_t") + F.col("n_p")).otherwise(F.col("n_t")) - 1)
    spread_out = both.select(*ENTRY, "node", "h", "r", "s", F.explode(partners).alias("o"))
    side = F.when(F.col("r") == F.col("o"), F.col("s")).otherwise((F.col("r") > F.col("o")).cast("int"))
    return spread_out.select(*ENTRY, F.least("r", "o").alias("x"), F.greatest("r", "o").alias("y"), side.alias("s"), "node", "h")


def _pairs(begin: np.ndarray, n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (row, partner) for ``n`` partners of each row from ``begin`` on, about ``most`` at a time."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        size = n[lo:hi]
        a = np.repeat(np.arange(lo, hi), size)
        yield a, begin[a] + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        lo = hi


def pairs_of_units(t: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (row, partner) of who meets whom in whole units, about ``most`` at a time."""
    n = t.num_rows
    s = t.column("s").to_numpy()
    new = np.zeros(n, bool)
    new[0] = True
    for c in (*ENTRY, "x", "y"):
        col = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(new)
    unit = np.cumsum(new) - 1
    base = np.bincount(unit[s == 0], minlength=len(begin))
    alone = (t.column("x").to_numpy() == t.column("y").to_numpy())[begin]
    partners = np.where(s == 1, base[unit], np.where(alone[unit], np.arange(n) - begin[unit], 0))
    yield from _pairs(begin[unit], partners, most)


def _compare(t: pa.Table, threshold: float) -> pa.RecordBatch:
    """(node, h, m, to) of the rows of whole units of one vector length: linked copies, and an edge of a spanning forest."""
    n = t.num_rows
    x = np.frombuffer(b"".join(t.column("unit").to_pylist())).reshape(n, -1)
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(n, -1)
    copies, node, tab = (t.column(c).to_numpy() for c in ("copies", "node", "tab"))
    a_all, b_all = [], []
    for a, b in pairs_of_units(t, max(1, (4 << 20) // (8 * x.shape[1]))):
        first = (np.bitwise_count(keys[a] ^ keys[b]) <= 1).argmax(1)
        a, b = (v[first == tab[a]] for v in (a, b))
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        a_all.append(a[near])
        b_all.append(b[near])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_all, b_all))
    m = np.zeros(n, np.int64)
    np.add.at(m, a, copies[b])
    np.add.at(m, b, copies[a])
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    hit = np.flatnonzero(m)
    to = pa.array(node[root[hit]], mask=root[hit] == hit)
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(t.column("h").to_numpy()[hit]), pa.array(m[hit]), to], ["node", "h", "m", "to"])


def in_units(work: DataFrame, nodes: DataFrame, judged: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``judged`` over tables of whole units of work, their rows joined with ``nodes`` by (node, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for big in batches:
            for lo in range(0, big.num_rows, 8 * TILE):
                held.append(big.slice(lo, 8 * TILE))
                t = pa.Table.from_batches(held)
                same = np.ones(t.num_rows, bool)  # the last unit may go on
                for c in (*ENTRY, "x", "y"):
                    col = t.column(c)
                    same &= pc.equal(col, col[-1]).to_numpy()
                cut = t.num_rows - int(same.sum())
                if cut:
                    yield from judged(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held))
        tidy()

    group = [*ENTRY, "x", "y"]
    dealt = work.join(nodes.hint("merge"), ["node", "h"]).repartition(*group).sortWithinPartitions(*group, "s")
    return dealt.mapInArrow(run, schema)


def verified(work: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, h, m, to): ``_compare`` over all units of work; many rows a node."""

    def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for d in pc.unique(t.column("dim")).to_pylist():
            yield _compare(t.filter(pc.equal(t.column("dim"), d)), threshold)

    return in_units(work, nodes.select("node", "h", "unit", "keys", "copies"), judged, "node long, h long, m long, to long")


def embedding_links(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_col: str = "vec_id", emb_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = scratch.keep(classes(vectors, fit(vectors, emb_col, label_col, threshold), id_col, emb_col, label_col), "codes")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    grouped = rows.where(usable).groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("width").alias("width"))
    nodes = scratch.keep(grouped.withColumn("h", F.xxhash64("label", "dim", "unit")), "classes")
    work = scratch.keep(units_of_work(nodes.select("label", "dim", "node", "h", "width", "keys"), scratch), "work")
    found = scratch.keep(verified(work, nodes, threshold), "found")
    degree = found.groupBy("node", "h").agg(F.sum("m").alias("m"))
    groups = connected_components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")), scratch)
    label = nodes.join(degree, ["node", "h"], "left").join(groups, "node", "left")
    label = scratch.keep(label.select("label", "dim", "unit", (F.col("copies") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "labels")
    free = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    own = rows.where(usable).join(label, ["label", "dim", "unit"]).select("vec_id", "n_links", "component_id")
    return own.union(free).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
