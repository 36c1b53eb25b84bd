"""Near copies by Jaccard similarity: SimHash multi-index hashing, then an exact check.

Words are those of ``simhash``, shingles have five of them (fewer words: the whole
sequence), and two texts are linked where their shingle sets have a Jaccard similarity of
``JACCARD`` = 0.8 or more. Sets with that similarity have a cosine of at least
2 J / (1 + J), so each bit of a SimHash differs with a chance of at most
acos(2 J / (1 + J)) / pi = 0.152; that many differing bits are out of reach of one 64-bit
fingerprint's balls. The fingerprint is therefore as long as it takes:

* it is cut into segments of log2(documents) + ``SPARE`` bits, so that a segment's value
  stays rare whatever the table's size, and each segment is a table;
* a table is probed with the segment itself and each of its ball of ``FLIPS`` = 2 bits whose
  highest flipped bit gets set (of two segments that differ, exactly one has that bit
  unset, so that each pair meets once); a filter of the entries that exist stops nearly
  all other probes where they are made. The filter has a fixed size; a table of more
  entries is probed in rounds of some tables, or of a part of one table's entries;
* there are as many segments as let a pair at the limit meet in one with all but a chance
  of ``MISS``; every row carries a 64-bit sketch (the fingerprint's last word, which is in
  no segment), compared where rows meet. Whole distances of what is left are verified
  against the distance that a pair at the limit keeps within with a chance of 99%, and
  Jaccard similarities of what is left then exactly, on the shingles of the whole texts.

A large group of near copies is not expanded into pairs: first every text is compared only
with the first of each entry it lies in, and the groups found so are known when entries
are compared whole: a probe by a text whose group holds all of an entry is dropped before
it meets the entry, and other texts already in one group are not compared again.
Texts with equal shingle sets are one class from the start.

A large family of texts that are a little less alike than the limit would still be all
pairs. So texts within the distance of fingerprints of an entry's first text are a cell,
whether or not they turn out to be copies of it, and a cell counts as one group where
entries are compared. A cell that holds several groups is compared inside by itself: its
shingle sets are dealt to blocks, each two blocks are a tile, and a tile finds the
similarities of all its pairs in one task and returns a forest of its links, at most one
row a text. That work grows with the square of a cell, the rows do not.

No false link is returned; recall is measured in the tests. Where a set has only a few
shingles its bits are less independent, and more pairs just above the limit are missed.

Defined cases: null text and text without words have no shingles and are copies of one
another; rows without an id get no component; rows that share an id are one document; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from .common import LOWER, Scratch, as_bytes, rows_within, tidy
from .components import connected_components

SHINGLE = 5
JACCARD = 0.8
#: Chance that a pair at the limit meets in no table.
MISS = 0.04
#: Bits that a segment has beyond log2(documents), and its bounds; bits that a ball flips.
SPARE = 8
NARROWEST, WIDEST = 12, 52
FLIPS = 2
#: Distance of fingerprints within which texts are in one cell, in distances of a pair at the limit.
REACH = 2
SEED = 42
PAIR = ["a", "ha", "b", "hb"]
PAIR_SCHEMA = "a long, ha long, b long, hb long"
_BLOCK = 1 << 14
_BATCH = 2 << 20
#: Most shingles and most texts in a block of a cell (on average, texts are dealt by hash), and
#: blocks of a smaller cell, one for each SPREAD texts, so that a cell is many tasks.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 19, 1 << 10
BLOCKS, SPREAD = 8, 64
_COLUMNS = 1 << 11


class Plan:
    """Segment width, number of tables, and the largest distances of sketches and of fingerprints."""

    def __init__(self, rows: int, jaccard: float = JACCARD, miss: float = MISS):
        flip = math.acos(2 * jaccard / (1 + jaccard)) / math.pi
        w = self.width = min(WIDEST, max(NARROWEST, math.ceil(math.log2(max(2, rows))) + SPARE))
        meet = sum(math.comb(w, i) * flip**i * (1 - flip) ** (w - i) for i in range(FLIPS + 1))
        self.tables = math.ceil(math.log(miss) / math.log(1 - meet))
        self.words = -(-w * self.tables // 64) + 1
        bits = 64 * self.words
        self.radius = math.ceil(bits * flip + 2.33 * math.sqrt(bits * flip * (1 - flip)))
        self.reach = math.ceil(REACH * bits * flip)
        self.sketch = math.ceil(64 * flip + 4 * math.sqrt(64 * flip * (1 - flip)))

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """(rows, tables) keys of (rows, words * 8) bytes: a segment, above it the number of its table."""
        place = np.int64(1) << np.arange(self.width, dtype=np.int64)
        used = np.unpackbits(fp, axis=1, bitorder="little")[:, : self.width * self.tables].reshape(-1, self.tables, self.width)
        return (used.astype(np.int64) @ place) | (np.arange(self.tables, dtype=np.int64) << np.int64(WIDEST))

    def ball(self) -> tuple[np.ndarray, np.ndarray]:
        """Masks of one to ``FLIPS`` bits, and the highest bit of each."""
        sets = [c for i in range(1, FLIPS + 1) for c in itertools.combinations(range(self.width), i)]
        return np.array([sum(1 << i for i in c) for c in sets], np.int64), np.array([1 << c[-1] for c in sets], np.int64)

    def rounds(self, rows: int) -> list[tuple[int, int, int, int]]:
        """(first table, table after the last, part, parts) of each round, of ``EntryFilter.ROOM`` entries or less."""
        parts = max(1, -(-rows // EntryFilter.ROOM))
        each = max(1, EntryFilter.ROOM // max(1, rows))
        return [(t, min(t + each, self.tables), k, parts) for t in range(0, self.tables, each) for k in range(parts)]


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 hashes of the shingles."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    size = min(n, shingle)
    begin = np.concatenate([[0], ends[: n - size] + 1]).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def long_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``64 * words`` bits of a set of hashes; each word mixes them anew."""
    ones = np.zeros(64 * words, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(h), _BLOCK):
        z = h[lo : lo + _BLOCK, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little")


def _set_id(h: np.ndarray) -> bytes:
    return xxh128_digest(h.tobytes(), SEED)


def _half(ids: list[bytes]) -> pa.Array:
    """The first 64 bits of set ids; with the smallest document id they name a class."""
    return pa.array(np.frombuffer(b"".join(i[:8] for i in ids), np.int64))


def set_fingerprints(docs: DataFrame, plan: Plan, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, set_id, h, fp) of every row; fp is null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_within(batches, _BATCH, 1):
            sets = [shingle_set(t, shingle) for t in as_bytes(b.column(1))]
            fp = [long_fingerprint(h, plan.words).tobytes() if len(h) else None for h in sets]
            ids = [_set_id(h) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), _half(ids), pa.array(fp, pa.binary())], ["doc_id", "set_id", "h", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, set_id binary, h long, fp binary")


def _mixed(key: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a key, for the filter and for the parts of a table."""
    z = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


class EntryFilter:
    """A Bloom filter of 16 MB: three bits of a hash, all in one of 256 slices.

    With ``ROOM`` entries a foreign hash passes with a chance of about 0.0007; with more,
    more pass, which costs later joins rows but never a result.
    """

    ROOM = 1 << 22
    SLICE = 19

    def __init__(self, slices: dict[int, bytes]):
        width = 1 << (self.SLICE - 3)
        self.bits = np.zeros(256 * width, np.uint8)
        for k, raw in slices.items():
            self.bits[k * width : (k + 1) * width] = np.frombuffer(raw, np.uint8)

    @classmethod
    def places(cls, h: np.ndarray) -> Iterator[np.ndarray]:
        """Three places in its slice of each hash."""
        mask = np.uint64((1 << cls.SLICE) - 1)
        for shift in (37, 18, 0):
            yield ((h >> np.uint64(shift)) & mask).astype(np.int64)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of the hashes that may be held."""
        at = np.arange(len(h))
        mask = np.uint64((1 << self.SLICE) - 1)
        for shift in (37, 18, 0):
            own = h[at]
            bit = (((own >> np.uint64(56)) << np.uint64(self.SLICE)) | ((own >> np.uint64(shift)) & mask)).astype(np.int64)
            at = at[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return at

    @classmethod
    def of(cls, keys: DataFrame) -> EntryFilter:
        """The filter of a table's only column, keys."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(b.column(0).to_numpy()).view(np.int64))], ["e"])

        return cls.of_hashes(keys.mapInArrow(hashed, "e long"))

    @classmethod
    def of_hashes(cls, hashes: DataFrame) -> EntryFilter:
        """The filter of a column ``e``, mixed keys; each slice is made by one group of hashes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                e = b.column(0).to_numpy().view(np.uint64)
                part = (e >> np.uint64(56)).astype(np.int64)
                for k in np.unique(part).tolist():
                    bits = held.setdefault(k, np.zeros(1 << (cls.SLICE - 3), np.uint8))
                    for at in cls.places(e[part == k]):
                        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["k", "bits"])
            tidy()

        sliced = hashes.repartition(F.shiftrightunsigned(F.col("e"), 56)).mapInArrow(run, "k int, bits binary")
        return cls({r["k"]: r["bits"] for r in sliced.collect()})  # 16 MB in all, whatever the table


ENTRY_SCHEMA = "k long, cls long, c long, sk long"


def _expanded(nodes: DataFrame, plan: Plan, seen: EntryFilter | None = None, part: tuple[int, int, int, int] | None = None, ball: bool = False, hashes: bool = False) -> DataFrame:
    """(k, cls, c, sk) of every class's own segments, or with ``ball`` of its probes; with a filter, of what may be held.

    With ``hashes`` only (e) of them, mixed keys for a filter, so that no second Python stage has to mix them.
    ``part`` is a round of the plan: only its tables, and its part of their keys.
    """
    bc = None if seen is None else nodes.sparkSession.sparkContext.broadcast(seen)  # 16 MB, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, k, parts = part or (0, plan.tables, 0, 1)
        masks, top = plan.ball() if ball else (None, None)
        size = max(1, (1 << 20) // (len(masks) * (last - first))) if ball else 1024
        for big in batches:
            for lo in range(0, big.num_rows, size):
                b = big.slice(lo, size)
                fp = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                key = plan.keys(fp)[:, first:last]
                row = np.repeat(np.arange(b.num_rows), key.shape[1])
                key = key.ravel()
                if ball:
                    at, m = np.nonzero(key[:, None] & top == 0)
                    row, key = row[at], key[at] ^ masks[m]
                if parts > 1:
                    at = np.flatnonzero(_mixed(key) % np.uint64(parts) == k)
                    row, key = row[at], key[at]
                if bc is not None:
                    at = bc.value.passing(_mixed(key))
                    row, key = row[at], key[at]
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(key).view(np.int64))], ["e"])
                    continue
                sketch = np.ascontiguousarray(fp[:, -8:]).view(np.int64).ravel()
                taken = [b.column(i).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *taken, pa.array(sketch[row])], ["k", "cls", "c", "sk"])
        tidy()

    return nodes.select("cls", "c", "fp").mapInArrow(run, "e long" if hashes else ENTRY_SCHEMA)


def _within(pairs: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """(a, ha, b, hb, far) of the pairs of classes (x, y) whose whole fingerprints are within the distance; far: it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("fa", "fb"))
                far = np.bitwise_count(one ^ two).sum(1, dtype=np.int32)
                yield b.select(PAIR).append_column("far", pa.array(far)).filter(pa.array(far <= radius))
        tidy()

    fa = nodes.select(F.col("cls").alias("x"), F.col("node").alias("a"), F.col("h").alias("ha"), F.col("fp").alias("fa"))
    fb = nodes.select(F.col("cls").alias("y"), F.col("node").alias("b"), F.col("h").alias("hb"), F.col("fp").alias("fb"))
    both = pairs.distinct().join(fa.hint("merge"), "x").join(fb.hint("merge"), "y")
    return both.select(*PAIR, "fa", "fb").mapInArrow(run, PAIR_SCHEMA + ", far int")


def _alike(plan: Plan):
    """The sketches of rows x and y are within the distance of sketches."""
    return F.bit_count(F.col("x.sk").bitwiseXOR(F.col("y.sk"))) <= plan.sketch


def _shared(nodes: DataFrame, plan: Plan, held: EntryFilter, low: DataFrame) -> DataFrame:
    """(k, cls, c, sk, low): own segments in entries of two classes or more; most others do not leave their task."""
    return _expanded(nodes, plan, held).join(low.hint("merge"), "k")


def _stars(shared: DataFrame, plan: Plan) -> DataFrame:
    """(x, y): the first class of each entry and every other."""
    return shared.where(F.col("cls") != F.col("low.cls")).where(F.bit_count(F.col("sk").bitwiseXOR(F.col("low.sk"))) <= plan.sketch).select(F.col("low.cls").alias("x"), F.col("cls").alias("y"))


def _leads(probes: DataFrame, plan: Plan, held: EntryFilter, low: DataFrame) -> DataFrame:
    """(x, y): of the first classes of entries that a class y probes, one entry a table, the smallest and the one with the nearest sketch.

    The entry of a table is that with the smallest hash, so that classes which probe the
    same ones take the same. Pairs that this leaves out are met later.
    """
    bc = probes.sparkSession.sparkContext.broadcast(held)  # 16 MB, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
            mixed = _mixed(k)
            at = bc.value.passing(mixed)
            at = at[np.lexsort((mixed[at], k[at] >> WIDEST, cls[at]))]
            own, tab = cls[at], k[at] >> WIDEST
            first = np.ones(len(at), bool)
            first[1:] = (own[1:] != own[:-1]) | (tab[1:] != tab[:-1])
            yield b.take(pa.array(at[first]))
        tidy()

    few = probes.select("k", "cls", "sk").mapInArrow(run, "k long, cls long, sk long")
    far = F.bit_count(F.col("sk").bitwiseXOR(F.col("low.sk")))
    met = few.join(low.hint("merge"), "k").where(F.col("cls") != F.col("low.cls")).where(far <= plan.sketch)
    lead = met.groupBy("cls").agg(F.min("low.cls").alias("least"), F.min(F.struct(far.alias("far"), "low.cls")).alias("nearest"))
    return lead.select(F.explode(F.array("least", "nearest.cls")).alias("x"), F.col("cls").alias("y"))


def _probed(nodes: DataFrame, plan: Plan, n: int, scratch: Scratch) -> DataFrame:
    """(k, cls, c, sk): probes of entries that may exist, each round written out."""
    out = []
    for part in plan.rounds(n):
        seen = EntryFilter.of_hashes(_expanded(nodes, plan, part=part, hashes=True))
        out.append(scratch.keep(_expanded(nodes, plan, seen, part, ball=True), "probes"))
    return reduce(DataFrame.union, out)


def _met(nodes: DataFrame, shared: DataFrame, probes: DataFrame, plan: Plan) -> DataFrame:
    """(x, y): classes of different groups that meet in an entry or by a probe, with sketches within the distance."""
    entry = shared.groupBy("k").agg(F.min("c").alias("pc"), F.max("c").alias("to"))
    whole = entry.where("pc = to").select("k", "pc")  # all of the entry is one group
    apart = F.col("x.c") != F.col("y.c")
    mixed = shared.join(entry.where("pc <> to").select("k").hint("merge"), "k")
    inside = mixed.alias("x").join(mixed.alias("y").hint("merge"), F.col("x.k") == F.col("y.k")).where(F.col("x.cls") < F.col("y.cls")).where(apart).where(_alike(plan))
    asking = probes.join(whole.hint("merge"), "k", "left").where("pc is null or pc <> c").drop("pc")
    found = asking.alias("x").join(_expanded(nodes, plan).alias("y").hint("merge"), F.col("x.k") == F.col("y.k")).where(apart).where(_alike(plan))
    pair = [F.least("x.cls", "y.cls").alias("x"), F.greatest("x.cls", "y.cls").alias("y")]
    return inside.select(*pair).union(found.select(*pair))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, h, words): the shingle hashes of the wanted classes, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_within(batches, _BATCH, 1):
            sets = [shingle_set(t, shingle) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), _half([_set_id(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "h", "words"])

    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(wanted.select("node").distinct(), "node", "left_semi")
    return own.mapInArrow(run, "node long, h long, words array<long>").join(wanted, ["node", "h"], "left_semi").dropDuplicates(["node", "h"])


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], scratch: Scratch, jaccard: float) -> DataFrame:
    """(a, b) of the pairs (a, ha, b, hb) whose shingle sets are similar enough."""
    pairs = scratch.keep(pairs.where("a <> b or ha <> hb").distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("node"), F.col("ha").alias("h")).union(pairs.select("b", "hb")).distinct()
    sets = texts(wanted)  # one exchange by class, which both joins read
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("words").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    similar = both >= F.lit(jaccard) * (F.size("wa") + F.size("wb") - both)
    return scratch.keep(pairs.join(left, ["a", "ha"]).join(right, ["b", "hb"]).where(similar).select("a", "b"), "links")


def _intersections(words: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) sizes of the intersections of sets of different hashes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    _, token, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(words)), sizes)
    often = times > 1  # the others are in no intersection
    token, row = (np.cumsum(often) - 1)[token][often[token]], row[often[token]]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2^24
    for lo in range(0, int(often.sum()), _COLUMNS):
        a, b = np.searchsorted(token, (lo, lo + _COLUMNS))
        held = np.zeros((len(words), _COLUMNS), np.float32)
        held[row[a:b], token[a:b] - lo] = 1
        out += held[left] @ held[right].T
    return out.astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is linked with by the pairs (a, b), over any number of links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def tile_links(words: list[np.ndarray], left: np.ndarray, right: np.ndarray, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same sets as all pairs of ``left`` and ``right`` that are similar enough, one a set at most."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    both = _intersections(words, left, right)
    i, j = np.nonzero(both >= jaccard * (sizes[left][:, None] + sizes[right] - both))
    low = _forest(len(words), left[i], right[j])
    at = np.flatnonzero(low < np.arange(len(words)))
    return at, low[at]


def _cell_links(grouped: DataFrame, texts: Callable[[DataFrame], DataFrame], scratch: Scratch, jaccard: float) -> DataFrame:
    """(a, b): links that join what all similar pairs inside a cell do; cells of one group have them already. grouped: (c, group, node, h)."""
    mixed = grouped.groupBy("c").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("c")
    wanted = scratch.keep(grouped.select("node", "h", "c").join(mixed, "c"), "inside")
    sets = scratch.keep(texts(wanted.select("node", "h")).join(wanted, ["node", "h"]), "cells")
    size = sets.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.size("words").cast("long")).alias("m"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_TEXTS), F.least(F.lit(BLOCKS), F.ceil(F.col("n") / SPREAD))).cast("int")
    dealt = sets.join(size.select("c", blocks.alias("blocks")), "c").withColumn("own", F.pmod(F.hash("node", "h"), F.col("blocks")))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("c", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "words")

    def run(t: pa.Table) -> pa.Table:
        own, node = t.column("own").to_numpy(), t.column("node").to_numpy()
        words = [w.values.to_numpy() for w in t.column("words")]
        a, b = tile_links(words, np.flatnonzero(own == t.column("one")[0].as_py()), np.flatnonzero(own == t.column("two")[0].as_py()), jaccard)
        out = pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})
        tidy()
        return out

    return scratch.keep(tiles.groupBy("c", "one", "two").applyInArrow(run, "a long, b long"), "inside-links")


def near_copies(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, jaccard: float = JACCARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    plan = Plan(docs.count(), jaccard)
    rows = scratch.keep(set_fingerprints(docs, plan, shingle, id_col, text_col), "fingerprints")
    classes = rows.where("doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("h").alias("h"), F.first("fp").alias("fp"))
    classes = scratch.keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    nodes = classes.where("fp is not null").select("cls", F.col("cls").alias("c"), "node", "h", "fp")

    def texts(wanted: DataFrame) -> DataFrame:
        return _sets(docs, wanted, shingle, id_col, text_col)

    low = _expanded(nodes, plan).groupBy("k").agg(F.min(F.struct("cls", "sk")).alias("low"), F.count("*").alias("n")).where("n > 1").select("k", "low")
    low = scratch.keep(low, "low")
    held = EntryFilter.of(low.select("k"))
    probes = _probed(nodes, plan, nodes.count(), scratch)
    stars = _stars(_shared(nodes, plan, held, low), plan).union(_leads(probes, plan, held, low))
    close = scratch.keep(_within(stars, nodes, plan.reach), "close")
    first = _verified(close.where(F.col("far") <= plan.radius).select(*PAIR), texts, scratch, jaccard)
    known = connected_components(first, scratch).withColumnRenamed("component", "group")
    cells = connected_components(close.select("a", "b"), scratch).withColumnRenamed("component", "cell")
    grouped = nodes.join(known, "node", "left").join(cells, "node", "left")
    grouped = scratch.keep(grouped.select("cls", F.coalesce("cell", "node").alias("c"), F.coalesce("group", "node").alias("group"), "node", "h", "fp"), "grouped")
    inside = _cell_links(grouped, texts, scratch, jaccard)
    probes = probes.drop("c").join(grouped.select("cls", "c"), "cls").select("k", "cls", "c", "sk")
    shared = scratch.keep(_shared(grouped, plan, held, low).select("k", "cls", "c", "sk"), "shared")
    more = _verified(_within(_met(grouped, shared, probes, plan), grouped, plan.radius).select(*PAIR), texts, scratch, jaccard)
    groups = connected_components(first.union(inside).union(more), scratch)
    label = scratch.keep(classes.join(groups, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id")), "labels")
    out = rows.select("doc_id", "set_id").join(label, "set_id", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows without an id stay."""
    d = near_copies(docs, scratch, shingle, jaccard)
    gone = scratch.keep(d.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
