"""Benchmark decontamination with one FM-index per training shard.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. Every item
of the benchmark gives its windows of ``WINDOW`` consecutive words (a shorter item is one
window). A shard is a block of whole documents of one task, and all its words are indexed:
words of the benchmark by their ids, each run of words that no item has as one separator
(no window holds one, so none is found across it). The windows are backward searched
through wavelet-matrix ranks, located by sampled suffix positions, and the hit words of a
document are merged to removal spans.

The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words. Where it
has more than one, each is a pass over the documents that is written out before the next
block is sent, so one block is broadcast at a time, however large the benchmark.

Defined cases: null or wordless text has no words and is never contaminated; items
without words, text or id give no windows; rows that share an id are judged one by one;
empty tables give no rows or no hits; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, rows_within
from .fm_index import FmIndex

WINDOW = 10
BLOCK_WORDS = 200_000
SHARD_BYTES = 1 << 20
_WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte outside words into a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.items = [sorted(v) for v in found.values()]
        lengths: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for i, k in enumerate(found):
            lengths.setdefault(len(k), []).append((i, k))
        self.by_length = {n: (np.array([i for i, _ in v]), np.array([k for _, k in v], np.int64)) for n, v in sorted(lengths.items())}

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ids, length, window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(ids) or not self.by_length:
            return none, none, none
        # ids: 0 is an unknown word or the end of a document; a run of them becomes one separator
        keep = ids > 0
        keep[1:] |= ids[:-1] > 0
        keep[-1] = True
        origin = np.flatnonzero(keep)
        text = ids[origin]
        if text[-1]:
            text, origin = np.append(text, 0), np.append(origin, -1)
        fm = FmIndex(text, len(self.vocab))
        places, lengths, windows = [], [], []
        for n, (which, rows) in self.by_length.items():
            lo, hi = fm.search(rows)
            size = hi - lo
            if total := int(size.sum()):
                row = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(total)
                places.append(origin[fm.locate(row)])
                lengths.append(np.full(total, n))
                windows.append(np.repeat(which, size))
        return (np.concatenate(places), np.concatenate(lengths), np.concatenate(windows)) if places else (none, none, none)


def _spans(hit: np.ndarray) -> np.ndarray:
    """Half-open runs of true places, as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _cut(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the words of the spans and what stands between them."""
    place = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    out, at = [], 0
    for s, e in spans.tolist():
        out.append(text[at : place[s][0]])
        at = place[e - 1][1]
    return b"".join([*out, text[at:]])


def _shards(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in rows_within(batches, SHARD_BYTES, col):
        held.append(b)
        size += b.column(col).nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(win: Windows, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Words, hit words (as marks) and found items of each text."""
    get, ids, n = win.vocab.get, [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        own = np.array([get(w, 0) for w in words(t)], np.int64)
        n[k] = len(own)
        ids += [own, np.zeros(1, np.int64)]
    start = np.concatenate([[0], np.cumsum(n + 1)])
    place, length, window = win.occurrences(np.concatenate(ids) if ids else np.zeros(0, np.int64))
    marks = np.zeros(start[-1] + 1, np.int64)
    np.add.at(marks, place, 1)
    np.add.at(marks, place + length, -1)
    hit = np.cumsum(marks) > 0
    found: list[set[str]] = [set() for _ in texts]
    if len(place):
        pairs = np.unique(np.stack([np.searchsorted(start, place, "right") - 1, window]), axis=1)
        for d, w in pairs.T.tolist():
            found[d].update(win.items[w])
    return n, [hit[a:b] for a, b in zip(start[:-1], start[1:] - 1, strict=True)], found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Windows]:
    """The benchmark as bounded blocks; one is on the driver at a time."""
    held, size = [], 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    for r in rows.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        text = r["t"].encode()
        held.append((r["i"], text))
        size += len(text) // 4
        if size >= BLOCK_WORDS:
            yield Windows(held)
            held, size = [], 0
    if held:
        yield Windows(held)


def _marked(blocks: Iterator[Windows]) -> Iterator[tuple[Windows, bool]]:
    """Each block, and whether it is the last; an empty one where there is none."""
    own = next(blocks, None)
    if own is None:
        own = Windows([])
    for after in blocks:
        yield own, False
        own = after
    yield own, True


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and a struct column ``found``.

    found: n_words, n_hit, spans (merged, half-open, in words), items (sorted as strings)
    and, if ``cleaned``, the text without its spans. The row's columns pass through
    untouched whatever their names.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text_col, "found")]  # a column of that name is replaced
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(None).cast("int").alias("row"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    found = T.StructType.fromDDL("n_words long, n_hit long, spans array<struct<s:long,e:long>>, items array<string>, cleaned string")
    state = T.StructType([*kept.schema.fields])

    def search(bc, batches: Iterator[pa.RecordBatch]):
        """Shards with, per document, words, hit marks and items, joined with what earlier blocks found."""
        for t in _shards(batches, 1):
            texts = [x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()]
            n, hits, items = _search(bc.value, texts)
            for k, (old, had) in enumerate(zip(t.column("hit").to_pylist(), t.column("items").to_pylist(), strict=True)):
                if old:
                    hits[k] = hits[k] | np.frombuffer(old, bool)
                    items[k].update(had)
            yield t, texts, n, hits, items

    def middle(bc):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, _, n, hits, items in search(bc, batches):
                packed = [h.tobytes() if h.any() else None for h in hits]
                out = pa.Table.from_arrays([t.column("row"), t.column("text"), pa.array(n), pa.array(packed, pa.binary()), pa.array([sorted(i) if i else None for i in items], pa.list_(pa.string()))], schema=t.schema)
                yield from out.to_batches()

        return run

    def final(bc):
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string())), ("cleaned", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, texts, n, hits, items in search(bc, batches):
                valid = t.column("text").is_valid().to_pylist()
                rows = []
                for size, hit, found, text, there in zip(n.tolist(), hits, items, texts, valid, strict=True):
                    spans = _spans(hit)
                    own = (_cut(text, spans) if len(spans) else text).decode() if cleaned and there else None
                    rows.append({"n_words": size, "n_hit": int((spans[:, 1] - spans[:, 0]).sum()), "spans": [{"s": s, "e": e} for s, e in spans.tolist()], "items": sorted(found), "cleaned": own})
                yield from pa.Table.from_arrays([t.column("row"), pa.chunked_array([pa.array(rows, kind)])], ["row", "found"]).to_batches()

        return run

    for w, last in _marked(_blocks(benchmark, item_col, item_text_col)):
        bc = spark.sparkContext.broadcast(w)
        if last:
            out = kept.mapInArrow(final(bc), T.StructType([state["row"], T.StructField("found", found)]))
        else:
            scratch = scratch or Scratch(spark, "decontamination")
            before, kept = kept, scratch.keep(kept.mapInArrow(middle(bc), state), "block")
            scratch.drop(before)
            bc.unpersist()
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "found")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    d = decontaminate(docs.select("doc_id", "text"), benchmark)
    return d.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))

