"""Line dedup by content-defined chunks of lines, and by the runs that their borders cut.

By chunks, a rolling hash over the hashes of ``WINDOW`` neighbouring lines ends a chunk where it
leaves no remainder, so an inserted or missing line moves only the borders next to it.
A chunk of at least two lines with visible characters that occurs more than once in all
documents is kept at its first place (smallest document id, then place in it) and
removed elsewhere, after its bytes were compared with those at the first place.

By runs (``runs=True``; the query and the pipeline), the chunks are followed by what their
borders miss: a repeated run begins and ends inside chunks, and a short one has no border
at all. Each two neighbouring visible lines, with the blank lines between them, that do not
lie in one removed chunk are a pair, and a pair that stands at an earlier place of any
document is removed after its bytes were compared with those at its first place. Pairs
overlap, so removed chunks grow line by line to both sides, and a repeated run of two or more
visible lines goes from its first to its last visible line wherever it begins. A line's first
place always stays: the first place of a pair lies in no removed chunk, since that chunk has
an earlier place itself. A document left without a visible line becomes empty. A line that
repeats by itself, between other neighbours, stays. Blank lines at the ends of a removed chunk
stay too.

Only hashes are shuffled to find repeats. A second reading of the texts sends the bytes
of units (chunks or pairs) whose hash may be repeated (a filter of fixed size decides),
and those meet the bytes of the first place. A unit that very many documents share is a single row on
one side of that join, and the other side is split by adaptive execution.

Defined cases: null text stays null; rows without an id are never judged; rows that share
an id count as one document, a unit at the same place of them as one, and a row loses only
units that it has itself; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import HashFilter, Scratch, as_bytes, rows_within

#: Lines under the rolling hash, and one border in so many lines on average.
WINDOW = 2
MEAN_LINES = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, bytes) of every chunk; together they are the text."""
    lines = text.split(b"\n")
    n = len(lines)
    if n == 1:
        return [(0, 1, text)]
    h = np.array([xxh3_64_intdigest(x) for x in lines], np.uint64)
    roll = h.copy()
    for k in range(1, WINDOW):
        roll[k:] = roll[k:] * np.uint64(31) + h[:-k]
    border = np.flatnonzero((roll * _MIX) >> np.uint64(40) < np.uint64((1 << 24) // MEAN_LINES)) + 1
    cut = [0, *border[border < n].tolist(), n]
    return [(a, b, b"\n".join(lines[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def visible(lines: list[bytes]) -> list[int]:
    return [k for k, x in enumerate(lines) if x.strip()]


def spans(text: bytes, cut: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Line ranges of the chunks named by (place, hash)."""
    return [(lo, hi) for k, (lo, hi, c) in enumerate(chunks(text)) if (_chunk_place(k), _hash(c)) in cut] if cut else []


def pairs(text: bytes, removed: list[tuple[int, int]] = ()) -> list[tuple[int, bytes]]:
    """(first line, bytes) of each two neighbouring visible lines, with the blank lines between, that no removed range holds."""
    lines = text.split(b"\n")
    at = visible(lines)
    held = np.zeros(len(lines), np.int64)
    for n, (lo, hi) in enumerate(removed, 1):
        held[lo:hi] = n
    return [(a, b"\n".join(lines[a : b + 1])) for a, b in zip(at[:-1], at[1:], strict=True) if not held[a] or held[a] != held[b]]


def without_runs(text: bytes, cut: set[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the number of runs and of lines removed; ``cut`` has (place, hash) of chunks and pairs."""
    lines = text.split(b"\n")
    at = np.array(visible(lines), np.int64)
    gone = np.zeros(len(lines) + 1, bool)
    first_lines = {no for no, _ in cut if no >= 0}
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if a in first_lines and (a, _hash(b"\n".join(lines[a : b + 1]))) in cut:
            gone[a : b + 1] = True
    for lo, hi in spans(text, cut):
        own = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
        gone[own[0] : own[-1] + 1] = True
    n_runs = int(np.count_nonzero(gone[:-1] & ~gone[1:]))
    if n_runs and gone[at].all():
        return b"", n_runs, len(lines)
    return b"\n".join(x for x, g in zip(lines, gone[:-1].tolist(), strict=True) if not g), n_runs, int(gone.sum())


def without_chunks(text: bytes, cut: set[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The same for chunks alone, with the blank lines at their ends."""
    kept, n, lost = [], 0, 0
    for k, (lo, hi, raw) in enumerate(chunks(text)):
        if (_chunk_place(k), _hash(raw)) in cut:
            n, lost = n + 1, lost + hi - lo
        else:
            kept.append(raw)
    return b"\n".join(kept), n, lost


def _chunk_place(k: int) -> int:
    """Chunks of a document are numbered below zero, in falling order, and pairs by their first line."""
    return -1 - k


def _judged(lo: int, hi: int, raw: bytes) -> bool:
    return hi - lo > 1 and sum(1 for x in raw.split(b"\n") if x.strip()) > 1


def _hash(raw: bytes) -> int:
    h = xxh3_64_intdigest(raw)
    return h - (1 << 64) if h >> 63 else h


def _units(text: bytes, removed: set[tuple[int, int]] | None) -> list[tuple[int, bytes]]:
    """(place, bytes) of what is compared: chunks, or once chunks were removed the pairs."""
    if removed is None:
        return [(_chunk_place(k), c) for k, (lo, hi, c) in enumerate(chunks(text)) if _judged(lo, hi, c)]
    return pairs(text, spans(text, removed))


def _cut_set(cut: list[dict] | None) -> set[tuple[int, int]]:
    return {(c["no"], c["h"]) for c in cut or ()}


def _placed(h, doc, no):
    """A long for a hash at a place, in numpy or in Spark: only a filter reads it."""
    if isinstance(h, np.ndarray):
        return h ^ (doc << 37) ^ (no << 50)
    return h.bitwiseXOR(F.shiftleft(doc, 37)).bitwiseXOR(F.shiftleft(no.cast("long"), 50))


def _occurrences(docs: DataFrame, after_chunks: bool, only: HashFilter | None = None, firsts: HashFilter | None = None, unless: HashFilter | None = None) -> DataFrame:
    """(h, doc_id, no) of the units of (doc_id, text[, removed chunks]); with filters, of those that pass ``only``, their bytes and whether they may be a first place.

    Documents in ``unless`` are left out.
    """
    bc = docs.sparkSession.sparkContext.broadcast((only, firsts, unless))  # fixed size
    docs = docs.withColumn("__k", F.xxhash64("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, firsts, unless = bc.value
        for b in rows_within(batches, 2 << 20, 1):
            h, doc, no, raw = [], [], [], []
            if unless is not None:
                b = b.filter(pa.array(~unless.has(b.column(b.num_columns - 1).to_numpy())))
            removed = [None] * b.num_rows
            if after_chunks:
                removed = map(_cut_set, b.column(2).to_pylist()) if b.num_columns > 3 else [set()] * b.num_rows
            for d, t, cut in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), removed, strict=True):
                for k, c in _units(t, cut) if d is not None else ():
                    h.append(_hash(c))
                    doc.append(d)
                    no.append(k)
                    raw.append(c)
            cols = [pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(no, pa.int32())]
            names = ["h", "doc_id", "no"]
            if only is None:
                yield pa.RecordBatch.from_arrays(cols, names)
            elif h:
                at = np.array(h, np.int64)
                first = firsts.has(_placed(at, np.array(doc, np.int64), np.array(no, np.int64)))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(raw, pa.binary()), pa.array(first)], [*names, "raw", "may_be_first"]).filter(pa.array(only.has(at)))

    return docs.mapInArrow(run, "h long, doc_id long, no int" + ("" if only is None else ", raw binary, may_be_first boolean"))


def _repeats(occurrences: Callable[..., DataFrame], scratch: Scratch) -> DataFrame:
    """(doc_id, cut: place and hash of the units to remove) of the documents that lose any.

    ``occurrences(only, firsts)`` are the units, as ``_occurrences`` gives them.
    """
    # places of chunks fall, so their order in a document is that of the numbers turned round
    rank = F.when(F.col("no") < 0, -1 - F.col("no")).otherwise(F.col("no"))
    place = F.struct("doc_id", rank.alias("rank"))
    repeated = occurrences(None, None).groupBy("h").agg(F.min(F.struct("doc_id", rank.alias("rank"), "no")).alias("first"), F.max(place).alias("last"))
    repeated = scratch.keep(repeated.where("first.doc_id <> last.doc_id or first.rank <> last.rank").select("h", "first"), "repeated")
    firsts = repeated.select(_placed(F.col("h"), F.col("first.doc_id"), F.col("first.no")).alias("p"))
    found = scratch.keep(occurrences(HashFilter.of(repeated, "h"), HashFilter.of(firsts, "p")), "found")
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("no") == F.col("first.no"))
    # both sides of each join grow with the input, so none is broadcast
    judged = scratch.keep(found.where("may_be_first").join(repeated.hint("merge"), "h").select("h", "doc_id", "no", "raw", is_first.alias("is_first")), "judged")
    first = judged.where("is_first").groupBy("h").agg(F.first("raw").alias("kept"))
    others = found.where("not may_be_first").drop("may_be_first").union(judged.where("not is_first").drop("is_first"))
    gone = others.join(first.hint("merge"), "h").where(F.col("raw") == F.col("kept"))
    # the places of one document: never more than it has units
    cuts = scratch.keep(gone.groupBy("doc_id").agg(F.collect_set(F.struct("no", "h")).alias("cut")), "cuts")
    for t in (repeated, found, judged):
        scratch.drop(t)
    return cuts


def removals(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(doc_id, cut: place and hash of the chunks, and by runs of the pairs, to remove) of the documents that lose any."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by_chunk = _repeats(lambda only, firsts: _occurrences(plain, False, only, firsts), scratch)
    if not runs:
        return by_chunk
    # only the texts that may lose chunks meet their cuts; the others are read where they lie
    held = _ids(by_chunk)
    hit = scratch.keep(_passing(plain, "doc_id", held, True).join(by_chunk.hint("merge"), "doc_id", "left"), "cut-by-chunk")
    by_pair = _repeats(lambda only, firsts: _occurrences(hit, True, only, firsts).union(_occurrences(plain, True, only, firsts, held)), scratch)
    cuts = scratch.keep(by_chunk.union(by_pair).groupBy("doc_id").agg(F.flatten(F.collect_list("cut")).alias("cut")), "all-cuts")
    for t in (hit, by_chunk, by_pair):
        scratch.drop(t)
    return cuts


def _ids(cuts: DataFrame) -> HashFilter:
    return HashFilter.of(cuts.select(F.xxhash64("doc_id").alias("k")), "k")


def _cut_rows(df: DataFrame, text_at: int, schema: T.StructType, runs: bool) -> DataFrame:
    without = without_runs if runs else without_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_chunks_removed", pa.int64()), ("n_lines_removed", pa.int64())])
        for b in rows_within(batches, 2 << 20, text_at):
            out = []
            for t, cut in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if t is None:
                    out.append({"text": None, "n_lines": 0, "n_chunks_removed": 0, "n_lines_removed": 0})
                    continue
                n, n_cut, lost = t.count("\n") + 1, 0, 0
                if cut:
                    t, n_cut, lost = without(t.encode(), _cut_set(cut))
                    t = t.decode()
                out.append({"text": t, "n_lines": n, "n_chunks_removed": n_cut, "n_lines_removed": lost})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], names=[*b.schema.names[:-1], "lines"])

    return df.mapInArrow(run, schema)


def _passing(docs: DataFrame, id_col: str, held: HashFilter, wanted: bool) -> DataFrame:
    """The rows whose id may (or cannot) be held, so that only texts that may lose lines are shuffled."""
    bc = docs.sparkSession.sparkContext.broadcast(held)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(range(b.num_columns - 1)).filter(pa.array(bc.value.has(b.column(b.num_columns - 1).to_numpy()) == wanted))

    return docs.withColumn("__k", F.xxhash64(F.col(id_col).cast("long"))).mapInArrow(run, docs.schema)


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """All columns of ``docs`` as they are, and a struct column ``lines``: text, n_lines, n_chunks_removed (by runs: runs removed), n_lines_removed."""
    docs = docs.drop("lines")  # a column of that name is replaced
    schema = T.StructType([*docs.schema.fields, T.StructField("lines", T.StructType.fromDDL("text string, n_lines long, n_chunks_removed long, n_lines_removed long"))])
    cuts = removals(docs, scratch, id_col, text_col, runs)
    held = _ids(cuts)
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("cut").alias("__cut"))
    hit = _passing(docs, id_col, held, True).join(cuts.hint("merge"), F.col(id_col) == F.col("__id"), "left").drop("__id")
    # texts that lose nothing are not sent to Python a second time
    text, none = F.col(text_col), F.lit(0).cast("long")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = F.struct(text.alias("text"), n_lines.alias("n_lines"), none.alias("n_chunks_removed"), none.alias("n_lines_removed"))
    other = _passing(docs, id_col, held, False).withColumn("lines", whole)
    return _cut_rows(hit, docs.columns.index(text_col), schema, runs).union(other)


def line_digest(docs: DataFrame, scratch: Scratch, runs: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines, n_chunks_removed, n_lines_removed, kept_sha256."""
    d = dedup_lines(docs.select("doc_id", "text"), scratch, runs=runs)
    return d.select("doc_id", "lines.n_lines", "lines.n_chunks_removed", "lines.n_lines_removed", F.sha2(F.coalesce("lines.text", F.lit("")), 256).alias("kept_sha256"))
