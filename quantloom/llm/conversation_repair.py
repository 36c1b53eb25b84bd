"""Structure repair of conversations by error-correcting parsing of their roles.

Each row's first fault counts: blank text, a repetition of an earlier row of the same
conversation (role and text), or a text that does not end a sentence. Repairs keep,
rerole, delete or insert turns so that an optional system turn is followed by pairs of
user and assistant; the chart of :mod:`role_chart` gives the cheapest one.

Conversations of at most ``MOST_ROWS`` rows and ``MOST_BYTES`` bytes are parsed whole,
each in one group of a stream of sorted rows. Longer ones are never gathered: their
repetitions are found by an aggregation over digests, their rows are dealt by ranges of
turns and cut into segments, every segment is parsed from every state that the one before
may end in, and the segments' charts are joined from left to right. What is sequential by
definition, the audit's letters and the digest of the repaired text, is read in order,
segment by segment.

Defined cases: a null role, text, turn or conv_id reads as one space, but a null turn
comes before all others and does not count for gaps; rows of one turn are ordered by role
and text; repeated rows are rows; a role that is empty has to be reroled or deleted; a
conversation whose rows are all dropped has zeros, an empty audit and the digest of the
empty string; rows without a conv_id are one conversation; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions_for
from .role_chart import STATES, chart, cheapest, replay

MOST_ROWS, MOST_BYTES = 4096, 4 << 20
#: Rows and bytes of a segment of a longer conversation.
SEGMENT_ROWS, SEGMENT_BYTES = 2048, 2 << 20
_BLANK = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): every row, changed by the hash of its place; copies 0 is a dropped one."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    return convs.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: ``b``, ``d``, ``t`` or none."""
    shown = text.strip(_BLANK)
    if not shown:
        return "b"
    return "d" if seen else ("" if shown[-1] in ".!?" else "t")


def symbol(role: str, fault: str) -> str:
    if fault in ("b", "d"):
        return "-"
    s = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return s.upper() if fault else s


class _Tally:
    """Counts over the rows of one conversation, in order."""

    def __init__(self):
        self.n = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = self.turn = None

    def add(self, turn: int | None, role: str, fault: str, copies: int = 1) -> None:
        self.n[fault] += copies
        initial = role[:1]
        if self.last is not None and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.turn, self.high = turn if self.low is None else self.low, turn, turn

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def repair_rows(rows: list[tuple[int | None, str, str, int]]) -> tuple[_Tally, int, str, list[tuple[str, str]]]:
    """(counts, cost, audit, repaired turns) of the ordered rows (turn, role, text, copies) of one conversation."""
    tally, seen, symbols, roles, texts = _Tally(), set(), [], [], []
    for turn, role, text, copies in rows:
        for _ in range(copies):
            f = fault(text, (role, text) in seen)
            seen.add((role, text))
            tally.add(turn, role, f)
            symbols.append(symbol(role, f))
            roles.append(role)
            texts.append(text)
    cost, audit = cheapest("".join(symbols))
    return tally, cost, audit, replay(audit, roles, texts)


def _joined(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")


def _grouped(batches, cols: int) -> Iterator[tuple]:
    """Rows of sorted record batches as tuples."""
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(cols)), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_I, _T = pa.int64(), pa.string()
_TURNS = pa.list_(pa.struct([("role", _T), ("text", _T)]))
_WHOLE = pa.schema([("conv_id", _I), *[(c, _I) for c in _COUNTS], ("audit", _T), ("turns", _TURNS), ("sha", _T)])


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """Repairs of conversations of bounded size, whose rows follow one another."""

    def result(conv_id, rows):
        t, cost, audit, turns = repair_rows(rows)
        return conv_id, t.gaps, t.n["b"], t.n["d"], t.n["t"], t.illegal, cost, audit, [{"role": r, "text": x} for r, x in turns], hashlib.sha256(_joined(turns)).hexdigest()

    def repaired():
        now, rows = None, []
        for conv_id, *row in _grouped(batches, 5):
            if rows and conv_id != now:
                yield result(now, rows)
                rows = []
            now = conv_id
            rows.append(row)
        if rows:
            yield result(now, rows)

    return _batches(repaired(), _WHOLE, 64)


_SEGMENT = pa.schema(
    [("conv_id", _I), ("part", pa.int32()), ("seg", pa.int32()), ("roles", pa.list_(_T)), ("texts", pa.list_(_T)), ("exits", pa.list_(_T)), ("costs", pa.list_(_I)), ("audits", pa.list_(_T))]
    + [(c, _I) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")]
    + [("first", _T), ("last", _T)]
)
_SEGMENT_DDL = "conv_id long, part int, seg int, roles array<string>, texts array<string>, exits array<string>, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first string, last string"


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows (conv_id, turn, role, text, copies, seen): a chart from every state, and counts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def segment(conv_id, seg, tally, symbols, roles, texts):
        charts = {a: chart("".join(symbols), a) for a in STATES}
        pairs = [(a + b, *charts[a][b]) for a in STATES for b in STATES if b in charts[a]]
        exits, costs, audits = map(list, zip(*pairs, strict=True))
        n = tally.n
        return conv_id, part, seg, roles, texts, exits, costs, audits, n["b"], n["d"], n["t"], tally.illegal, tally.low, tally.high, tally.turns, tally.first, tally.last

    def cut():
        now, seg, tally, symbols, roles, texts, size, turn = None, 0, _Tally(), [], [], [], 0, None
        for conv_id, t, role, text, copies, seen in _grouped(batches, 6):
            if symbols and (conv_id != now or len(symbols) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                yield segment(now, seg, tally, symbols, roles, texts)
                seg, turn = seg + 1, (tally.turn if conv_id == now else None)
                tally, symbols, roles, texts, size = _Tally(), [], [], [], 0
                tally.turn = turn
            now = conv_id
            f = fault(text, seen)
            again = fault(text, True)
            tally.add(t, role, f)
            if copies > 1:
                tally.add(t, role, again, copies - 1)
            symbols += [symbol(role, f), *["-"] * (copies - 1)]
            roles += [role, *[""] * (copies - 1)]
            texts += [text if f not in ("b", "d") else "", *[""] * (copies - 1)]
            size += len(text)
        if symbols:
            yield segment(now, seg, tally, symbols, roles, texts)

    return _batches(cut(), _SEGMENT, 1)


_CHOSEN = pa.schema([("conv_id", _I), ("part", pa.int32()), ("seg", pa.int32()), ("entry", _T), ("piece", _T), *[(c, _I) for c in _COUNTS]])
_CHOSEN_DDL = "conv_id long, part int, seg int, entry string, piece string, " + ", ".join(f"{c} long" for c in _COUNTS)


def join_charts(charts: list[dict[str, tuple[int, str]]]) -> tuple[int, list[tuple[str, str]]]:
    """(cost, [(entry, audit) of each segment]) of the cheapest way through the segments' charts, keyed by entry and exit."""
    best, came = {"E": (0, "")}, []
    for c in charts:
        nxt: dict[str, tuple[int, str]] = {}
        back: dict[str, str] = {}
        for a, (cost, audit) in best.items():
            for b in STATES:
                if a + b in c:
                    v = (cost + c[a + b][0], audit + c[a + b][1])
                    if b not in nxt or v < nxt[b]:
                        nxt[b], back[b] = v, a
        best = nxt
        came.append(back)
    end = min((s for s in "EW" if s in best), key=best.__getitem__)
    cost, path = best[end][0], []
    for c, back in zip(reversed(charts), reversed(came), strict=True):
        a = back[end]
        path.append((a, c[a + end][1]))
        end = a
    return cost, path[::-1]


def _paths(batches) -> Iterator[pa.RecordBatch]:
    """The chosen entry state and edits of every segment; the counts stand at a conversation's first."""

    def of(conv_id, segs):
        cost, path = join_charts([dict(zip(s[2], zip(s[3], s[4], strict=True), strict=True)) for s in segs])
        known = [(s[9], s[10]) for s in segs if s[9] is not None]
        gaps = known[-1][1] - known[0][0] + 1 - sum(s[11] for s in segs) if known else 0
        illegal = sum(s[8] for s in segs) + sum(a[13] + b[12] not in _LEGAL for a, b in zip(segs[:-1], segs[1:], strict=True))
        totals = (gaps, *(sum(s[k] for s in segs) for k in (5, 6, 7)), illegal, cost)
        for i, (s, (entry, piece)) in enumerate(zip(segs, path, strict=True)):
            yield (conv_id, s[0], s[1], entry, piece, *(totals if i == 0 else (0,) * 6))

    def chosen():
        now, segs = None, []
        for conv_id, *s in _grouped(batches, 15):
            if segs and conv_id != now:
                yield from of(now, segs)
                segs = []
            now = conv_id
            segs.append(s)
        if segs:
            yield from of(now, segs)

    return _batches(chosen(), _CHOSEN)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its segments in order; texts pass one segment at a time."""

    def repaired():
        now, h, pieces, counts, some = None, None, [], None, False
        for conv_id, roles, texts, entry, piece, *totals in _grouped(batches, 5 + len(_COUNTS)):
            if h is None or conv_id != now:
                if h is not None:
                    yield (now, *counts, "".join(pieces), None, h.hexdigest())
                now, h, pieces, counts, some = conv_id, hashlib.sha256(), [], totals, False
            turns = replay(piece, roles, texts, entry)
            if turns:
                h.update((b"\n" if some else b"") + _joined(turns))
                some = True
            pieces.append(piece)
        if h is not None:
            yield (now, *counts, "".join(pieces), None, h.hexdigest())

    return _batches(repaired(), _WHOLE, 1)


_WHOLE_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, turns array<struct<role:string,text:string>>, sha string"


def _long_ones(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Repairs of conversations of any length; ``turns`` is null."""
    rows = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("place").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    rows = rows.join(first, same).select("conv_id", "turn", "role", "text", "copies", (~F.col("place").eqNullSafe(F.col("first"))).alias("seen"))
    n = partitions_for(rows, 32 << 20)
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    segs = scratch.keep(dealt.mapInArrow(_segments, _SEGMENT_DDL), "segments")
    order = [F.asc_nulls_first(c) for c in ("conv_id", "part", "seg")]
    slim = segs.drop("roles", "texts").repartition("conv_id").sortWithinPartitions(*order)
    chosen = scratch.keep(slim.mapInArrow(_paths, _CHOSEN_DDL), "paths")
    both = segs.select("conv_id", "part", "seg", "roles", "texts").join(chosen.drop("conv_id"), ["part", "seg"])  # together they name a segment
    both = both.select("conv_id", "part", "seg", "roles", "texts", "entry", "piece", *_COUNTS)
    return both.repartition("conv_id").sortWithinPartitions(*order).drop("part", "seg").mapInArrow(_digests, _WHOLE_DDL)


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, counts, cost, audit, turns, sha) of every conversation of (conv_id, turn, role, text, copies).

    ``turns`` are the repaired ones, null for a conversation over the bounds, whose digest and
    audit are exact all the same.
    """
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    long_ids = scratch.keep(sizes.where((F.col("n") > MOST_ROWS) | (F.col("size") > MOST_BYTES)).select(F.col("conv_id").alias("id")), "long")
    some = bool(long_ids.take(1))
    match = F.col("conv_id").eqNullSafe(F.col("id"))
    short = rows.join(long_ids, match, "left_anti") if some else rows
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    out = short.mapInArrow(_whole, _WHOLE_DDL)
    if not some:
        return out
    dealt = rows.join(long_ids, match, "left_semi")
    found = _long_ones(dealt, scratch)
    dropped = dealt.groupBy("conv_id").agg(F.sum("copies").alias("n")).where("n = 0")  # over the bounds, but nothing of it left
    empty = dropped.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit("").alias("audit"), F.lit(None).cast("array<struct<role:string,text:string>>").alias("turns"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha"))
    return out.unionByName(found).unionByName(empty)


def repair_digest(convs: DataFrame, scratch: Scratch) -> DataFrame:
    d = repair(damaged(convs), scratch)
    return d.select("conv_id", *_COUNTS, "audit", F.col("sha").alias("repaired_sha256"))
