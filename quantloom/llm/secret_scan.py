"""Secrets by a trigram inverted index.

Each rule is a regular expression. Its parse tree gives a Boolean query of trigrams that
every match must hold (in lower case): literal runs are ANDs of their trigrams,
alternatives are ORs. The index has, for each trigram that a query names and each block
of document ids, the list of documents that hold it; a rule's candidates are
intersections and unions of these lists, block by block. Only candidates are read by the
rule itself, which decides. A rule without a mandatory trigram has no query and reads
every text.

All of it is DataFrame functions. A posting list holds at most 2^``BLOCK_BITS`` ids, so no
source, document or frequent trigram is gathered whole. Places of matches are prefix sums
of the lengths between and of matches, taken in two levels, so a text with very many
matches costs no square.

Defined cases: a null text is empty and has no secrets; every row gives one row, rows
that share an id are judged by their own text; a row without an id is in no list and read
by every rule; an empty table gives no rows; other columns are not read. Places are code
points.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters; shorter ones are dropped after they are found."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Patterns of secrets, in the order of ties.
BASE = [
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
]
ADDED = [
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
]

#: Strings that one piece of a pattern may stand for before it counts as unknown.
MOST_STRINGS = 16
#: Ids of a block of posting lists.
BLOCK_BITS = 14
#: Matches whose places one fold adds up.
_CHUNK = 256

Query = str | tuple | None


def _both(a: Query, b: Query) -> Query:
    """AND of two queries; None holds for every text."""
    if a is None or b is None:
        return b if a is None else a
    return ("and", frozenset((a[1] if a[0] == "and" and isinstance(a, tuple) else {a}) | (b[1] if b[0] == "and" and isinstance(b, tuple) else {b})))


def _any(queries: list[Query]) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    distinct = frozenset(queries)
    return next(iter(distinct)) if len(distinct) == 1 else ("or", distinct)


def _of_strings(strings: frozenset[str] | None) -> Query:
    """A text that holds one of these strings holds all trigrams of that one."""
    if not strings:
        return None
    out: list[Query] = []
    for s in strings:
        q: Query = None
        for g in {s[i : i + 3] for i in range(len(s) - 2)}:
            q = _both(q, g)
        out.append(q)
    return _any(out)


def _read(items) -> tuple[frozenset[str] | None, Query]:
    """(all strings that a part of a pattern can be, or None; what any match of it needs)."""
    run: frozenset[str] | None = frozenset([""])
    needs: Query = None
    whole = True
    for op, arg in items:
        strings, query = _part(op, arg)
        joined = None if strings is None or run is None else frozenset(a + b for a in run for b in strings)
        if joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
            continue
        whole = False
        needs = _both(_both(needs, _of_strings(run)), query)
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else frozenset([""])
    return (run, None) if whole else (None, _both(needs, _of_strings(run)))


def _part(op, arg) -> tuple[frozenset[str] | None, Query]:
    if op is K.LITERAL:
        return frozenset([chr(arg).lower()]), None
    if op is K.IN:
        chars = [chr(v).lower() for o, v in arg if o is K.LITERAL]
        return (frozenset(chars), None) if len(chars) == len(arg) else (None, None)
    if op is K.SUBPATTERN:
        return _read(arg[3])
    if op is K.BRANCH:
        parts = [_read(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return frozenset().union(*(s for s, _ in parts)), None
        return None, _any([q if s is None else _of_strings(s) for s, q in parts])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, items = arg
        strings, query = _read(items)
        if strings is not None and high == 1:
            return strings | {""}, None
        if strings is not None and low == high and isinstance(low, int) and low <= 8:
            return (_read(list(items) * low) if low else (frozenset([""]), None))
        return None, (query if strings is None else _of_strings(strings)) if low else None
    return None, None


def trigram_query(pattern: str) -> Query:
    """A trigram, ("and" | "or", queries), or None where no trigram is mandatory."""
    strings, query = _read(list(_parser.parse(pattern)))
    return query if strings is None else _of_strings(strings)


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def trigram_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, gram, ids): the documents of each block of ids that hold a trigram, in lower case."""
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    p = low.select("id", F.explode_outer(held).alias("gram")).where("gram is not null")  # explode() would test every trigram once more, in a filter
    return p.groupBy(F.shiftright("id", BLOCK_BITS).alias("block"), "gram").agg(F.collect_set("id").alias("ids"))


def _evaluated(query: Query, lists: Column) -> Column:
    """The ids that satisfy a query, from a map of a block's posting lists; trigrams of one AND or OR are folded over."""
    none = F.array().cast("array<bigint>")
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), none)
    op = F.array_intersect if query[0] == "and" else F.array_union
    grams = sorted(q for q in query[1] if isinstance(q, str))
    parts = [_evaluated(q, lists) for q in sorted((q for q in query[1] if not isinstance(q, str)), key=str)]
    if grams:
        rest = F.array(*map(F.lit, grams[1:])).cast("array<string>")
        parts.append(F.aggregate(rest, _evaluated(grams[0], lists), lambda ids, g: op(ids, F.coalesce(F.try_element_at(lists, g), none))))
    out = parts[0]
    for p in parts[1:]:
        out = op(out, p)
    return out


def probe(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, kinds): the kinds whose query a document satisfies, for documents with any."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _evaluated(q, F.col("lists")).alias("ids")) for k, q in queries.items()]))
    found = blocks.select(each.alias("r")).select("r.kind", F.explode("r.ids").alias("id"))
    return found.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _running(lens: Column) -> Column:
    """Sums of the elements before each element and of all, by one fold."""
    return F.aggregate(lens, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def before_each(lens: Column) -> Column:
    """Sums of the elements before each element, folded in chunks and over the chunks' sums."""
    n = F.size(lens)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / _CHUNK).cast("int"), F.lit(0))), lambda c: F.slice(lens, c * _CHUNK + 1, _CHUNK))
    starts = _running(F.transform(cut, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))
    inside = F.zip_with(F.transform(cut, lambda c: F.slice(_running(c), 1, F.size(c))), starts, lambda own, start: F.transform(F.coalesce(own, F.array().cast("array<bigint>")), lambda v: v + start))
    return F.flatten(inside)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, kind, end) of a rule's matches."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))
    parts = F.arrays_zip(before_each(steps).alias("at"), F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), judged.alias("judged"))
    kept = F.filter(parts, lambda p: F.length(p["judged"]) >= rule.least)
    return F.transform(kept, lambda p: F.struct((p["at"] + p["gap"]).alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (p["at"] + p["gap"] + F.length(p["hit"])).alias("end")))


_SPANS = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: its secrets as (start, ord, kind, end), by start and then rule."""
    rules = rules or BASE + ADDED
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if queries:
        index = trigram_index(d, sorted(set().union(*map(trigrams, queries.values()))), "doc_id", "text")
        d = d.join(probe(index, queries).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    text, none = F.col("text"), F.array().cast(_SPANS)
    cols = []
    for k, r in enumerate(rules):
        read = (F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))) if r.kind in queries else F.lit(True)
        cols.append(F.when(read & text.rlike(r.pattern), spans_of(text, r, k)).otherwise(none))
    return d.select("doc_id", F.array_sort(F.concat(*cols)).cast(_SPANS).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""
    d = secret_spans(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return d.select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
