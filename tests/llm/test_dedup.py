"""SimHash, suffix, line and embedding dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quantloom.llm import embedding_dedup, line_dedup, prefix_free, simhash, suffix_dedup
from quantloom.llm.components import connected_components


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w] if len(w) < 3 else zip(w, w[1:], w[2:], strict=False))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(near, ids):
    out = {}
    for i in range(len(ids)):
        if i not in out:
            seen, todo = {i}, [i]
            while todo:
                new = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
                seen |= new
                todo += new
            out |= dict.fromkeys(seen, min(ids[k] for k in seen))
    return [out[i] for i in range(len(ids))]


def test_components_of_paths_stars_and_loops(spark, scratch):
    edges = [(i, i + 1) for i in range(50, 90)] + [(7, k) for k in range(8, 40)] + [(5, 5), (100, 99), (99, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == dict.fromkeys(range(50, 91), 50) | dict.fromkeys(range(7, 40), 7) | {99: 99, 100: 99}
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_simhash_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_digest(spark, spark.createDataFrame(docs)).collect()}
    fp = np.array([plain_fingerprint(r.text) for r in docs], np.uint64)
    ids = [r.doc_id for r in docs]
    comp = plain_components(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3, ids)
    assert got == {i: (f"{int(f):016x}", c) for i, f, c in zip(ids, fp, comp, strict=True)}


def test_links_at_every_distance(spark):
    random.seed(1)
    fps = [random.getrandbits(64) for _ in range(20)]
    for f in list(fps):
        for d in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << b for b in random.sample(range(64), d)))
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame(list(enumerate(signed)), "node long, fp long")).collect()}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert got == {tuple(sorted(p)) for p in want}


def test_simhash_odd_rows(spark, odd_docs, no_docs, scratch):
    got = simhash.simhash_digest(spark, odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero == {3: 3, 4: 3, 5: 3}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.simhash_digest(spark, no_docs).count() == 0
    kept = simhash.keep_one(odd_docs, scratch).select("doc_id", "h").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10]


def check_suffix(spark, scratch, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.substring_digest(df, scratch).collect()}
    assert got == suffix_dedup.plain_removal({i: (t or "").encode() for i, t in rows})


def repetitive():
    random.seed(3)
    base = ["".join(random.choice("ab") for _ in range(200)) for _ in range(3)]
    out = []
    for i in range(25):
        t = ""
        for _ in range(random.randint(0, 4)):
            k, a = random.choice(base), random.randint(0, 150)
            t += k[a : a + random.randint(20, 150)] + random.choice(["", "é", "a" * random.randint(0, 99)])
        out.append((i, t))
    return [*out, (25, None), (26, ""), (27, "a" * 400), (28, "a" * 120), (29, "ab" * 100)]


def test_suffix_dedup(spark, scratch):
    check_suffix(spark, scratch, repetitive())


def test_corpus_order_equals_a_plain_suffix_sort():
    """Parses with one trigger string, of texts over few letters: dictionary and parse give the order of all suffixes."""
    random.seed(5)
    w, seen = 2, 0
    for alphabet in (b"ab", b"abc", bytes([0, 1, 255])):
        trigger = alphabet[:1] + alphabet[1:2]
        texts = [bytes(random.choice(alphabet) for _ in range(random.randint(1, 60))) for _ in range(12)]
        texts += texts[:4] + [trigger * 9, texts[0] + texts[1]]
        parsed = []
        for t in texts:
            cut = [m.start() for m in re.finditer(b"(?=" + re.escape(trigger) + b")", t) if m.start() > 0]
            parsed.append([t[a : b + w] for a, b in zip([0, *cut], [*cut, len(t)], strict=True)])
        d = prefix_free.Dictionary({p for ps in parsed for p in ps})
        seq = np.array([x for ps in parsed for x in [*(d.rank_of[p] + 1 for p in ps), 0]], np.int64)
        place, offset = prefix_free.Parse(d, seq, w).corpus_order()
        start, at, text_of = {}, 0, {}
        for i, ps in enumerate(parsed):
            pos = 0
            for p in ps:
                start[at], text_of[at] = pos, i
                pos, at = pos + len(p) - w, at + 1
            at += 1
        got = [texts[text_of[p]][start[p] + o :] for p, o in zip(place.tolist(), offset.tolist(), strict=True)]
        assert got == sorted(t[i:] for t in texts for i in range(len(t)))
        seen += len(got)
    assert seen > 1000


def test_shared_bytes_of_neighbours():
    """Through phrases, triggers and the parse: the bytes two suffixes have in common."""
    random.seed(6)
    w, texts = 2, []
    for _ in range(14):
        texts.append(b"".join(random.choice([b"xxab", b"yab", b"xyxab", b"ab"]) for _ in range(random.randint(1, 8))) + random.choice([b"", b"x", b"xy"]))
    parsed = []
    for t in texts:
        cut = [m.start() for m in re.finditer(b"ab", t) if m.start() > 0]
        parsed.append([t[a : b + w] for a, b in zip([0, *cut], [*cut, len(t)], strict=True)])
    d = prefix_free.Dictionary({p for ps in parsed for p in ps})
    rows, seq, at = [], [], 0
    for ps, t in zip(parsed, texts, strict=True):
        pos = 0
        for j, p in enumerate(ps):
            if j + 1 < len(ps):
                rows += [(d.rank_of[p], o, at + j + 1, t[pos + o :]) for o in range(len(p) - w + 1)]
            pos += len(p) - w
        seq += [*(d.rank_of[p] + 1 for p in ps), 0]
        at += len(ps) + 1
    order, shared = prefix_free.Parse(d, np.array(seq), w).combine(*(np.array([r[k] for r in rows]) for k in range(3)))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    checked = 0
    for n in range(1, len(order)):
        (p, o, _, s), (q, o2, _, s2) = rows[order[n - 1]], rows[order[n]]
        if d.phrases[p][o:] == d.phrases[q][o2:]:
            assert shared[n] == min(prefix_free.CAP, common(s, s2)), (s, s2)
            checked += 1
    assert checked > 50


def test_suffix_dedup_of_hot_triggers(spark, scratch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    check_suffix(spark, scratch, repetitive())


def test_suffix_dedup_when_packed_entries_agree(spark, scratch, monkeypatch):
    """Phrases whose packed hash bits are equal are found by the second pass."""
    monkeypatch.setattr(suffix_dedup, "_LOW", np.uint64(0))
    packed = suffix_dedup._packed
    monkeypatch.setattr(suffix_dedup, "_packed", packed)
    rows = repetitive()[:12]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.substring_digest(df, scratch).collect()}
    assert got == suffix_dedup.plain_removal({i: t.encode() for i, t in rows})


def test_suffix_dedup_in_rounds_and_turns(spark, scratch, monkeypatch):
    """More shared triggers than a filter tells apart go in rounds; each trigger's phrases are kept once, a part of them at a time."""
    kept = []
    monkeypatch.setattr(scratch, "keep", lambda df, name="t", keep=scratch.keep: kept.append((name, keep(df, name))) or kept[-1][1])
    monkeypatch.setattr(scratch, "drop", lambda df: None)
    rows = repetitive()
    check_suffix(spark, scratch, rows)
    whole = {(r.h, r.e, r.doc_id, r.lo) for r in next(t for name, t in kept if name == "phrases").collect()}
    n = next(t for name, t in kept if name == "shared").count()
    kept.clear()
    monkeypatch.setattr(suffix_dedup, "ROUND", n // 2 - 1)
    monkeypatch.setattr(suffix_dedup, "TURN", 1)
    monkeypatch.setattr(suffix_dedup, "TURNS", 2)
    check_suffix(spark, scratch, rows)
    rounds = [{(r.h, r.e, r.doc_id, r.lo) for r in t.collect()} for name, t in kept if name == "phrases"]
    assert len(rounds) == 3 and max(map(len, rounds)) < len(whole)
    assert sum(map(len, rounds)) == len(set().union(*rounds))
    assert [name for name, _ in kept].count("dictionary") == 6


def test_filter_of_shared_triggers(spark):
    """Six bits a trigger let few others pass; the filter before, of one bit a trigger at most, let through what fills it."""
    rng = np.random.default_rng(4)
    h, other = (rng.integers(-(1 << 63), (1 << 63) - 1, 20_000) for _ in range(2))
    table = spark.createDataFrame([(int(x),) for x in h], "h long")
    assert (f := suffix_dedup.TriggerFilter.of(table)).has(h).all() and f.has(other).mean() < 0.02
    held = (suffix_dedup.FILTER_BITS // suffix_dedup.ROUND, suffix_dedup.TriggerFilter.BITS_EACH)
    full = suffix_dedup.TriggerFilter(9, {})
    full.add(h[: len(full.bits) * 8 // held[0]])
    assert 0.04 < full.has(other).mean() < 0.08
    full.add(other[:5])
    assert held == (6, 16) and full.has(other[:5]).all()


def test_removed_runs_end_with_their_text(spark, scratch):
    """Texts that are cut together: removed ends beside removed starts, empty and null texts between, ids in any order."""
    a, b = ("".join(chr(97 + (i * i * k) % 26) for i in range(1, 121)) for k in (3, 7))
    rows = [(9, a), (1, a + "|" + b), (8, ""), (5, b[:60]), (7, None), (4, b), (6, ""), (3, "." + a), (2, "é" * 40)]
    check_suffix(spark, scratch, rows)
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in suffix_dedup.dedup_substrings(one, scratch).collect()}
    assert got == {9: [(0, 120)], 1: [], 8: [], 5: [(0, 60)], 7: [], 4: [(0, 120)], 6: [], 3: [(1, 121)], 2: []}


def test_cuts_of_many_texts_at_once():
    """Marks of a slice of texts come from arrays of cuts, without a loop over them."""
    rng = np.random.default_rng(9)
    lo, mask = rng.integers(0, 900, 40), rng.integers(0, 1 << suffix_dedup.SPAN, 40)
    want = np.zeros(1000, bool)
    for x, m in zip(lo.tolist(), mask.tolist(), strict=True):
        for i in range(suffix_dedup.SPAN):
            if m >> i & 1:
                want[x + i : x + i + suffix_dedup.LENGTH] = True
    assert (suffix_dedup.cover(1000, lo, mask) == want).all()
    assert not suffix_dedup.cover(5, np.zeros(0, np.int64), np.zeros(0, np.int64)).any()


def test_suffix_dedup_odd_rows(odd_docs, no_docs, scratch):
    got = suffix_dedup.substring_digest(odd_docs, scratch).collect()
    assert len(got) == odd_docs.count()
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (3, 4, 8)} == {3: 0, 4: 0, 8: 0}
    assert suffix_dedup.substring_digest(no_docs, scratch).count() == 0


def test_line_dedup_against_a_loop(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: tuple(r)[2:] for r in line_dedup.line_digest(docs, scratch).collect()}
    seen, want = set(), {}
    for r in sorted(docs.collect()):
        kept, n, lines = [], 0, 0
        for lo, hi, raw in line_dedup.chunks((r.text or "").encode()):
            if line_dedup._judged(lo, hi, raw) and raw in seen:
                n, lines = n + 1, lines + hi - lo
            else:
                kept.append(raw)
                seen.add(raw)
        want[r.doc_id] = (n, lines, hashlib.sha256(b"\n".join(kept)).hexdigest())
    assert got == want and sum(v[0] for v in want.values()) > 0


def plain_runs(rows):
    """Lines of every repeated run of two or more visible lines, by a loop over whole runs of any length."""
    at, out = {}, {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        seen, gone = [k for k, x in enumerate(lines) if x.strip()], set()
        for j, a in enumerate(seen):
            for b in seen[j + 1 :]:
                if (raw := "\n".join(lines[a : b + 1])) in at:
                    gone |= set(range(a, b + 1))
                at.setdefault(raw, i)
        left = [x for k, x in enumerate(lines) if k not in gone]
        out[i] = (len(lines), "") if gone and not any(x.strip() for x in left) else (len(gone), "\n".join(left))
    return out


def test_runs_of_lines_against_brute_force(spark, scratch):
    random.seed(4)
    new = iter(f"own line {k}" for k in range(10**6))
    rows = []
    for n in (2, 3, 5, 10, 20):
        shared = [f"shared {n} line {k}" if k % 4 != 3 else "" for k in range(n)]
        for _ in range(4):
            rows.append((len(rows), "\n".join([*[next(new) for _ in range(random.randint(1, 4))], *shared, *[next(new) for _ in range(random.randint(1, 4))]])))
    rows += [(len(rows) + k, "\n".join(random.choice(["a", "b", "c", "", " "]) for _ in range(random.randint(0, 12)))) for k in range(20)]
    rows += [(100, None), (101, "\n\nfirst\n\nsecond\n"), (102, "first\n\nsecond\n\n"), (103, "first\nsecond")]
    got = {r.doc_id: (r.lines.n_lines_removed, r.lines.text or "") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch, runs=True).collect()}
    want = plain_runs(rows)
    assert got == want
    assert all(want[i][0] == n - (n % 4 == 0) for k, n in enumerate((2, 3, 5, 10, 20)) for i in range(4 * k + 1, 4 * k + 4))
    assert {i: want[i][1] for i in (102, 103)} == {102: "", 103: "first\nsecond"}


def test_line_query_removes_every_repeated_run(spark, sf):
    from quantloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines_removed, r.kept_sha256) for r in QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert got == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in plain_runs(rows).items()}


def test_runs_go_through_chunks_first(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    by_chunk = {r.doc_id: {(c.no, c.h) for c in r.cut} for r in line_dedup.removals(docs, scratch).collect()}
    cuts = {r.doc_id: {(c.no, c.h) for c in r.cut} for r in line_dedup.removals(docs, scratch, runs=True).collect()}
    assert {i: {c for c in cut if c[0] < 0} for i, cut in cuts.items() if any(c[0] < 0 for c in cut)} == by_chunk and by_chunk
    for i, cut in cuts.items():  # no pair lies in a removed chunk, and pairs alone would cut more units
        inside = line_dedup.spans(text[i], cut)
        assert not any(lo <= no < hi - 1 for no, _ in cut if no >= 0 for lo, hi in inside if any(x.strip() for x in text[i].split(b"\n")[no + 1 : hi]))
    of_chunks = sum(hi - lo for i, cut in by_chunk.items() for lo, hi in line_dedup.spans(text[i], cut))
    assert of_chunks > sum(no >= 0 for cut in cuts.values() for no, _ in cut)


def test_rows_of_one_id_lose_only_their_own_units(spark, scratch):
    run = [f"line {k}" for k in range(12)]
    rows = [(1, "\n".join(run)), (2, "\n".join(["own", *run])), (2, "\n".join(f"other {k}" for k in range(13))), (2, "\n".join(["own", *run]))]
    got = sorted(r.lines.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), scratch, runs=True).collect())
    assert got == sorted([rows[0][1], "own", rows[2][1], "own"])


def test_runs_odd_rows(odd_docs, no_docs, scratch):
    got = line_dedup.dedup_lines(odd_docs, scratch, runs=True).collect()
    text = {r.doc_id: r.lines.text for r in got}
    assert len(got) == odd_docs.count() and text[2] == "" and text[3] is None and text[5] == "\n\n" and text[None] == "no id here at all"
    assert line_dedup.dedup_lines(no_docs, scratch, runs=True).count() == 0


def test_chunks_shift_only_near_a_change():
    lines = [f"line number {i * i % 97}" for i in range(200)]
    a = {c for _, _, c in line_dedup.chunks("\n".join(lines).encode())}
    b = {c for _, _, c in line_dedup.chunks("\n".join(["new", *lines]).encode())}
    assert b"\n".join(c for _, _, c in line_dedup.chunks("\n".join(lines).encode())).decode() == "\n".join(lines)
    assert len(a - b) <= 1


def test_line_dedup_odd_rows(odd_docs, no_docs, scratch):
    got = line_dedup.dedup_lines(odd_docs, scratch).collect()
    assert len(got) == odd_docs.count() and got[0].h == 1
    text = {r.doc_id: r.lines.text for r in got}
    assert text[3] is None and text[4] == "" and text[5] == "\n\n" and text[None] == "no id here at all"
    assert line_dedup.dedup_lines(no_docs, scratch).count() == 0


def planted(rng, dim, n_pairs, lo, hi):
    """Vectors with n_pairs partners at a cosine between lo and hi, and a group of near copies and one of equal ones."""
    x = rng.normal(size=(n_pairs, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = rng.normal(size=(n_pairs, dim))
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    c = rng.uniform(lo, hi, n_pairs)[:, None]
    dense = x[0] + rng.normal(size=(60, dim)) * 0.2 / dim**0.5
    return np.concatenate([x, c * x + (1 - c * c) ** 0.5 * o, dense, np.repeat(x[1:2], 9, 0)])


@pytest.mark.parametrize(("dim", "tile"), [(32, 256), (64, 8), (128, 256)])
def test_embedding_links(spark, scratch, monkeypatch, dim, tile):
    """All links but a few near the threshold are found; tables of few rows are compared whole, large ones in tiles."""
    units = embedding_dedup.units_of_work
    monkeypatch.setattr(embedding_dedup, "units_of_work", lambda n, s: units(n, s, tile))
    x = np.float32(planted(np.random.default_rng(dim), dim, 500, 0.931, 0.95)).astype(np.float64)
    lab = np.arange(len(x)) % 1 + (np.arange(len(x)) >= len(x) - 5)  # some of the equal vectors have another label
    d = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.embedding_links(d, scratch).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    assert len(got) == len(x)
    pairs = [i for i in range(2, 500) if near[i, 500 + i]]
    assert len(pairs) == 498 and np.mean([got[i].n_links >= 1 for i in pairs]) >= 0.97
    assert 0.97 * near.sum() <= sum(r.n_links for r in got.values()) <= near.sum()
    want = plain_components(near, list(range(len(x))))
    for i, r in got.items():
        assert r.n_links <= near[i].sum() and r.kept == (r.component_id == i)
        assert r.component_id == want[i] or r.n_links < near[i].sum() or any(got[int(j)].n_links < near[j].sum() for j in np.flatnonzero(near[i]))
    assert got[1].n_links == near[1].sum()


def test_tables_do_not_degenerate():
    """Segments are never longer than codes, and enough rotations give the tables they need."""
    rng = np.random.default_rng(4)
    for dim, rows in ((2, 100), (16, 10**5), (32, 10**4), (64, 10**7), (128, 10**9)):
        t = embedding_dedup.Tables(rng.normal(size=(300, dim)), rows)
        k = t.keys(rng.normal(size=(2000, dim)))
        assert k.shape == (2000, t.count) and t.width <= dim
        if dim >= 16:
            assert all(len(np.unique(k[:, s])) > min(1000, 1 << (t.width - 3)) for s in range(t.count))


def test_embedding_odd_rows(spark, scratch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_links(d, scratch).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[12] == (3, 1, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert by[None][:2] == (0, None)
    assert embedding_dedup.embedding_links(d.limit(0), scratch).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 63])
def test_hash_filter(spark, bits):
    from quantloom.llm.common import HashFilter

    rng = np.random.default_rng(bits)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    f = HashFilter.of(spark.createDataFrame([(int(x),) for x in h], "h long"), "h")
    assert f.has(h).all() and f.has(rng.integers(-(1 << 63), (1 << 63) - 1, 500)).mean() < 0.01
