import random

import numpy as np

from quantloom.llm import near_copies


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        out.append({" ".join(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set())
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def planted(seed, bases, copies, least=60, most=300, one_in=40):
    """Texts with copies of which some words are replaced."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(bases):
        t = rng.choices(words, k=rng.randint(least, most))
        out.append(" ".join(t))
        for _ in range(copies):
            c = list(t)
            for _ in range(rng.randint(1, max(1, len(t) // one_in))):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    rng.shuffle(out)
    return out


def test_recall_at_the_limit_and_no_false_link(spark, scratch):
    texts = planted(3, 400, 1)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch).collect()}
    sets = plain_sets(texts)
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for at in where.values() for k, a in enumerate(at) for b in at[k + 1 :]}
    near = [(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= 0.8]
    want = roots(len(texts), near)
    assert all(want[i] == want[c] for i, c in got.items())  # a group of the result lies in a true one
    hard = [(a, b) for a, b in near if jaccard(sets[a], sets[b]) < 0.9]
    assert len(hard) > 100
    for group, least in ((near, 0.96), (hard, 0.95)):
        assert sum(got[a] == got[b] for a, b in group) / len(group) >= least


def test_large_group_is_one_component(spark, scratch):
    texts = planted(5, 1, 900, 200, 200, 70) + planted(6, 30, 0)
    got = [r.component_id for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch).orderBy("doc_id").collect()]
    assert got[:901] == [0] * 901
    assert got[901:] == list(range(901, 931))


def test_documents_against_brute_force(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(docs), scratch).collect()}
    sets = plain_sets(r.text for r in docs)
    near = [(i, j) for j in range(len(docs)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    ids = [r.doc_id for r in docs]
    want = {ids[i]: ids[c] for i, c in enumerate(roots(len(docs), near))}
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[ids[a]] == got[ids[b]] for a, b in near) / len(near) >= 0.95


def test_odd_rows(spark, odd_docs, no_docs, scratch):
    got = {(r.doc_id, r.component_id) for r in near_copies.near_copies(odd_docs, scratch).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, None), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10)} == got
    assert near_copies.near_copies(no_docs, scratch).count() == 0
    kept = near_copies.keep_one(odd_docs, scratch).select("doc_id", "h").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10]


def test_fingerprint_distance_follows_the_cosine():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 330, dtype=np.uint64)
    a, b = (near_copies.long_fingerprint(v, 16) for v in (h[:300], h[30:]))
    share = np.unpackbits(a ^ b).mean()
    assert abs(share - np.arccos(270 / 300) / np.pi) < 0.04


def test_a_pair_within_the_ball_meets_once():
    plan = near_copies.Plan(1)
    masks, top = plan.ball()
    assert len(masks) == len(set(masks.tolist())) == 12 + 66
    rng = np.random.default_rng(2)
    for key in rng.integers(0, 1 << 12, 50):
        for other in (key ^ masks).tolist():
            asks = [set((a ^ masks[a & top == 0]).tolist()) for a in (key, other)]
            assert (other in asks[0]) + (key in asks[1]) == 1


def test_rounds_cover_every_key_once(spark, scratch, monkeypatch):
    texts = planted(7, 60, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {tuple(r) for r in near_copies.near_copies(docs, scratch).collect()}
    assert len({c for _, c in want}) < 90
    for room in (400, 70):  # rounds of some tables, and of a part of one
        monkeypatch.setattr(near_copies.EntryFilter, "ROOM", room)
        plan = near_copies.Plan(120)
        seen = [(t, k) for a, b, k, _ in plan.rounds(120) for t in range(a, b)]
        assert len(seen) == len(set(seen)) == plan.tables * -(-120 // room)
        assert {tuple(r) for r in near_copies.near_copies(docs, scratch).collect()} == want


def test_a_full_filter_only_lets_more_through(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 60, 20_000)
    held = near_copies.EntryFilter.of(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "k long"))
    at = held.passing(near_copies._mixed(keys))
    assert at[:10_000].tolist() == list(range(10_000)) and len(at) < 10_010


def test_family_below_the_limit_makes_few_rows(spark, scratch, monkeypatch):
    """Texts of one base, most pairs a little less alike than the limit: rows grow with the texts, and no link is lost."""
    texts = planted(8, 1, 599, 150, 150, 18)
    judged = []
    verified = near_copies._verified

    def counted(pairs, *rest):
        judged.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    got = [r.component_id for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch).orderBy("doc_id").collect()]
    sets = plain_sets(texts)
    near = [(a, b) for b in range(600) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    want = roots(600, near)
    assert 100 < len(set(want)) < 500
    assert all(want[i] == want[c] for i, c in enumerate(got))
    assert sum(got[a] == got[b] for a, b in near) / len(near) >= 0.96
    assert sum(judged) < 30 * 600


def test_tiles_join_what_all_pairs_do():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 12, 10)).astype(np.int64) for _ in range(90)] + [np.arange(5000), np.arange(100, 5100)]
    near = [(a, b) for b in range(92) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    block = np.arange(92) % 3
    links = []
    for one in range(3):
        for two in range(one, 3):
            at = np.flatnonzero((block == one) | (block == two))
            a, b = near_copies.tile_links([sets[i] for i in at], np.flatnonzero(block[at] == one), np.flatnonzero(block[at] == two), 0.8)
            assert len(a) < len(at)
            links += zip(at[a].tolist(), at[b].tolist(), strict=True)
    assert roots(92, links) == roots(92, near)
