"""Conversation repair and the prefix trie against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from quantloom.llm import conversation_repair as C
from quantloom.llm import prefix_trie as P
from quantloom.llm import role_chart as R

LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(symbols, most_inserts):
    """All (cost, audit) whose result is legal, by plain enumeration."""
    choices = []
    for s in symbols:
        late = 3 if s.isupper() else 0
        row = [(4, "D", "")]
        if s != "-":
            row += [(late, "K", s.lower()), (3 + late, "R", "u"), (3 + late, "R", "a")]
        choices.append(row)
    for n in range(most_inserts + 1):
        for places in itertools.combinations_with_replacement(range(len(symbols) + 1), n):
            for roles in itertools.product("ua", repeat=n):
                for edits in itertools.product(*choices):
                    out, audit, cost = "", "", 3 * n
                    for i in range(len(symbols) + 1):
                        for p, r in zip(places, roles, strict=True):
                            if p == i:
                                out, audit = out + r, audit + "I"
                        if i < len(symbols):
                            cost, audit, out = cost + edits[i][0], audit + edits[i][1], out + edits[i][2]
                    if LEGAL.fullmatch(out):
                        yield cost, audit


def test_chart_equals_every_repair():
    random.seed(3)
    cases = ["".join(x) for n in range(3) for x in itertools.product("suaoU-", repeat=n)]
    cases += ["".join(random.choice("ssuaoSUAO-") for _ in range(3)) for _ in range(60)]
    for s in cases:
        assert R.cheapest(s) == min(every_repair(s, 3)), s


def test_chart_of_parts_equals_the_whole():
    random.seed(4)
    for _ in range(60):
        parts = ["".join(random.choice("ssuaoSUAO-") for _ in range(random.randint(1, 12))) for _ in range(random.randint(1, 6))]
        charts = [{a + b: v for a in R.STATES for b, v in R.chart(p, a).items() if b in R.STATES} for p in parts]
        cost, path = C.join_charts(charts)
        assert (cost, "".join(x for _, x in path)) == R.cheapest("".join(parts))
        rows = ["user" if c in "uU" else "assistant" if c in "aA" else "system" if c in "sS" else "tool" for p in parts for c in p]
        whole, i = [], 0
        for p, (entry, audit) in zip(parts, path, strict=True):
            whole += R.replay(audit, rows[i : i + len(p)], [""] * len(p), entry)
            i += len(p)
        assert whole == R.replay("".join(x for _, x in path), rows, [""] * len(rows))
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in whole))


def plain_repair(rows):
    """The digest's rows by a dictionary of rows, one conversation at a time."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        convs[c] += [(turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols, n = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            f = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            n.update({f: n[f] + 1} if f else {})
            symbols += "-" if f in ("b", "d") else (lambda x: x.upper() if f else x)(role[:1] if role[:1] in ("s", "u", "a") else "o")
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = R.cheapest(symbols)
        body = "\n".join(f"{r}:{t}" for r, t in R.replay(audit, [r for _, r, _ in own], [t for _, _, t in own]))
        out[c] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def odd_conversations(n=60, seed=5):
    random.seed(seed)
    rows = []
    for c in [*range(n), None]:
        for t in range(random.randint(1, 9)):
            rows.append((c, t if random.random() > 0.1 else None, random.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "ünt"]), random.choice(["Yes.", "No!", "Hm", "", " \n\t", None, "Ça va ?", "Long. " * 50, "a.", "a", "end. \n"])))
    return rows + rows[:7]


SCHEMA = "conv_id long, turn long, role string, text string, copies string, seg int"


@pytest.mark.parametrize("long", [False, True])
def test_repair_of_odd_conversations(spark, scratch, monkeypatch, long):
    if long:
        monkeypatch.setattr(C, "MOST_ROWS", 2)
        monkeypatch.setattr(C, "SEGMENT_ROWS", 2)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = C.repair_digest(df, scratch)
    found = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert found == plain_repair(rows) and got.count() == len(found)


def test_repair_of_a_long_conversation(spark, scratch, monkeypatch):
    monkeypatch.setattr(C, "MOST_ROWS", 500)
    monkeypatch.setattr(C, "SEGMENT_ROWS", 64)
    random.seed(6)
    rows = [(7, t, random.choice(["user", "assistant", "system"]), random.choice(["Yes.", "No", f"{t}.", f"{t}?", ""])) for t in range(3000)] + [(8, None, "user", "Same.")] * 700 + [(9, 1, "user", "Hi.")]
    got = C.repair(C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), scratch)
    found = {r.conv_id: (*tuple(r)[1:8], r.sha) for r in got.collect()}
    assert found == plain_repair(rows)


def test_repaired_turns(spark, scratch):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi.", 1), (1, 1, "user", "So?", 1), (1, 2, "user", "So?", 1)], "conv_id long, turn long, role string, text string, copies long")
    r = C.repair(rows, scratch).first()
    assert r.audit == "IKKDI" and [tuple(t) for t in r.turns] == [("user", ""), ("assistant", "Hi."), ("user", "So?"), ("assistant", "")]


def test_repair_of_nothing(spark, scratch):
    assert C.repair_digest(spark.createDataFrame([], SCHEMA), scratch).count() == 0


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
    kids = defaultdict(set)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    out = set()
    for n, m in members.items():
        under = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(n))))
        out.add((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), sum(not kids[x] for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_of_odd_conversations(spark, scratch):
    random.seed(8)
    rows = [(c, t if random.random() > 0.2 else None, random.choice(["user", "assistant", None]), random.choice(["a", "b", "é", None, ""])) for c in [*range(70), None, 10**12] for t in range(random.randint(1, 7))]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # ties of a turn are in hash order
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).withColumnsRenamed({"copies": "digest", "seg": "depth"}).repartition(5)
    got = [tuple(r) for r in P.trie_digest(df, scratch).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_in_small_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BITS", 2)
    random.seed(9)
    rows = [(c, t, "user", random.choice("ab") if c % 3 else "a") for c in range(40) for t in range(random.randint(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in P.trie_digest(df, scratch).collect()} == plain_trie(rows)


def test_trie_of_conversations_without_turns_of_their_own(spark, scratch):
    short = [c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:6]
    rows = [(c, 0, "user", "gone") for c in short]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in P.trie_digest(df, scratch).collect()} == plain_trie(rows)
    assert P.trie_digest(df.limit(0), scratch).count() == 0
