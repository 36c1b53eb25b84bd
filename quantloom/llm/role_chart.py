"""Weighted Earley charts of role sequences with delete, rerole and insert productions.

The grammar reads a conversation from the left: what a prefix has been repaired to is
nothing (E), a system turn (H), something that ends in a user turn (V) or in an assistant
turn (W). Every production that adds a turn may keep a row, rerole it or insert an empty
one, and every prefix may go on by deleting a row. Items hold the least (cost, audit) of
all their derivations; audits of one item have read the same rows, so the smaller of two
stays smaller whatever follows.

A row is one symbol: the initial of its role (``s``, ``u``, ``a``, ``o`` for others), in
upper case if its text is truncated, or ``-`` if it has to be deleted.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

#: (head, body); small letters are edits, see :func:`edit`.
GRAMMAR = [
    ("S", ("E",)),
    ("S", ("W",)),
    ("E", ("E", "gone")),
    ("H", ("E", "system")),
    ("H", ("H", "gone")),
    ("V", ("E", "user")),
    ("V", ("H", "user")),
    ("V", ("W", "user")),
    ("V", ("V", "gone")),
    ("W", ("V", "assistant")),
    ("W", ("W", "gone")),
    ("gone", ("delete",)),
    ("system", ("keep s",)),
    ("user", ("keep u",)),
    ("user", ("rerole",)),
    ("user", ("insert",)),
    ("assistant", ("keep a",)),
    ("assistant", ("rerole",)),
    ("assistant", ("insert",)),
]
STATES = "EHVW"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_OF: dict[str, list[int]] = {}
for _i, (_head, _) in enumerate(GRAMMAR):
    _OF.setdefault(_head, []).append(_i)
_EDITS = {"delete", "keep s", "keep u", "keep a", "rerole", "insert"}

Value = tuple[int, str]


def edit(terminal: str, symbol: str) -> Value | None:
    """Cost and letter of an edit of a row, None where it is not allowed."""
    if terminal == "delete":
        return DELETE, "D"
    if symbol == "-":
        return None
    late = TRUNCATED if symbol.isupper() else 0
    if terminal == "rerole":
        return REROLE + late, "R"
    return (KEEP + late, "K") if terminal[-1] == symbol.lower() else None


class _Set:
    """Items between two rows: those that wait for a symbol, and edits that read the next row."""

    def __init__(self):
        self.waits: dict[str, list[tuple[int, int, int, Value]]] = {}
        self.scans: list[tuple[int, int, int, Value]] = []
        self.complete: dict[tuple[str, int], Value] = {}


def chart(symbols: str, entry: str = "E") -> dict[str, Value]:
    """Least (cost, audit) of every state in which ``symbols`` can end when they begin in state ``entry``; S is a whole conversation."""
    sets: dict[int, _Set] = {}
    came: list[tuple[int, int, int, Value]] = []
    at = _Set()
    for j in range(len(symbols) + 1):
        at = _Set()
        sets[j] = at
        heap: list[tuple[int, int, str, int, int]] = []
        best: dict[tuple[int, int, int], Value] = {}

        def push(rule: int, dot: int, origin: int, v: Value, best=best, heap=heap) -> None:
            if (rule, dot, origin) not in best or v < best[rule, dot, origin]:
                best[rule, dot, origin] = v
                heapq.heappush(heap, (-origin, *v, rule, dot))

        def finish(head: str, origin: int, v: Value, at=at, j=j, push=push) -> None:
            if (head, origin) in at.complete:
                return
            at.complete[head, origin] = v
            for rule, dot, o, left in list(sets[origin].waits.get(head, ())):
                push(rule, dot + 1, o, (left[0] + v[0], left[1] + v[1]))

        if j == 0:
            for r in _OF["S"]:
                push(r, 0, 0, (0, ""))
        for item in came:
            push(*item)
        seeded = j > 0
        while heap or not seeded:
            if not heap or (not seeded and heap[0][1] > 0):
                seeded = True
                finish(entry, 0, (0, ""))
                continue
            neg, cost, audit, rule, dot = heapq.heappop(heap)
            origin, v = -neg, (cost, audit)
            if best[rule, dot, origin] != v:
                continue
            head, body = GRAMMAR[rule]
            if dot == len(body):
                finish(head, origin, v)
                continue
            nxt = body[dot]
            if nxt == "insert":
                push(rule, dot + 1, origin, (cost + INSERT, audit + "I"))
            elif nxt in _EDITS:
                at.scans.append((rule, dot, origin, v))
            else:
                at.waits.setdefault(nxt, []).append((rule, dot, origin, v))
                if nxt not in STATES or j == 0:
                    for r in _OF[nxt]:
                        push(r, 0, j, (0, ""))
                done = at.complete.get((nxt, j))
                if done is not None:
                    push(rule, dot + 1, origin, (cost + done[0], audit + done[1]))
        came = []
        if j < len(symbols):
            for rule, dot, origin, v in at.scans:
                e = edit(GRAMMAR[rule][1][dot], symbols[j])
                if e is not None:
                    came.append((rule, dot + 1, origin, (v[0] + e[0], v[1] + e[1])))
        used = {o for _, _, o, _ in came} | {0, j}
        for o in [o for o in sets if o not in used]:
            del sets[o]
    return {h: v for (h, o), v in at.complete.items() if o == 0 and (h in STATES or h == "S")}


@lru_cache(maxsize=100_000)
def _short(symbols: str) -> Value:
    return chart(symbols)["S"]


def cheapest(symbols: str) -> Value:
    """Cost and audit of the cheapest repair of a whole conversation, ties by ASCII."""
    return _short(symbols) if len(symbols) <= 64 else chart(symbols)["S"]


def replay(audit: str, roles: list[str], texts: list[str], state: str = "E") -> list[tuple[str, str]]:
    """(role, text) of the repaired turns: the edits of ``audit`` on these rows, from ``state``."""
    out, i = [], 0
    for e in audit:
        role, text = ("", "") if e == "I" else (roles[i], texts[i])
        i += e != "I"
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if state == "V" else "user"
        state = {"s": "H", "u": "V", "a": "W"}[role[:1]]
        out.append((role, text))
    return out
