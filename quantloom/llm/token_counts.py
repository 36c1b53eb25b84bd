"""Exact token counts at every prefix of a text, for truncation and budget questions.

For a text ``t`` let C[i] be the tokens of its first i code points. White space is
always a pre-token border of the word-BPE file, and within a run without white space the
file's pattern cuts words, digits, marks and contractions, so C is put together from
tables of such parts:

    C[start(w) + j] = C[start(w)] + P_w[j]          for 0 <= j <= len(w)

P_w comes from dynamic programming over the symbols of w. A sequence of tokens is the
encoding of its text exactly if every two neighbours are the encoding of theirs, so with
last[i] the last token of the first i symbols and D[i] their number,

    D[i] = D[i - len(t)] + 1  for the one token t that ends at i and follows last[i - len(t)]

and P_w[j] is the same step with the tokens that end a word. Whether t follows a token is
decided once a pair by the file's merges. No prefix is encoded anew: a table takes one step
a symbol, and parts come sorted, so that the steps of a shared beginning are taken once.

C is stored as its differences, one signed byte a code point (four where one does not
fit): the total is their sum, and any budget question a running sum, at every length and
without encoding again.

Parts that normalisation could still change as they grow (combining marks, letters that
change length in lower case) and special strings are counted by the library, prefix by
prefix.

Defined cases: null text is empty and has no tokens; rows without an id and rows that
share an id are kept as they are; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from ahocorasick import Automaton
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_within
from .word_cache import mapped

LIMIT = 2048
_END = "</w>"
# Fixed value: the file's own pattern of pre-tokens.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+")
_SPACE = regex.compile(r"\p{White_Space}+")
_CONTRACTIONS = frozenset(["'re", "'ve", "'ll"])


class Recurrence:
    """Counts at the prefixes of one pre-token after another."""

    def __init__(self, merges: list, vocab):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        #: token -> the pair that it is merged from, and when
        self.made = {a + b: (a, b, i) for i, (a, b) in reversed(list(enumerate(pairs)))}
        kinds: dict[str, list] = {}
        for t in vocab:
            text = t.removesuffix(_END)
            kinds.setdefault(text, [len(text), None, None])[1 + t.endswith(_END)] = t
        #: finds the tokens in a text: length, the token that goes on, the one that ends a word
        self.found = Automaton()
        for text, kind in kinds.items():
            self.found.add_word(text, tuple(kind))
        self.found.make_automaton()
        #: (token, next token) -> whether they are the encoding of their text
        self.known: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.symbols, self.last, self.count, self.final = "", [""], [0], [0]

    def merged(self, text: str, ends: bool) -> list[str]:
        """Byte-pair encoding by its definition: the first of the lowest pairs, again and again."""
        symbols, rank = list(text), self.rank
        if ends:
            symbols[-1] += _END
        while len(symbols) > 1:
            best, at = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one edge of a token while it is merged, and the rank of the merge that takes it in."""
        got = self.edges[side].get(token)
        if got is None:
            got, at, until = [], token, 1 << 60
            while True:
                got.append((at, until))
                if at not in self.made:
                    break
                until, at = self.made[at][2], self.made[at][side]
            self.edges[side][token] = got
        return got

    def follows(self, a: str, t: str) -> bool:
        """Whether a (or nothing) and t are the encoding of their text: no merge across the border comes before
        those that take its two sides in; of two equal ones the left goes first."""
        ok = self.single.get(t)
        if ok is None:
            ends = t.endswith(_END)
            ok = self.single[t] = self.merged(t.removesuffix(_END), ends) == [t]
        if ok and a:
            rank = self.rank
            for x, until in self._edge(a, 1):
                for y, till in self._edge(t, 0):
                    r = rank.get((x, y))
                    if r is not None and r < until and r <= till:
                        ok = False
                        break
                if not ok:
                    break
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[a, t] = ok
        return ok

    def prefixes(self, symbols: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... symbols."""
        same, top = 0, min(len(symbols), len(self.symbols))
        while same < top and symbols[same] == self.symbols[same]:
            same += 1
        last, count, final, known = self.last, self.count, self.final, self.known
        del last[same + 1 :], count[same + 1 :], final[same + 1 :]
        self.symbols = symbols
        at, wanted = same, 0
        for end, (n, t, t_end) in self.found.iter(symbols):  # tokens by the place where they end
            if end < same:
                continue
            if end >= at:
                at, wanted = end + 1, 3
            elif not wanted:
                continue
            if end + 1 - n >= len(last):  # a symbol before is in no token
                break
            a = last[end + 1 - n]
            if t is not None and wanted & 1:
                ok = known.get((a, t))
                if ok or (ok is None and self.follows(a, t)):
                    last.append(t)
                    count.append(count[end + 1 - n] + 1)
                    wanted &= 2
            if t_end is not None and wanted & 2:
                ok = known.get((a, t_end))
                if ok or (ok is None and self.follows(a, t_end)):
                    final.append(count[end + 1 - n] + 1)
                    wanted &= 1
        if len(last) <= len(symbols) or len(final) <= len(symbols):
            self.symbols, self.last, self.count, self.final = "", [""], [0], [0]
            raise ValueError(f"no token holds a symbol of {symbols!r}")
        return final[1:]


class PrefixCounter:
    """Prefix tables under a word-BPE file (NFC, lower case, white space dropped)."""

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.steps_of = Recurrence(model["merges"], model["vocab"])
        self.max_words = max_words
        #: run without a plain space -> differences of its counts, as signed bytes; those that do not fit
        self.tables: dict[str, bytes] = {"": b""}
        self.wide: dict[str, np.ndarray] = {}
        #: pre-token -> differences
        self.parts: dict[str, list[int]] = {}

    def _library(self, parts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tk.encode_batch_fast(parts, add_special_tokens=False)]

    def _by_library(self, piece: str) -> list[int]:
        """Counts at the prefixes of a piece, each encoded; the copies stay small."""
        out: list[int] = []
        step = max(1, (4 << 20) // len(piece))
        for lo in range(0, len(piece), step):
            out += self._library([piece[: j + 1] for j in range(lo, min(lo + step, len(piece)))])
        return out

    def _stable(self, piece: str) -> str | None:
        """The normalised piece if every prefix of it is the normalised prefix of ``piece``."""
        if "<|" in piece:
            return None
        if piece.isascii():
            return piece.lower()
        low = "".join(c if len(c) == 1 else "\0\0" for c in map(str.lower, piece))  # letter by letter, as the library does
        return low if len(low) == len(piece) and is_normalized("NFC", piece) else None

    def _part(self, part: str) -> list[int]:
        if _SPACE.fullmatch(part):
            return [0] * len(part)
        if part in _CONTRACTIONS:  # shorter prefixes are cut otherwise
            counts = self._library([part[: j + 1] for j in range(len(part))])
        elif part.isascii() and part.isprintable():
            counts = self.steps_of.prefixes(part)
        else:
            symbols = [mapped(c) for c in part]
            counts = self.steps_of.prefixes("".join(symbols))
            counts = [counts[i - 1] for i in accumulate(map(len, symbols))]
        return list(map(sub, counts, [0, *counts[:-1]]))

    def learn(self, pieces: set[str]) -> None:
        """Adds the tables of pieces that have none yet."""
        if len(self.tables) + len(self.wide) > self.max_words:
            self.tables, self.wide = {"": b""}, {}
            self.parts.clear()
        cut: dict[str, list[str]] = {}
        odd: list[str] = []
        for p in pieces:
            if p in self.tables or p in self.wide:
                continue
            low = self._stable(p)
            if low is None:
                odd.append(p)
            else:
                cut[p] = [low] if low.isalpha() and low.isascii() else _PARTS.findall(low)
        parts = self.parts
        for part in sorted({x for xs in cut.values() for x in xs} - parts.keys()):
            parts[part] = self._part(part)
        for p, xs in cut.items():
            steps = parts[xs[0]] if len(xs) == 1 else [s for x in xs for s in parts[x]]
            # letters beyond the Latin ones may be classed otherwise by another Unicode version
            if max(p) > "\u024f" and sum(steps) != self._library([p])[0]:
                odd.append(p)
            else:
                self._keep(p, steps)
        for p in odd:
            counts = self._by_library(p)
            self._keep(p, list(map(sub, counts, [0, *counts[:-1]])))

    def _keep(self, piece: str, steps: list[int]) -> None:
        try:
            self.tables[piece] = array("b", steps).tobytes()
        except OverflowError:
            self.wide[piece] = np.array(steps, np.int32)

    def pieces(self, text: str) -> list[str]:
        """Runs between characters that are white space for the tokenizer and for us alike; some are empty.
        Any other white space stays inside a piece."""
        for c in "\n\t\r":
            text = text.replace(c, " ")
        return text.split(" ")

    def steps(self, pieces: list[str]) -> np.ndarray:
        """Differences of C over the text of ``pieces`` (one white space between two), all of them known."""
        t = self.tables
        try:
            return np.frombuffer(b"\0".join([t[p] for p in pieces]), np.int8)
        except KeyError:
            out = []
            for p in pieces:
                out += [self.wide[p] if p in self.wide else np.frombuffer(t[p], np.int8).astype(np.int32), np.zeros(1, np.int32)]
            return np.concatenate(out[:-1])

    def prefix(self, text: str) -> np.ndarray:
        """C[0..len(text)]."""
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return np.concatenate([[0], np.cumsum(self.steps(pieces), dtype=np.int64)])


def fit(steps: np.ndarray, budget: int) -> int:
    """The longest prefix, in code points, whose count is at most ``budget``."""
    return int(np.flatnonzero(np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]) <= budget)[-1])


def stored(raw: bytes, n_chars: int) -> np.ndarray:
    """The differences of C from the stored column of a text of ``n_chars``."""
    return np.frombuffer(raw, np.int8 if len(raw) == n_chars else np.int32)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within ``limit`` tokens).

    With ``keep_steps`` also n_chars and steps, C's stored differences, for ``fit_within``.
    """
    more = ", n_chars long, steps binary" if keep_steps else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for b in rows_within(batches, 2 << 20, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            split = [c.pieces(t) for t in texts]
            c.learn(set().union(*split))
            steps = [c.steps(p) for p in split]
            n = [int(s.sum(dtype=np.int64)) for s in steps]
            fits = [len(t) if k <= limit else fit(s, limit) for t, s, k in zip(texts, steps, n, strict=True)]
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(fits, pa.int64())]
            if keep_steps:
                cols += [pa.array([len(t) for t in texts], pa.int64()), pa.array([s.tobytes() for s in steps], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "n_chars", "steps"][: len(cols)])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long{more}")


def fit_within(counted: DataFrame, budget: int) -> DataFrame:
    """(doc_id, fit_chars) for another budget, from stored steps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [fit(stored(raw, n), budget) for n, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64())], ["doc_id", "fit_chars"])

    return counted.select("doc_id", "n_chars", "steps").mapInArrow(run, "doc_id long, fit_chars long")
