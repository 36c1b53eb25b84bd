"""Unigram encoding and decoding: Viterbi over a double-array trie of scored pieces.

Pieces come from a public vocabulary file. That file ranks its pieces but holds no
probabilities, and tokenizers are not trained here, so a piece's log score is a fixed
function of its rank, Zipf's law ``log p(r) = -log((r + 1) * H)`` with H the harmonic
number; ``Unigram`` takes any scored pieces. Space becomes the marker U+2581, with one put before the text. A character that no piece
covers falls back to the byte pieces of its UTF-8 form at a penalty of 10 below the
lowest score. No piece holds a marker after another character, so the best path of a
text is that of its words (a run of markers and what follows up to the next one); words
are segmented once and remembered, a block of new ones at a time with numpy: one step
moves every word along the trie by a byte. Remembered words are two generations of a
bounded number, since a worker process keeps them for as long as it lives: a full one
takes the place of the one before, whose words stay if they occur again meanwhile.

Decoding joins the pieces, turns markers into spaces and drops the first one.
``decode(encode(t)) == t`` for every text without U+2581, which decodes to a space.

Defined cases: null text stays null with no ids; empty text has no ids and decodes to the
empty text; ties go to the segmentation whose last piece starts first; rows without an id
or sharing one are kept; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_within, tidy

MARK = "▁"
PENALTY = 10.0
#: Longer words take the path that goes along one word.
LONG = 96
#: Bytes of texts that are encoded at a time, and words in a block of new ones.
SLICE_BYTES = 256 << 10
BLOCK_WORDS = 4096
_UNIT = re.compile(r" *[^ ]+| +$")


class DoubleArray:
    """Trie over bytes: the child of node s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        end = [-1]
        for k, key in enumerate(keys):
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    end.append(-1)
                at = nxt
            end[at] = k
        size = 4 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        place = [0] * len(children)
        # Only children fill holes behind; siblings go to the open end, whose front moves on as it fills.
        hole, front = 1, 1
        for node in range(len(children)):  # parents come before their children
            kids = sorted(children[node])
            if not kids:
                continue
            if len(kids) == 1:
                hole = used.index(0, hole)
                b = used.index(0, max(hole, kids[0] + 1)) - kids[0] - 1
            else:
                b, tries = max(0, front - kids[0] - 1), 0
                while any(used[b + c + 1] for c in kids):
                    b += 1
                    tries += 1
                front += tries // 8
            s = place[node]
            base[s] = b
            for c in kids:
                t = b + c + 1
                used[t], check[t], place[children[node][c]], value[t] = 1, s, t, end[children[node][c]]
            if b + 1024 > len(used):
                grow = len(used)
                base += [0] * grow
                check += [-1] * grow
                value += [-1] * grow
                used += bytes(grow)
        self.base, self.check, self.value = (np.array(x, np.int64) for x in (base, check, value))


class Unigram:
    """Scored pieces with byte fallback."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], max_words: int = 40_000):
        self.ids = np.array([i for i, _, _ in pieces], np.int64)
        self.scores = np.array([s for _, _, s in pieces])
        self.byte_ids, self.unknown, self.max_words = byte_ids, float(self.scores.min()) - PENALTY, max_words
        self.trie = DoubleArray([p.encode() for _, p, _ in pieces])
        if any(MARK in p.lstrip(MARK) for _, p, _ in pieces):
            raise ValueError("a piece holds a marker after another character; words cannot be cut at markers")
        self.text_of = {i: p.replace(MARK, " ").encode() for i, p, _ in pieces} | {b: bytes([k]) for k, b in enumerate(byte_ids)}
        self.packed = [int(i).to_bytes(4, "little") for i in self.ids]
        self.fallback = [int(i).to_bytes(4, "little") for i in byte_ids]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        total = float(np.log((1.0 / np.arange(1, len(plain) + 1)).sum()))
        scored = [(i, sp.id_to_piece(i), float(-np.log(r + 1.0) - total)) for r, i in enumerate(plain)]
        return cls(scored, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def one(self, word: bytes) -> list[int]:
        """The best path of one word, byte by byte; also the plain statement of ``many``."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(word)
        best, start, piece = [-np.inf] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf or word[i] & 0xC0 == 0x80:
                continue
            width = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
            node, single = 0, False
            for j in range(i, n):
                t = int(base[node]) + word[j] + 1
                if check[t] != node:
                    break
                node = t
                k = int(value[t])
                if k >= 0:
                    single |= j + 1 - i == width
                    s = best[i] + scores[k]
                    if s > best[j + 1]:
                        best[j + 1], start[j + 1], piece[j + 1] = s, i, k
            if not single and best[i] + self.unknown > best[i + width]:
                best[i + width], start[i + width], piece[i + width] = best[i] + self.unknown, i, -1
        out, at = [], n
        while at:
            k, i = piece[at], start[at]
            out.append([int(self.ids[k])] if k >= 0 else [self.byte_ids[c] for c in word[i:at]])
            at = i
        return [x for p in reversed(out) for x in p]

    def many(self, words: list[bytes]) -> list[bytes]:
        """Best paths of words of up to LONG bytes, as little-endian 32-bit ids."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        width = int(size.max())
        x = np.zeros((width, n), np.int64)
        for k, w in enumerate(words):
            x[: len(w), k] = np.frombuffer(w, np.uint8)
        best = np.full((width + 1, n), -np.inf)
        start, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        for i in range(width):
            rows = np.flatnonzero((best[i] > -np.inf) & (size > i) & (x[i] & 0xC0 != 0x80))
            if not len(rows):
                continue
            lead = x[i, rows]
            step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, bool)
            at, node = rows, np.zeros(len(rows), np.int64)
            for j in range(i, width):
                t = base[node] + x[j, at] + 1
                ok = (check[t] == node) & (size[at] > j)
                at, node = at[ok], t[ok]
                if not len(at):
                    break
                k = value[node]
                hit = k >= 0
                to, ks = at[hit], k[hit]
                s = best[i, to] + self.scores[ks]
                better = s > best[j + 1, to]
                to_b = to[better]
                best[j + 1, to_b], start[j + 1, to_b], piece[j + 1, to_b] = s[better], i, ks[better]
                single[to] |= (j + 1 - i) == (1 + (x[i, to] >= 0xC0) + (x[i, to] >= 0xE0) + (x[i, to] >= 0xF0))
            miss = ~single[rows]
            if miss.any():
                to, end = rows[miss], i + step[miss]
                s = best[i, to] + self.unknown
                better = s > best[end, to]
                to, end = to[better], end[better]
                best[end, to], start[end, to], piece[end, to] = s[better], i, -1
        out: list[list[bytes]] = [[] for _ in words]
        at, rows = size.copy(), np.arange(n)
        rows = rows[at > 0]
        packed, fallback = self.packed, self.fallback
        while len(rows):
            here = at[rows]
            k, i = piece[here, rows], start[here, rows]
            for r, p, lo, hi in zip(rows.tolist(), k.tolist(), i.tolist(), here.tolist(), strict=True):
                out[r].append(packed[p] if p >= 0 else b"".join([fallback[c] for c in words[r][lo:hi]]))
            at[rows] = i
            rows = rows[i > 0]
        return [b"".join(reversed(p)) for p in out]

    def units(self, text: str) -> list[str]:
        """Words of a text without their first space; ``text`` has the dummy prefix left out."""
        return text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [u[1:] for u in _UNIT.findall(" " + text)]

    def learn(self, units: set[str]) -> None:
        """Puts all units into ``known``; before them it has at most ``max_words``, and as many are in ``before``."""
        if len(self.known) > self.max_words:
            self.before, self.known = dict(islice(self.known.items(), self.max_words)), {}
        again = {u: self.before[u] for u in units if u in self.before and u not in self.known}
        self.known |= again
        new = [u for u in units if u not in self.known]
        coded = [(MARK + u.replace(" ", MARK)).encode() for u in new]
        order = sorted((k for k in range(len(new)) if len(coded[k]) <= LONG), key=lambda k: len(coded[k]))
        for lo in range(0, len(order), BLOCK_WORDS):
            block = order[lo : lo + BLOCK_WORDS]
            for k, ids in zip(block, self.many([coded[k] for k in block]), strict=True):
                self.known[new[k]] = ids
        for u, c in zip(new, coded, strict=True):
            if len(c) > LONG:
                self.known[u] = array("I", self.one(c)).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        split = [self.units(t) if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        known = self.known
        return [b"".join([known[u] for u in s]) for s in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.text_of.__getitem__, ids))[1:].decode("utf-8", "replace")


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """One model a worker process, kept between tasks."""
    if path not in _models:
        _models[path] = Unigram.from_file(path)
    return _models[path]


def _id_lists(ids: list[bytes], null: list[bool]) -> pa.Array:
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")), mask=pa.array(null))


def encode_column(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with a last column of piece ids and, if named, one of the text decoded from them."""
    docs = docs.drop(ids_col, *[decoded_col] * bool(decoded_col))  # columns of these names are replaced
    where = docs.columns.index(text_col)
    fields = [*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType()))

    def encoded(m: Unigram, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(where).to_pylist()
        null = [t is None for t in texts]
        ids = m.encode_all([t or "" for t in texts])
        cols = [*b.columns, _id_lists(ids, null)]
        if decoded_col:
            cols.append(pa.array([None if n else m.decode(np.frombuffer(i, "<u4").tolist()) for i, n in zip(ids, null, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in rows_within(batches, SLICE_BYTES, where):
            yield encoded(m, b)

    return docs.mapInArrow(run, T.StructType(fields))


def decode_column(docs: DataFrame, model_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with a last column of the text that the ids stand for."""
    where = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            text = [m.decode(i.values.to_numpy(zero_copy_only=False).tolist()) if i.is_valid else None for i in b.column(where)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, text_col])
        tidy()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_sha256 (of the comma-joined ids), decoded_sha256, round_trip."""
    both = encode_column(docs.select("doc_id", "text"), model_path, decoded_col="decoded")
    ids = F.coalesce("token_ids", F.array().cast("array<int>"))
    return both.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_pieces"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
