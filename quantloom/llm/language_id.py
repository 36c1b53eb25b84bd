"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on the whole texts of a
bounded sample of labelled documents (``SAMPLE_PER_LANGUAGE`` below); it then reads
every byte of every text in windows of ``STEPS`` bytes, labels each position, and the
mean of the position probabilities over the bytes of letters is the document's
distribution. Windows of one block run side by side, one matrix step per byte.

Defined cases: text that is null or has no letter is ``und`` with score 0; an empty or
unlabelled training set makes every document ``und``; languages are any non-null labels;
ties go to the first language in sorted order; rows without an id hash as the empty
text, rows that share an id are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_within

UND = "und"
#: Bound of the training sample: about this many different documents of each language, every byte of them.
SAMPLE_PER_LANGUAGE = 250
STEPS = 64
HIDDEN = 8
BATCH = 256
#: All windows are learnt from at least once, and over again until so many batches were.
LEAST_BATCHES = 160
BLOCK = 2048


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 2 of 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (STEPS, n) of all texts, zero-filled at a text's end, and each window's text."""
    n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    count = -(-n // STEPS)
    x = np.zeros(int(count.sum()) * STEPS, np.uint8)
    begin = np.cumsum(count) - count
    for t, b in zip(texts, begin.tolist(), strict=True):
        x[b * STEPS : b * STEPS + len(t)] = np.frombuffer(t, np.uint8)
    return np.ascontiguousarray(x.reshape(-1, STEPS).T), np.repeat(np.arange(len(texts)), count)


#: 1 for the bytes that are part of letters (ASCII letters, all bytes of longer sequences).
_LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)], np.float32)


class BiGru:
    """Two GRUs, one a direction, and a softmax over both states at every position.

    A direction has byte inputs ``w`` (3H, 256), recurrent weights ``u`` (3H, H) and bias
    of the candidate's recurrent part ``c``; rows are reset, update and candidate gates.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        self.p = {"v": rng.normal(0, 0.3, (len(languages), 2 * hidden)), "b": np.zeros((len(languages), 1))}
        for d in "fb":
            self.p |= {f"w{d}": rng.normal(0, 0.4, (3 * hidden, 256)), f"u{d}": rng.normal(0, hidden**-0.5, (3 * hidden, hidden)), f"c{d}": np.zeros((hidden, 1))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States (STEPS, H, n) of one direction; ``tape`` gets what backpropagation needs."""
        h, w, u, c = self.h, self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        u_gate, u_cand = np.ascontiguousarray(u[: 2 * h]), np.ascontiguousarray(u[2 * h :])
        steps, n = x.shape
        out = np.empty((steps, h, n), np.float32)
        s = np.zeros((h, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = w[:, x[t]]
            g = a[: 2 * h]
            g += u_gate @ s
            g *= 0.5  # the logistic function as a hyperbolic tangent
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            q = u_cand @ s
            q += c
            m = a[2 * h :]
            m += g[:h] * q
            np.tanh(m, out=m)
            if tape is not None:
                tape.append((t, s, g.copy(), q, m.copy()))
            s = m + g[h:] * (s - m)
            out[t] = s
        return out

    def _reader(self, d: str) -> tuple[np.ndarray, ...]:
        """Weights of a direction for reading: one row a byte, halves folded in so that gates are plain tanh."""
        h, w, u = self.h, self.p[f"w{d}"].T, self.p[f"u{d}"].T
        parts = (0.5 * w[:, :h], 0.5 * w[:, h : 2 * h], w[:, 2 * h :], 0.5 * u[:, :h], 0.5 * u[:, h : 2 * h], 0.5 * u[:, 2 * h :], 0.5 * self.p[f"c{d}"].T)
        return tuple(np.ascontiguousarray(x, np.float32) for x in parts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (languages, STEPS, n) of every position."""
        steps, n = x.shape
        at, h = x.astype(np.intp), self.h
        z = np.empty((len(self.languages), steps, n), np.float32)
        z[:] = self.p["b"][:, :, None]
        for k, d in enumerate("fb"):
            in_r, in_z, in_m, u_r, u_z, u_m, c = self._reader(d)
            v = np.ascontiguousarray(self.p["v"][:, k * h : (k + 1) * h])
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                r, g, m = in_r.take(at[t], 0), in_z.take(at[t], 0), in_m.take(at[t], 0)
                r += s @ u_r
                np.tanh(r, out=r)
                g += s @ u_z
                np.tanh(g, out=g)
                q = s @ u_m
                q += c
                m += q
                r *= q
                m += r
                np.tanh(m, out=m)
                g *= s - m
                s = s + m
                s += g
                s *= 0.5
                z[:, t] += v @ s.T
        np.exp(np.clip(z, -30, 30, out=z), out=z)
        z /= z.sum(0)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all letter positions, by backpropagation through time."""
        tapes: dict[str, list] = {"f": [], "b": []}
        state = {d: self.states(x, d, tapes[d]) for d in "fb"}
        h, v = self.h, self.p["v"]
        z = np.einsum("lh,thn->ltn", v[:, :h], state["f"]) + np.einsum("lh,thn->ltn", v[:, h:], state["b"]) + self.p["b"][:, :, None]
        z -= z.max(0)
        p = np.exp(z)
        p /= p.sum(0)
        weight = _LETTER[x]
        p[y, :, np.arange(x.shape[1])] -= 1
        p *= weight / max(1.0, float(weight.sum()))
        g = {"b": p.sum((1, 2))[:, None], "v": np.concatenate([np.einsum("ltn,thn->lh", p, state[d]) for d in "fb"], 1)}
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            back = np.einsum("lh,ltn->thn", v[:, k * h : (k + 1) * h], p)
            gw, gu, gc = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u), np.zeros_like(self.p[f"c{d}"])
            ds = np.zeros((h, x.shape[1]), np.float32)
            for t, s, gate, q, m in reversed(tapes[d]):
                ds = ds + back[t]
                r, zt = gate[:h], gate[h:]
                dm = ds * (1 - zt) * (1 - m * m)
                da = np.concatenate([dm * q * r * (1 - r), ds * (s - m) * zt * (1 - zt), dm])
                dq = np.concatenate([da[: 2 * h], dm * r])
                gu += dq @ s.T
                gc += dq[2 * h :].sum(1, keepdims=True)
                for row in range(3 * h):
                    gw[row] += np.bincount(x[t], da[row], 256)
                ds = ds * zt + u.T @ dq
            g |= {f"w{d}": gw, f"u{d}": gu, f"c{d}": gc}
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, least_batches: int = LEAST_BATCHES, rate: float = 0.02, seed: int = 11) -> BiGru:
        """Adam over shuffled batches; the rate falls to a tenth by the last batch."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        n, step = x.shape[1], 0
        batches = max(1, -(-n // BATCH))
        epochs = max(1, -(-least_batches // batches))
        total = epochs * batches
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(n), batches):
                step += 1
                lr = rate * 0.1 ** (step / total)
                for k, g in self.gradients(x[:, at], y[at]).items():
                    g = np.clip(g, -1, 1)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= (lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, languages); a row without letters is zero."""
        x, doc = _pack(texts)
        total = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts))
        for lo in range(0, x.shape[1], BLOCK):
            own, at = x[:, lo : lo + BLOCK], doc[lo : lo + BLOCK]
            weight = _LETTER[own]
            pooled = (self.probabilities(own) * weight).sum(1)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(at, pooled[k], len(texts))
            letters += np.bincount(at, weight.sum(0), len(texts))
        return total / np.maximum(letters, 1)[:, None]


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """A bounded, repeatable sample (lang, whole text): about ``per_language`` different documents of each language.

    Documents are taken where the hash of id and text falls below the language's share, and
    equal rows count once; only counts by language and the sampled rows come to the driver.
    """
    train = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    below = F.lit(False)
    for lang, n in counts.items():
        below = below | ((F.col("lang") == lang) & (place < min(1.0, per_language / n)))
    rows = train.where(below).distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]))
    return [(r["lang"], r["text"].encode()) for r in rows]


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> BiGru | None:
    rows = sample(docs, per_language)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    at = {k: i for i, k in enumerate(languages)}
    x, doc = _pack([t for _, t in rows])
    return BiGru(languages).fit(x, np.array([at[k] for k, _ in rows])[doc])


def predict(docs: DataFrame, model: BiGru | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct column ``language`` (lang_pred, score)."""
    docs = docs.drop("language")  # a column of that name is replaced
    spark = docs.sparkSession
    bc = spark.sparkContext.broadcast(model)  # a few thousand weights
    schema = T.StructType([*docs.schema.fields, T.StructField("language", T.StructType.fromDDL("lang_pred string, score double"))])
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = bc.value
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
        for b in rows_within(batches, 4 << 20, where):
            texts = b.column(where).to_pylist()
            worded = [t is not None and any(map(str.isalpha, t)) for t in texts]
            out = [{"lang_pred": UND, "score": 0.0}] * len(texts)
            if net is not None and any(worded):
                at = [i for i, w in enumerate(worded) if w]
                p = net.documents([texts[i].encode() for i in at])
                for i, k, s in zip(at, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    out[i] = {"lang_pred": net.languages[k], "score": min(1.0, max(0.0, s))}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "language"])

    return docs.mapInArrow(run, schema)


def language_digest(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    d = predict(docs.select("doc_id", "text"), train(docs, per_language))
    return d.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
