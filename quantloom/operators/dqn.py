"""A double deep Q-network on numpy for the entry/exit policy.

Training is a small sequential job over the episodes of the search part, which are
collected under a stated bound; playing the trained policy is a distributed map over days
followed by the fold in ``policy``. It exists for completeness: results depend on the seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import COST, LEAST_ROWS, LOSS_AVERSION, MAX_HOLD

#: Most rows of all episodes that training collects.
EPISODE_ROWS = 2_000_000


class QNet:
    """Two hidden layers of rectified units and one output an action."""

    def __init__(self, n_in: int, hidden: int = 64, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [n_in, hidden, hidden, 2]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k < 2 else z)
        return out

    def q(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def copy_from(self, other: QNet) -> None:
        self.w, self.b = [x.copy() for x in other.w], [x.copy() for x in other.b]

    def gradients(self, x: np.ndarray, action: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean Huber loss of the chosen actions' values."""
        acts = self.forward(x)
        n = np.arange(len(x))
        d = np.zeros_like(acts[-1])
        d[n, action] = np.clip(acts[-1][n, action] - target, -1, 1) / len(x)
        grads: list[np.ndarray] = []
        for k in range(2, -1, -1):
            grads = [acts[k].T @ d, d.sum(0), *grads]
            if k:
                d = (d @ self.w[k].T) * (acts[k] > 0)
        return grads


class Adam:
    def __init__(self, rate: float = 1e-3):
        self.rate, self.t, self.m, self.v = rate, 0, None, None

    def step(self, net: QNet, grads: list[np.ndarray]) -> None:
        params = [p for k in range(3) for p in (net.w[k], net.b[k])]
        if self.m is None:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _state(x: np.ndarray, pos: int, held: int, unrealized: float) -> np.ndarray:
    return np.concatenate([x, [pos, held / MAX_HOLD, unrealized]])


def train(days: DataFrame, features: list[str], epochs: int = 40, batch: int = 64, gamma: float = 0.97, sync: int = 200, seed: int = 0, replay: int = 50_000) -> QNet:
    """days: (dt, ticker, at_ara, at_arb, daily_return, features..), features normalised and without NULL."""
    rows = days.select("ticker", "dt", "at_ara", "at_arb", F.coalesce("daily_return", F.lit(0.0)).alias("r"), *features).limit(EPISODE_ROWS + 1).toPandas()
    if len(rows) > EPISODE_ROWS:
        raise ValueError(f"more than {EPISODE_ROWS} episode rows; train on a part")
    rng = np.random.default_rng(seed)
    net, target, adam = QNet(len(features) + 3, seed=seed), QNet(len(features) + 3, seed=seed), Adam()
    target.copy_from(net)
    episodes = [g.sort_values("dt") for _, g in rows.groupby("ticker") if len(g) >= LEAST_ROWS]
    memory: list[tuple] = []
    steps, total = 0, max(1, epochs * sum(len(e) for e in episodes))
    for _ in range(epochs):
        for e in episodes:
            x, up, down, r = e[features].to_numpy(float), e["at_ara"].to_numpy(bool), e["at_arb"].to_numpy(bool), e["r"].to_numpy(float)
            pos, held, gain, n = 0, 0, 0.0, len(e)
            for t in range(n - 1):
                s = _state(x[t], pos, held, gain)
                explore = 1 - 0.95 * min(1.0, steps / (0.7 * total))
                a = int(rng.integers(2)) if rng.random() < explore else int(net.q(s[None])[0].argmax())
                wish = 0 if pos and held >= MAX_HOLD else a
                new = 1 if wish and not pos and not up[t] else 0 if not wish and pos and not down[t] else pos
                done = t + 1 >= n - 1
                ret = 0.0 if done else r[t + 1]
                pnl = new * ret
                reward = (pnl * LOSS_AVERSION if pnl < 0 else pnl) - COST * (new != pos)
                held, gain, pos = (held + 1, (1 + gain) * (1 + ret) - 1, 1) if new else (0, 0.0, 0)
                memory.append((s, a, reward, _state(x[t + 1], pos, held, gain), done))
                if len(memory) > replay:
                    memory[rng.integers(len(memory) - 1)] = memory.pop()
                steps += 1
                if len(memory) >= batch:
                    pick = [memory[i] for i in rng.integers(0, len(memory), batch)]
                    s0, act, rew, s1, end = (np.array(v) for v in zip(*pick, strict=True))
                    best = net.q(s1).argmax(1)  # one network chooses, the other values
                    y = rew + gamma * (1 - end) * target.q(s1)[np.arange(batch), best]
                    adam.step(net, net.gradients(s0, act, y))
                if steps % sync == 0:
                    target.copy_from(net)
    return net


def greedy_actions(days: DataFrame, net: QNet, features: list[str]) -> DataFrame:
    """``days`` with ``action``: what the policy wishes on each day when it holds nothing."""
    bc = days.sparkSession.sparkContext.broadcast(net)  # a few thousand weights
    where = [days.columns.index(f) for f in features]

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in where], 1).astype(float) if b.num_rows else np.zeros((0, len(where)))
            q = bc.value.q(np.concatenate([x, np.zeros((len(x), 3))], 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q.argmax(1).astype(np.int32))], names=[*b.schema.names, "action"])

    from pyspark.sql import types as T

    return days.mapInArrow(run, T.StructType([*days.schema.fields, T.StructField("action", T.IntegerType())]))
