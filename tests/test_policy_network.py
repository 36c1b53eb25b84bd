import datetime as dt

import numpy as np
import pytest

from quantloom.operators import dqn, policy

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(80)]
DAYS = "dt date, ticker string, action int, at_ara boolean, at_arb boolean, daily_return double"


def test_trade_log(spark):
    act = [1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1]
    rows = [(D[i], "A", a, False, False, 0.01) for i, a in enumerate(act)]
    got = [tuple(r) for r in policy.trade_log(spark.createDataFrame(rows, DAYS)).orderBy("trade").collect()]
    assert got[0][:5] == ("A", 1, D[0], D[2], 2) and got[0][5] == pytest.approx(1.01**2 - 1)
    assert got[1][:5] == ("A", 2, D[4], None, 7) or got[1][4] <= 7


def test_gradients():
    net, rng = dqn.QNet(3, hidden=4), np.random.default_rng(1)
    x, a, y = rng.normal(size=(6, 3)), rng.integers(0, 2, 6), rng.normal(size=6) * 0.1

    def loss():
        e = np.abs(net.q(x)[np.arange(6), a] - y)
        return np.where(e < 1, e * e / 2, e - 0.5).mean()

    g = net.gradients(x, a, y)
    for k in range(3):
        for p, d in ((net.w[k], g[2 * k]), (net.b[k], g[2 * k + 1])):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert d[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_it_learns_a_plain_signal(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in "ABC":
        f = rng.choice([-1.0, 1.0], 80)
        rows += [(D[i], t, False, False, float(0.03 * f[i - 1]) if i else 0.0, float(f[i])) for i in range(80)]
    d = spark.createDataFrame(rows, "dt date, ticker string, at_ara boolean, at_arb boolean, daily_return double, f double")
    net = dqn.train(d, ["f"], epochs=25, gamma=0.5)
    got = dqn.greedy_actions(d, net, ["f"]).collect()
    assert np.mean([(r.f > 0) == (r.action == 1) for r in got]) > 0.9
    assert policy.rollout(dqn.greedy_actions(d, net, ["f"])).agg({"reward": "sum"}).first()[0] > 0
