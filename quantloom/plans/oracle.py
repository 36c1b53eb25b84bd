"""DuckDB SQL of the queries, written independently of the DataFrame operators."""

from __future__ import annotations

from ..operators.features import HORIZONS
from ..schema import ABSORBERS, CLUSTERS, FOREIGN, RETAIL, SMART_MONEY, VARIANTS
from .queries import EXACT, SCAN_SETS, SETS
from .standin import duckdb_views


def _in(codes: list[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 as {name}"


def _net(codes: list[str]) -> str:
    return f"coalesce(sum(case when broker_code in {_in(codes)} then netval end), 0)"


W = "window w as (partition by ticker order by dt)"
CLUSTER_NAMES = {f"cl_{k}": v for k, v in CLUSTERS.items()} | {"cl_foreign": FOREIGN}
CLUSTER_COLS = ", ".join(f"{_net(v)} / nullif(sum(abs(netval)), 0) as {k}" for k, v in CLUSTER_NAMES.items())

VIEWS: dict[str, str] = {
    "AGG": f"""select dt, ticker, sum(case when rn <= 3 then abs(netval) end) / nullif(sum(abs(netval)), 0) as broker_concentration,
        coalesce(sum(netval), 0) as net_flow_total, count(*) as n_brokers, avg(case when netval > 0 then 1e0 else 0e0 end) as net_buy_ratio,
        coalesce(sum(case when broker_code in {_in(RETAIL)} then abs(netval) end), 0) / nullif(sum(abs(netval)), 0) as retail_presence_pct
      from (select *, row_number() over (partition by dt, ticker order by abs(netval) desc nulls last, broker_code) as rn from B) group by dt, ticker""",
    "STEPS": "select * from (select dt, ticker, lag(dt) over (partition by ticker order by dt) as pd from (select distinct dt, ticker from B)) where pd is not null",
    "CORR": """select s.dt, s.ticker, c.r as broker_correlation_1d from STEPS s left join (
        select s.dt, s.ticker, case when count(*) >= 3 then covar_pop(a.netval, b.netval) / nullif(stddev_pop(a.netval) * stddev_pop(b.netval), 0) end as r
        from STEPS s join B a on a.dt = s.dt and a.ticker = s.ticker join B b on b.dt = s.pd and b.ticker = s.ticker and b.broker_code = a.broker_code
        group by s.dt, s.ticker) c on c.dt = s.dt and c.ticker = s.ticker""",
    "PX": f"""select dt, ticker, (close - lag(close) over w) / nullif(lag(close) over w, 0) as momentum_1d,
        volume / nullif(case when count(volume) over (partition by ticker order by dt rows between 5 preceding and 1 preceding) = 5
          then avg(volume) over (partition by ticker order by dt rows between 5 preceding and 1 preceding) end, 0) as volume_ratio,
        (lead(close) over w - close) / nullif(close, 0) as target from P {W}""",
    "PANEL": "select a.*, c.broker_correlation_1d, p.momentum_1d, p.volume_ratio, p.target from AGG a left join CORR c using (dt, ticker) join PX p using (dt, ticker) where p.target is not null",
    "SMART": f"""select *, smart_money_net - retail_net as tod_divergence, case when smart_money_net > 0 and retail_net < 0 then 1e0 else 0e0 end as tod_signal, absorber_net - retail_net as absorber_vs_retail
      from (select dt, ticker, {_net(SMART_MONEY)} as smart_money_net, {_net(RETAIL)} as retail_net, {_net(ABSORBERS)} as absorber_net from B group by dt, ticker)""",
    "CL": f"select *, greatest({', '.join(CLUSTER_NAMES)}) as cl_max from (select dt, ticker, {CLUSTER_COLS} from B group by dt, ticker)",
    "PR": "select dt, ticker, momentum_1d as pred, target as actual from PX where momentum_1d is not null and target is not null",
    "LIM": f"""select *, coalesce(pct >= case when pc < 200 then 0.35 when pc <= 5000 then 0.25 else 0.20 end - 0.01, false) as at_ara, coalesce(pct <= -0.15 + 0.01, false) as at_arb
      from (select *, lag(close) over w as pc, (close - lag(close) over w) / nullif(lag(close) over w, 0) as pct, row_number() over w as rn from P {W})""",
    "AUD": f"""select *, limit_violation or cross_ticker_dup or series_break as suspect,
        concat_ws('+', case when limit_violation then 'limit_violation' end, case when cross_ticker_dup then 'cross_ticker_dup' end, case when series_break then 'series_break' end) as reasons
      from (select dt, ticker, open, high, low, close, volume,
          coalesce(pct > case when pc < 200 then 0.35 when pc <= 5000 then 0.25 else 0.20 end + 0.005 or pct < -0.15 - 0.005, false) as limit_violation,
          open is not null and high is not null and low is not null and close is not null and volume is not null
            and count(*) over (partition by dt, open, high, low, close, volume) > 1 as cross_ticker_dup,
          coalesce(close / nullif(mid, 0) > 5 or close / nullif(mid, 0) < 0.2, false) as series_break
        from (select *, lag(close) over w as pc, (close - lag(close) over w) / nullif(lag(close) over w, 0) as pct,
            case when count(close) over (partition by ticker order by dt rows between 10 preceding and 10 following) >= 5
              then quantile_cont(close, 0.5) over (partition by ticker order by dt rows between 10 preceding and 10 following) end as mid
          from PD {W}))""",
    "AX": "select dt, row_number() over (order by dt) as pos from (select distinct dt from PD)",
    "CLEAN": "select p.*, x.pos from PD p join AX x using (dt) where not exists (select 1 from AUD a where a.suspect and a.dt = p.dt and a.ticker = p.ticker)",
    "FIX": "select dt, ticker, close / 10 as close from PD where ticker = 'Brand#7' and month(dt) = 6",
    "SX": "select dt, row_number() over (order by dt) as pos from (select distinct dt from M where close is not null)",
    "MP": "select m.dt, m.ticker, m.close, m.high, m.low, x.pos from M m join SX x using (dt) where m.close is not null",
}


def _outcome(h: int) -> str:
    frame = f"(partition by ticker order by dt rows between 1 following and {h} following)"
    return f"""select ticker, pos, {h} as h, 100.0 * (lead(close, {h}) over w - close) / close as ret, 100.0 * (max(high) over {frame} - close) / close as mfe,
      100.0 * (min(low) over {frame} - close) / close as mae, (lead(pos, {h}) over w) - pos = {h} and close <> 0 as ok from MP {W}"""


VIEWS["OUTC"] = "select * from (" + " union all ".join(f"({_outcome(h)})" for h in (1, 3, 5)) + ") where ok"
VIEWS["SIG"] = "select g.flag_date, g.ticker, g.sources, o.h, o.ret, o.mfe, o.mae from G g join SX x on x.dt = g.flag_date join OUTC o on o.ticker = g.ticker and o.pos = x.pos + 1"
VIEWS["KW"] = f"""select g.flag_date, g.ticker, g.sources, n as days_elapsed, n >= 3 as resolved, (c3 - close) / nullif(close, 0) as current_pct, (h3 - close) / nullif(close, 0) as highest_pct, (l3 - close) / nullif(close, 0) as drawdown_pct
  from G g join (select dt, ticker, close, count(*) over f as n, last_value(close) over f as c3, max(high) over f as h3, min(low) over f as l3 from M
    window f as (partition by ticker order by dt rows between 1 following and 3 following)) p on p.dt = g.flag_date and p.ticker = g.ticker where n > 0"""


def _trade(hold: str, tp: str, sl: str, most: int) -> str:
    """Return of a trade as one case over the next rows c1.., l1.., h1.., of which n exist."""
    arms = []
    for k in range(1, most + 1):
        live = f"{k} <= {hold} and {k} <= n"
        arms.append(f"when {live} and {sl} is not null and l{k} <= close * (1 - {sl}) then -{sl}")
        arms.append(f"when {live} and {tp} is not null and h{k} >= close * (1 + {tp}) then {tp}")
        arms.append(f"when {live} and ({k} = {hold} or {k} = n) then (c{k} - close) / nullif(close, 0)")
    return f"case {' '.join(arms)} end"


def _ahead(most: int) -> str:
    cols = ", ".join(f"lead(close, {k}) over w as c{k}, lead(high, {k}) over w as h{k}, lead(low, {k}) over w as l{k}" for k in range(1, most + 1))
    return f"select dt, ticker, close, least(count(*) over (partition by ticker) - row_number() over w, {most}) as n, {cols} from P {W}"


def _variants() -> str:
    n = lambda v: "cast(null as double)" if v is None else f"cast({v} as double)"
    return "select * from (values " + ", ".join(f"({i}, cast({t} as double), {h}, {n(tp)}, {n(sl)})" for i, (t, h, tp, sl) in enumerate(VARIANTS, 1)) + ") v(variant, threshold, hold, tp, sl)"


_SHARPE = "round(case when {std}({x}) > 0 then avg({x}) / {std}({x}) end * sqrt(252.0), 6) + 0.0 as sharpe, count({x}) as n_trades, round(avg(case when {x} > 0 then 1e0 when {x} is not null then 0e0 end), 6) + 0.0 as hit_rate"


def _sharpe(x: str, std: str = "stddev_pop") -> str:
    return _SHARPE.format(x=x, std=std)


VIEWS["AHEAD"] = _ahead(5)
VIEWS["VAR"] = _variants()
VIEWS["PART"] = "select dt, case when row_number() over (order by dt) <= floor(count(*) over () * cast(0.7 as double)) then 'search' else 'holdout' end as part from (select distinct dt from PR)"
VIEWS["GRID"] = f"""select part, variant, {_sharpe("ret")} from (
    select t.part, v.variant, {_trade("v.hold", "v.tp", "v.sl", 5)} as ret
    from PR p join PART t using (dt) join AHEAD a on a.dt = p.dt and a.ticker = p.ticker join VAR v on p.pred > v.threshold) where ret is not null group by part, variant"""
VIEWS["LAW"] = """select *, coalesce(free, least(rn + 20, nmax)) as exit_rn from (select dt, ticker, rn, close, at_ara, count(*) over (partition by ticker) as nmax, lead(close) over (partition by ticker order by dt) as c1,
    min(case when not at_arb then rn end) over (partition by ticker order by dt rows between 1 following and 19 following) as free from LIM) where rn < nmax"""
VIEWS["TRADES"] = """select l.dt, l.ticker, l.at_ara as blocked, (l.c1 - l.close) / nullif(l.close, 0) as naive_ret, case when not l.at_ara then (e.close - l.close) / nullif(l.close, 0) end as ret,
    case when not l.at_ara then l.exit_rn - l.rn end as hold_days from LAW l join LIM e on e.ticker = l.ticker and e.rn = l.exit_rn"""
VIEWS["PAX"] = "select dt, row_number() over (order by dt) as pos from (select distinct dt from P)"
VIEWS["FOLDS"] = "select c as cycle, 30 + (c - 1) * 6 as train_hi, 30 + (c - 1) * 6 + 1 as test_lo, 30 + (c - 1) * 6 + 6 as test_hi from (select unnest(generate_series(1, cast(floor((max(pos) - 30) / 6.0) as bigint))) as c from PAX)"
VIEWS["PP"] = "select p.dt, p.ticker, p.pred as x, p.actual as y, a.pos from PR p join PAX a using (dt)"
VIEWS["LINE"] = """select *, (sy - slope * sx) / nullif(n, 0) as intercept from (select *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) as slope from (
    select f.cycle, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from FOLDS f join PP p on p.pos <= f.train_hi group by f.cycle))"""
VIEWS["WF"] = "select f.cycle, p.dt, p.ticker, l.intercept + l.slope * p.x as pred, p.y as actual from FOLDS f join PP p on p.pos between f.test_lo and f.test_hi join LINE l on l.cycle = f.cycle"
VIEWS["MDD"] = "select case when (lead(pos, 3) over w) - pos = 3 then (min(low) over (partition by ticker order by dt rows between 1 following and 3 following) - close) / nullif(close, 0) end as mdd_3 from CLEAN " + W


_PART_RANK = "rank() over (partition by features, h order by {c}) + (count(*) over (partition by features, h, {c}) - 1) / 2.0"


def _ahead_returns() -> str:
    return ", ".join(f"(lead(close, {h}) over w - close) / nullif(close, 0) as target_{h}" for h in HORIZONS)


def _problems(sets: dict[str, list[str]], targets: dict[str, str], view: str) -> str:
    """One row a set, target and panel row in which nothing is missing."""
    arms = []
    for name, feats in sets.items():
        for h, y in targets.items():
            there = " and ".join(f"{c} is not null" for c in [*feats, y])
            arms.append(f"select '{name}' as features, '{h}' as h, dt, ticker, [{', '.join(f'cast({c} as double)' for c in feats)}] as x, {y} as y from {view} where {there}")
    return " union all ".join(arms)


def _walked(sets: dict[str, list[str]], targets: dict[str, str], view: str, train: int, step: int, least: int = 0) -> str:
    """Tables I (rows), N (dates of each problem) and R (predictions): normal equations of every fold, solved by elimination."""
    p = "features, h"
    return f"""with recursive I as ({_problems(sets, targets, view)}), D as (select {p}, dt, row_number() over (partition by {p} order by dt) as pos from (select distinct {p}, dt from I)),
      Q as (select I.*, D.pos from I join D using ({p}, dt)), N as (select {p}, max(pos) as n from D group by all),
      C as (select {p}, unnest(generate_series(1, cast(floor((n - {train}) / {step}.0) as bigint))) as c from N where n >= {train} + {step}),
      T as (select {p}, pos, i, j, sum(z[i] * z[j]) as v, count(*) as n from (select {p}, pos, list_append(list_prepend(cast(1 as double), x), y) as z from Q), unnest(range(1, len(z))) a(i), unnest(range(1, len(z) + 1)) b(j) group by all),
      G as (select {p}, c, i, j, sum(v) as v from C join T using ({p}) where pos <= {train} + (c - 1) * {step} group by {p}, c, i, j having sum(n) > {least}),
      M as (select {p}, c, list(r order by i) as m from (select {p}, c, i, list(v order by j) as r from G group by all) group by all),
      J as (select {p}, c, cast(0 as bigint) as k, m, list_transform(m, lambda r, i: r[i]) as d, cast([] as boolean[]) as free from M union all
        select {p}, c, k + 1, case when m[k + 1][k + 1] <= 1e-10 * d[k + 1] then m else list_transform(m, lambda r, i: case when i = k + 1 then list_transform(r, lambda v: v / m[k + 1][k + 1])
        else list_transform(r, lambda v, j: v - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) end) end, d, list_append(free, m[k + 1][k + 1] > 1e-10 * d[k + 1]) from J where k < len(m)),
      S as (select {p}, c, list_transform(m, lambda r, i: case when free[i] then r[len(r)] else cast(0 as double) end) as beta from J where k = len(m)),
      R as (select {p}, c as cycle, list_dot_product(beta, list_prepend(cast(1 as double), x)) as pred, y as actual from S join Q using ({p}) where pos between {train} + (c - 1) * {step} + 1 and {train} + c * {step})"""


VIEWS["ROLLS"] = f"""select dt, ticker, {', '.join(f"case when count({c}) over (partition by ticker order by dt rows between {w} preceding and 1 preceding) >= {max(2, w // 2)} then avg({c}) over (partition by ticker order by dt rows between {w} preceding and 1 preceding) end as {c}_roll{w}" for c in ('net_flow_total', 'broker_concentration') for w in (5, 10))},
    {', '.join(f"case when count(b) over (partition by ticker order by dt rows between {w - 1} preceding and current row) >= {max(2, w // 2)} then sum(b) over (partition by ticker order by dt rows between {w - 1} preceding and current row) end as buy_days_{w}" for w in (5, 10))}
    from (select *, case when lag(net_flow_total) over w > 0 then 1e0 else 0e0 end as b from AGG {W})"""
VIEWS["ABL"] = f"""select a.*, c.broker_correlation_1d, r.* exclude (dt, ticker), s.* exclude (dt, ticker), p.momentum_1d, p.volume_ratio, t.* exclude (dt, ticker) from AGG a left join CORR c using (dt, ticker) left join ROLLS r using (dt, ticker) left join SMART s using (dt, ticker)
    join PX p using (dt, ticker) join (select dt, ticker, {_ahead_returns()} from P {W}) t using (dt, ticker)"""
ABLATION = f"""{_walked(SETS, {str(h): f'target_{h}' for h in HORIZONS}, "ABL", 30, 6)},
    E as (select features, h, cycle, avg(abs(pred - actual)) as m, count(*) as n from R group by all), F as (select features, h, avg(m) as mae, count(*) as n_cycles, cast(sum(n) as bigint) as n_preds from E group by all),
    A as (select features, h, count(*) as n, avg(abs(y)) as naive from I group by all), V as (select features, h, {_SHARPE.format(x="v", std="stddev_samp")} from (select features, h, case when pred > 0.005 then actual end as v from R) group by all)
  select features, h, A.n, {_r('mae', 'mae')}, {_r('naive', 'naive_mae')}, mae < naive as beats_naive, coalesce(n_cycles, 0) as n_cycles, coalesce(n_preds, 0) as n_preds, coalesce(n_trades, 0) as n_trades, sharpe, hit_rate from A left join F using (features, h) left join V using (features, h)"""


def _guard(kind: str, k: int) -> str:
    if kind == "fwd":
        return f"case when (lead(pos, {k}) over w) - pos = {k} then (lead(close, {k}) over w - close) / nullif(close, 0) end"
    if kind == "lag":
        return f"case when pos - (lag(pos, {k}) over w) = {k} then (close - lag(close, {k}) over w) / nullif(lag(close, {k}) over w, 0) end"
    f, c = ("max", "high") if kind == "max" else ("min", "low")
    return f"case when (lead(pos, {k}) over w) - pos = {k} then ({f}({c}) over (partition by ticker order by dt rows between 1 following and {k} following) - close) / nullif(close, 0) end"


_BEFORE5 = "(partition by ticker order by dt rows between 5 preceding and 1 preceding)"
VIEWS["SCAN"] = f"""select a.*, c.broker_correlation_1d, k.* exclude (dt, ticker), p.* exclude (dt, ticker) from AGG a left join CORR c using (dt, ticker) left join CL k using (dt, ticker) join (
    select dt, ticker, {_guard('lag', 1)} as momentum_1d, {_guard('lag', 5)} as momentum_5d, volume / nullif(case when count(volume) over {_BEFORE5} = 5 then avg(volume) over {_BEFORE5} end, 0) as volume_ratio,
      case when count((high - low) / nullif(close, 0)) over (partition by ticker order by dt rows between 9 preceding and current row) >= 10 then avg((high - low) / nullif(close, 0)) over (partition by ticker order by dt rows between 9 preceding and current row) end as atr_pct,
      {', '.join(f"{_guard(k, h)} as {k}_{h}" for h in HORIZONS for k in ('fwd', 'max'))} from CLEAN {W}) p using (dt, ticker)"""
SCANNED = f"""{_walked(SCAN_SETS, {f"{k}_{h}": f"{c}_{h}" for k, c in (('ret', 'fwd'), ('max', 'max')) for h in HORIZONS}, "SCAN", 60, 10, 100)},
    K as (select *, {_PART_RANK.format(c='pred')} as a, {_PART_RANK.format(c='actual')} as b from R), U as (select features, h, quantile_cont(pred, 0.9) as cut from R group by all)
  select features, h, count(*) as n, {_r('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)', 'ic')}, count(case when pred >= cut then 1 end) as n_top, {_r('avg(case when pred >= cut then case when actual > 0 then 1e0 else 0e0 end end)', 'hit')},
    {_r('avg(case when pred >= cut then actual end)', 'top_ret')}, {_r('avg(actual)', 'base_ret')}, {_r('avg(case when pred >= cut then actual end) - avg(actual)', 'edge')} from K join U using (features, h) group by features, h"""


def _roll(c: str, w: int) -> str:
    f = f"(partition by ticker order by dt rows between {w} preceding and 1 preceding)"
    return _r(f"case when count({c}) over {f} >= {max(2, w // 2)} then avg({c}) over {f} end", f"{c}_roll{w}")


def _streak(w: int) -> str:
    f = f"(partition by ticker order by dt rows between {w - 1} preceding and current row)"
    return _r(f"case when count(b) over {f} >= {max(2, w // 2)} then sum(b) over {f} end", f"buy_days_{w}")


def _sum6(by: list[str]) -> str:
    return f"select {', '.join(by)}, count(ret) as n, {_r('avg(ret)', 'mean')}, {_r('quantile_cont(ret, 0.5)', 'median')}, {_r('100.0 * avg(case when ret > 0 then 1e0 else 0e0 end)', 'hit_pct')}, {_r('avg(mfe)', 'mfe')}, {_r('avg(mae)', 'mae')}"


_AGG = "broker_concentration net_flow_total net_buy_ratio retail_presence_pct".split()
_ATR = "(high - low) / nullif(close, 0)"
_TEN = "(partition by ticker order by dt rows between 9 preceding and current row)"
_ATR_SQL = f"case when count({_ATR}) over {_TEN} >= 10 then avg({_ATR}) over {_TEN} end"
_COVERED = ["close", "high", "low", "tval", "m_dn_0", "m_dn_3", "is_unusual_volume", "clean_score"]
_LISTS = ["m_dn_0", "m_dn_3", "tval"]
_RANKED = "rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"
_Z = "coalesce(least(greatest(({c} - (select avg({c}) from PX where dt < date '1995-01-01')) / (select case when stddev_samp({c}) = 0 then 1 else stddev_samp({c}) end from PX where dt < date '1995-01-01'), -5), 5), 0)"
_WEEK = "(select count(*) from generate_series(1, greatest(date_diff('day', {a}, {b}), 0)) g(i) where isodow({a} + cast(i as int)) < 6)"


def _z(c: str) -> str:
    return _r(_Z.format(c=c), c)


VIEWS["WEL"] = """select *, (m1 - m0) / nullif(sqrt(v1 / nullif(n1, 0) + v0 / nullif(n0, 0)), 0) as t, pow(v1 / nullif(n1, 0) + v0 / nullif(n0, 0), 2) / nullif(pow(v1 / nullif(n1, 0), 2) / nullif(n1 - 1, 0) + pow(v0 / nullif(n0, 0), 2) / nullif(n0 - 1, 0), 0) as dof from (
    select avg(case when s = 1 then t end) as m1, avg(case when s = 0 then t end) as m0, var_samp(case when s = 1 then t end) as v1, var_samp(case when s = 0 then t end) as v0, count(case when s = 1 then t end) as n1, count(case when s = 0 then t end) as n0
    from (select q.tod_signal as s, p.target as t from PANEL p left join SMART q using (dt, ticker)))"""
#: The p-value is the incomplete beta function by its series, a hypergeometric sum, at the side where that converges.
WELCH = f"""with recursive X as (select *, dof / 2 as h, dof / (dof + t * t) as x from WEL),
    Y as (select *, x < (h + 1) / (h + 2.5) as near, case when x < (h + 1) / (h + 2.5) then h else cast(0.5 as double) end as a, case when x < (h + 1) / (h + 2.5) then cast(0.5 as double) else h end as b, case when x < (h + 1) / (h + 2.5) then x else 1 - x end as z from X),
    S as (select cast(0 as bigint) as m, a, b, z, cast(1 as double) as term, cast(1 as double) as total from Y union all
      select m + 1, a, b, z, term * (a + b + m) / (a + 1 + m) * z, total + term * (a + b + m) / (a + 1 + m) * z from S where m < 3000),
    Z as (select exp(lgamma(Y.a + Y.b) - lgamma(Y.a) - lgamma(Y.b) + Y.a * ln(Y.z) + Y.b * ln(1 - Y.z)) / Y.a * S.total as part from Y, S where S.m = 3000)
  select {_r('m1', 'mean_on')}, {_r('m0', 'mean_off')}, n1 as n_on, n0 as n_off, {_r('t', 't')}, {_r('dof', 'dof')}, {_r('case when near then part else 1 - part end', 'p')} from Y, Z"""


SELECTS: dict[str, str] = {
    "broker_day_aggregates": f"select dt, ticker, n_brokers, {', '.join(_r(c, c) for c in _AGG)} from AGG",
    "broker_correlation_1d": f"select dt, ticker, {_r('broker_correlation_1d', 'broker_correlation_1d')} from CORR",
    "price_features_target": f"select dt, ticker, {', '.join(_r(c, c) for c in ('momentum_1d', 'volume_ratio', 'target'))} from PX",
    "training_panel": f"select dt, ticker, n_brokers, {', '.join(_r(c, c) for c in [*_AGG, 'broker_correlation_1d', 'momentum_1d', 'volume_ratio', 'target'])} from PANEL",
    "multi_horizon_targets": f"select dt, ticker, {', '.join(_r(f'(lead(close, {h}) over w - close) / nullif(close, 0)', f'target_{h}') for h in HORIZONS)} from P {W}",
    "rolling_broker_features": f"select dt, ticker, {', '.join([*(_roll(c, w) for c in ('net_flow_total', 'broker_concentration') for w in (5, 10)), *(_streak(w) for w in (5, 10))])} from (select *, case when lag(net_flow_total) over w > 0 then 1e0 else 0e0 end as b from AGG {W})",
    "smart_money_features": f"select dt, ticker, {', '.join(_r(c, c) for c in ('smart_money_net', 'retail_net', 'absorber_net', 'tod_divergence', 'tod_signal', 'absorber_vs_retail'))} from SMART",
    "cluster_features": f"select dt, ticker, {', '.join(_r(c, c) for c in [*CLUSTER_NAMES, 'cl_max'])} from CL",
    "atr_pct": f"select dt, ticker, {_r(_ATR_SQL, 'atr_pct')} from P",
    "limit_flags": f"select dt, ticker, {_r('pct', 'pct')}, at_ara, at_arb from LIM",
    "audit_limit_violation": "select dt, ticker from AUD where limit_violation",
    "audit_cross_ticker_dup": "select dt, ticker from AUD where cross_ticker_dup",
    "audit_series_break": "select dt, ticker from AUD where series_break",
    "audit_suspects_reasons": "select dt, ticker, reasons from AUD where suspect",
    "audit_by_ticker": f"select ticker, cast(sum(case when suspect then 1 else 0 end) as bigint) as n_suspect, count(*) as n_rows, {_r('100.0 * sum(case when suspect then 1 else 0 end) / count(*)', 'pct')} from AUD group by ticker having sum(case when suspect then 1 else 0 end) > 0 order by 2 desc, 1 limit 15",
    "audit_by_detector": "select " + ", ".join(f"cast(sum(case when {c} then 1 else 0 end) as bigint) as {c}" for c in ("limit_violation", "cross_ticker_dup", "series_break", "suspect")) + " from AUD",
    "collision_groups": "select dt, string_agg(ticker, ',' order by ticker) as tickers, count(*) as n from AUD where cross_ticker_dup group by dt, open, high, low, close, volume",
    "clean_prices": f"select dt, ticker, {_r('close', 'close')} from CLEAN",
    "suspect_broker_rows": "select b.ticker, count(*) as n from B b where exists (select 1 from AUD a where a.suspect and a.dt = b.dt and a.ticker = b.ticker) group by b.ticker",
    "gap_guarded_forward": f"select dt, ticker, {_r('close', 'close')}, {', '.join(_r(_guard('fwd', k), f'fwd_{k}') for k in HORIZONS)} from CLEAN {W}",
    "gap_guarded_lagged": f"select dt, ticker, {_r('close', 'close')}, {', '.join(_r(_guard('lag', k), f'lag_{k}') for k in (1, 5))} from CLEAN {W}",
    "gap_guarded_extremes": f"select dt, ticker, {_r('close', 'close')}, {', '.join(_r(_guard(k, 3), f'{k}_3') for k in ('fwd', 'max', 'mdd'))} from CLEAN {W}",
    "horizon_panel": f"""select a.dt, a.ticker, a.n_brokers, {', '.join(_r('a.' + c, c) for c in _AGG)}, {', '.join(_r('c.' + k, k) for k in [*CLUSTER_NAMES, 'cl_max'])},
        {', '.join(_r('p.' + c, c) for c in ('fwd_1', 'max_1', 'mdd_1', 'fwd_3', 'max_3', 'mdd_3', 'lag_1', 'lag_5', 'atr_pct'))} from AGG a left join CL c using (dt, ticker) join (
        select dt, ticker, {', '.join(f"{_guard(k, h)} as {k}_{h}" for h in (1, 3) for k in ('fwd', 'max', 'mdd'))}, {_guard('lag', 1)} as lag_1, {_guard('lag', 5)} as lag_5, {_ATR_SQL} as atr_pct from CLEAN {W}) p using (dt, ticker)""",
    "repair_prices": f"select p.dt, p.ticker, {_r('p.open', 'open')}, {_r('coalesce(f.close, p.close)', 'close')} from PD p left join FIX f using (dt, ticker)",
    "rescale_netval": f"select b.dt, b.ticker, b.broker_code, {_r('case when month(b.dt) < 7 and f.close is not null and abs(f.close / p.close - 1) > 1e-9 then b.netval * (f.close / p.close) else b.netval end', 'netval')} from B b left join PD p using (dt, ticker) left join FIX f using (dt, ticker)",
    "signal_outcomes": f"select flag_date, ticker, sources, h, {', '.join(_r(c, c) for c in ('ret', 'mfe', 'mae'))} from SIG",
    "signal_by_source": f"{_sum6(['source', 'h'])} from (select unnest(string_split(sources, ',')) as source, h, ret, mfe, mae from SIG) group by source, h",
    "control_group": f"{_sum6(['h'])} from (select o.h, o.ret, o.mfe, o.mae from MP m join OUTC o on o.ticker = m.ticker and o.pos = m.pos + 1 where not exists (select 1 from G g where g.flag_date = m.dt and g.ticker = m.ticker)) group by h",
    "uncovered_signals": "select flag_date, ticker from G g where not exists (select 1 from M m where m.clean_score is not null and m.close is not null and m.dt = g.flag_date and m.ticker = g.ticker)",
    "konglo_watch": f"select flag_date, ticker, sources, days_elapsed, resolved, {', '.join(_r(c, c) for c in ('current_pct', 'highest_pct', 'drawdown_pct'))} from KW",
    "konglo_watch_sharpe": f"select {_sharpe('current_pct')} from KW where resolved",
    "signal_record": """select flag_date, ticker, string_agg(distinct source, ',' order by source) as sources, cast(ticker in ('U1', 'U2', 'UAA') as int) as is_tracked from (
        select dt as flag_date, ticker, 'top_akum_bandar' as source from (select dt, ticker, row_number() over (partition by dt order by coalesce(m_dn_0, 0) desc, coalesce(m_dn_3, 0) desc, ticker) as rn from M where is_unusual_volume) where rn <= 2
        union all select dt, ticker, 'dashboard_tval' from (select dt, ticker, row_number() over (partition by dt order by rn) as rank from (
          select dt, regexp_replace(ticker, '[0-9]', 'A', 'g') as ticker, row_number() over (partition by dt order by tval desc nulls last, regexp_replace(ticker, '[0-9]', 'A', 'g')) as rn from M) where rn <= 20 and length(ticker) <= 4) where rank <= 5) group by flag_date, ticker""",
    "top_akum": f"select dt, rn as rank, ticker, {_r('d0', 'dn_0')}, {_r('d3', 'dn_3')}, d0 < 0 as caution from (select dt, ticker, coalesce(m_dn_0, 0) as d0, coalesce(m_dn_3, 0) as d3, cast(row_number() over (partition by dt order by coalesce(m_dn_0, 0) desc, coalesce(m_dn_3, 0) desc, ticker) as int) as rn from M where is_unusual_volume) where rn <= 2",
    "retail_net_sell_top3": f"select dt, rn as rank, ticker, {_r('v', 'netval')} from (select dt, ticker, sum(netval) as v, cast(row_number() over (partition by dt order by sum(netval), ticker) as int) as rn from B where broker_code in ('XL', 'XC') group by dt, ticker having sum(netval) < 0) where rn <= 3",
    "dashboard_top5": f"""with L as ({' union all '.join(f"select dt, '{c}' as list, k as ticker, max({c}) as value from (select *, case when length(ticker) > 2 then 'UX' else translate(ticker, '0123456789', 'ABCDEFGHIJ') end as k from M) group by dt, k" for c in _LISTS)})
        select dt, list, cast(rank as int) as rank, ticker, {_r('value', 'value')} from (select *, row_number() over (partition by dt, list order by rn) as rank from (select *, row_number() over (partition by dt, list order by value desc nulls last, ticker) as rn from L) where rn <= 20) where rank <= 5""",
    "bag_holders": f"""select ticker, cast(rn as int) as rank, broker_code, {_r('c', 'cum_lot')}, {_r('coalesce(c * 250 / nullif(c * 100, 0), 0)', 'avg_cost')} from (select *, row_number() over (partition by ticker order by c desc, broker_code) as rn from (
        select ticker, broker_code, cast(sum(cast(netval as decimal(24, 9))) as double) as c from B group by 1, 2) where c > 0) where rn <= 2""",
    "tp_sl_trades": f"select dt, ticker, {_r('ret', 'ret')} from (select dt, ticker, {_trade('3', '0.05', '0.03', 3)} as ret from AHEAD) where ret is not null",
    "limit_aware_trades": f"select dt, ticker, blocked, {_r('naive_ret', 'naive_ret')}, {_r('ret', 'ret')}, cast(hold_days as int) as hold_days from TRADES",
    "limit_aware_report": f"""select * from (select count(*) as n_signals, count(case when blocked then 1 end) as n_entry_blocked, count(case when hold_days > 1 then 1 end) as n_exit_delayed, {_r('avg(hold_days)', 'mean_hold_days')} from TRADES),
        (select {_sharpe('naive_ret').replace(' as ', ' as naive_')} from TRADES), (select {_sharpe('ret').replace(' as ', ' as adjusted_')} from TRADES)""",
    "strategy_grid": "select * from GRID",
    "strategy_winner": """select b.variant, b.search_sharpe, b.search_n, h.sharpe as holdout_sharpe, h.n_trades as holdout_n from (select variant, sharpe as search_sharpe, n_trades as search_n from GRID where part = 'search' order by sharpe desc nulls last, variant limit 1) b
        left join GRID h on h.part = 'holdout' and h.variant = b.variant""",
    "search_holdout_split": "select part, min(dt) as first_dt, max(dt) as last_dt, count(distinct dt) as n_dates from (select dt, case when pos <= floor((select max(pos) from PAX) * cast(0.7 as double)) then 'search' else 'holdout' end as part from P join PAX using (dt)) group by part",
    "walk_forward_folds": "select cast(cycle as int) as cycle, cast(train_hi as int) as train_hi, cast(test_lo as int) as test_lo, cast(test_hi as int) as test_hi from FOLDS",
    "walk_forward_linear": f"select cast(cycle as int) as cycle, dt, ticker, {_r('pred', 'pred')}, {_r('actual', 'actual')} from WF",
    "walk_forward_mae": f"select {_r('avg(m)', 'mae')}, {_r('avg(z)', 'naive_mae')} from (select cycle, avg(abs(pred - actual)) as m, avg(abs(actual)) as z from WF group by cycle)",
    "chronological_split": "select dt, ticker, row_number() over (order by dt, ticker) <= floor((select count(*) from P) * cast(0.8 as double)) as fit from P",
    "sharpe_trigger": f"select {_sharpe('a', 'stddev_samp')} from (select case when pred > 0.005 then actual end as a from PR)",
    "sharpe_returns": f"select {_sharpe('actual')} from PR where pred > 0.005",
    "kelly": f"select {_r('p', 'p')}, {_r('w', 'win')}, {_r('l', 'loss')}, {_r('case when w is null or l is null then 0 when p - (1 - p) / (w / l) <= 0 then 0 else least((p - (1 - p) / (w / l)) * 0.5, 1) end', 'kelly')} from (select count(case when actual > 0 then 1 end) / nullif(cast(count(actual) as double), 0) as p, avg(case when actual > 0 then actual end) as w, avg(case when actual < 0 then -actual end) as l from PR where pred > 0.005)",
    "mae_vs_naive": f"select {_r('avg(abs(pred - actual))', 'mae')}, {_r('avg(abs(actual))', 'naive_mae')} from PR",
    "spearman_ic": f"select {_r('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)', 'ic')}, count(*) as n from (select {_RANKED.format(c='pred')} as a, {_RANKED.format(c='actual')} as b from PR)",
    "top_decile_edge": f"""select {_r('max(cut)', 'cut')}, count(case when pred >= cut then 1 end) as n_top, {_r('avg(case when pred >= cut then case when actual > 0 then 1e0 else 0e0 end end)', 'hit')}, {_r('avg(case when pred >= cut then actual end)', 'top_ret')}, {_r('avg(actual)', 'base_ret')},
        {_r('avg(case when pred >= cut then actual end) - avg(actual)', 'edge')} from PR, (select quantile_cont(pred, 0.9) as cut from PR)""",
    "drawdown_quantiles": f"select {_r('quantile_cont(mdd_3, 0.5)', 'median_dd')}, {_r('quantile_cont(mdd_3, 0.25)', 'p25_dd')} from MDD",
    "welch_test_stats": WELCH,
    "target_shape": f"select count(*) as n, {_r('avg(case when target is null then 1e0 else 0e0 end)', 'missing')}, {_r('avg(case when target > 0 then 1e0 when target is not null then 0e0 end)', 'base_rate')}, {_r('kurtosis(target)', 'kurtosis')} from PX",
    "zscore_normalise": f"select dt, ticker, {_z('momentum_1d')}, {_z('volume_ratio')} from PX",
    "policy_rollout": f"""with recursive T as (select ticker, cast(case when pct > 0 then 1 else 0 end as int) as act, at_ara, at_arb, coalesce(pct, 0) as r, cast(rn - 1 as int) as i, cast(count(*) over (partition by ticker) as int) as n,
            coalesce(lead(pct) over (partition by ticker order by rn), 0) as nr from LIM),
          S as (select ticker, n, -1 as i, 0 as pos, 0 as held, cast(0 as double) as reward, 0 as trades, cast(0 as double) as realized from T where i = 0 and n >= 10
            union all select ticker, n, i, f, case when f = 1 then held + 1 else 0 end, reward + case when p < 0 then p * 1.5 else p end - c * cast(0.0015 as double), trades + c, realized + p
            from (select *, cast(f <> pos as int) as c, f * case when i + 1 < n - 1 then nr else cast(0 as double) end as p from (
              select T.ticker, T.n, T.i, T.nr, S.pos, S.held, S.reward, S.trades, S.realized,
                case when w = 1 and S.pos = 0 and not T.at_ara then 1 when w = 0 and S.pos = 1 and not T.at_arb then 0 else S.pos end as f
              from S join T on T.ticker = S.ticker and T.i = S.i + 1 and T.i <= T.n - 2, lateral (select case when S.pos = 1 and S.held >= 7 then 0 else T.act end as w))))
        select ticker, cast(n - 1 as int) as steps, {_r('reward', 'reward')}, trades, {_r('realized', 'realized')} from S where i = n - 2""",
    "cleaned_codes": "select dt, ticker, replace(ticker, '#', '') as code, cast(dt - interval 3 day as date) as three_days_before from P",
    "failed_runs": "select dt, failed, total, total <= 0 or failed > 0.3 * total as fails from (select dt, count(case when clean_score is null or clean_score <= 1 then 1 end) as failed, count(*) as total from M group by dt)",
    "feature_ablation": ABLATION,
    "horizon_walk_forward": SCANNED,
    "top_drivers": """select dt, ticker, string_agg(name, ',' order by rn) as drivers from (select dt, ticker, name, row_number() over (partition by dt, ticker order by abs(value) desc nulls last, name) as rn from
        (select dt, ticker, unnest(['smart_money_net', 'retail_net', 'absorber_net', 'tod_divergence']) as name, unnest([smart_money_net, retail_net, absorber_net, tod_divergence]) as value from SMART)) where rn <= 2 group by dt, ticker""",
    "liquid_screen": "select dt, ticker from M where tval >= 100 and not coalesce(clean_score <= 1, false) and not coalesce(is_unusual_volume, false)",
    "cross_source_verdict": f"""with J as (select o, count(*) as n, avg(case when abs(b.close / a.close - 1) <= 0.001 then 1e0 else 0e0 end) as g from MS a, (select unnest([0, 1, 2]) as o), M b
        where b.dt = a.dt - cast(o as int) and b.ticker = a.ticker and a.close > 0 and b.close > 0 group by o), T as (select * from J where n >= 15 order by g desc, o limit 1)
        select 'cross_source' as "check", g >= 0.85 as ok, 'agreement' as metric, {_r('g', 'value')}, cast(0.85 as double) as limit_value, concat('pairs: ', n) as detail from T
        union all select 'cross_source', o = 1, 'day_offset', cast(o as double), cast(1 as double), 'days between the captures' from T""",
    "cross_source_worst": f"select dt, ticker, {_r('d', 'differs')} from (select b.dt, b.ticker, abs(b.close / a.close - 1) as d from MS a join M b on b.dt = a.dt - 1 and b.ticker = a.ticker where a.close > 0 and b.close > 0 order by d desc, b.dt, b.ticker limit 4)",
    "capture_verdict": f"""with H as (select min(dt) as a, max(dt) as z, count(distinct dt) as days from M), L as (select M.* from M, H where dt = z),
        V as (select cast(count(*) as double) as n, cast(count(case when not regexp_full_match(ticker, '[A-Za-z]{{1,4}}') then 1 end) as double) as junk from L),
        N as (select cast(count(*) as double) as n, cast(count(case when flag_date = z then 1 end) as double) as l, cast(count(case when flag_date = z and not exists (select 1 from L where L.ticker = G.ticker) then 1 end) as double) as o from G, H where flag_date >= a),
        K as (select floor(N.n + N.n / greatest(days, 1) * {_WEEK.format(a="date '2024-02-01'", b="date '2024-03-01'")}) as p, cast({_WEEK.format(a="z", b="date '2024-02-01'")} as double) as age from N, H),
        R as (select age <= 2 as ok, 'stale_weekdays' as metric, age as value, 2.0 as lim, 'weekdays since the newest day' as detail from K union all select n between 80 and 400, 'rows', n, 80, '80 to 400' from V
          union all select junk = 0, 'junk_codes', junk, 0, 'codes that are no equity' from V union all select l > 0, 'signals_logged', l, 1, 'signals of the newest day' from N
          union all select o = 0, 'signals_outside', o, 0, 'signals of names that were not captured' from N union all select p >= 100, 'projected_signals', p, 100, 'by 2024-03-01 at the rate so far' from K
          {' '.join(f"union all select coalesce(s >= 0.9, false), 'share:{c}', round(s, 6) + 0.0, 0.9, 'share populated' from (select count({c}) / nullif(cast(count(*) as double), 0) as s from L)" for c in ("close", "high", "clean_score"))}
          union all select false, 'share:market_cap_t', null, 0.9, 'no such field' from V)
        select 'capture' as "check", ok, metric, cast(value as double) as value, cast(lim as double) as limit_value, detail from R""",
    "cross_source_skipped": """with J as (select o, count(*) as n from MS a, (select unnest([0, 1, 2]) as o), M b where a.ticker = 'U3' and a.dt < date '2024-01-09' and b.dt = a.dt - cast(o as int) and b.ticker = a.ticker and a.close > 0 and b.close > 0 group by o)
        select 'cross_source' as "check", cast(null as boolean) as ok, 'skipped' as metric, cast(coalesce(max(n), 0) as double) as value, cast(15 as double) as limit_value, 'too few pairs' as detail from J having coalesce(max(n), 0) < 15""",
    "event_payloads": f"""select dt, ticker, max(case when rn = 1 then event_type end) as first_type, {_r('max(case when rn = 1 then value end)', 'first_value')}, max(case when rn = 3 then event_type end) as third_type,
        nullif(count(case when event_type = 'purchase' then 1 end), 0) as purchases, nullif(count(case when event_type = 'view' then 1 end), 0) as views, cast(null as bigint) as absent
      from (select *, row_number() over (partition by dt, ticker order by event_id) as rn from (select cast(ts as date) as dt, concat('U', cast(user_id as varchar)) as ticker, event_id, event_type, value from events)) group by dt, ticker""",
    "variants_report": """with T as (select variant from GRID where part = 'search' order by sharpe desc nulls last, variant limit 1)
        select coalesce(a.variant, b.variant) as variant, a.sharpe as search_sharpe, a.n_trades as search_n, a.hit_rate as search_hit, b.sharpe as holdout_sharpe, b.n_trades as holdout_n, b.hit_rate as holdout_hit,
          T.variant is not null as won, T.variant is not null and coalesce(b.sharpe >= 1, false) as satisfied
        from (select * from GRID where part = 'search') a full join (select * from GRID where part = 'holdout') b on a.variant = b.variant left join T on T.variant = coalesce(a.variant, b.variant)""",
    "line_report": f"""select e.*, s.*, r.* from (select count(distinct dt) as n_dates, count(distinct ticker) as n_tickers, min(dt) as first_dt, max(dt) as last_dt from PANEL) e, (select {_sharpe("case when pred > 0.005 then actual end", "stddev_samp")} from WF) s,
        (select coalesce(string_agg(line, '; ' order by line), '') as recent_trades from (select printf('%s %s %+.4f %+.4f', cast(dt as varchar), ticker, pred, actual) as line from WF where pred > 0.005 order by dt desc, ticker desc limit 5)) r""",
    "cross_source_offset": f"""with J as (select cast(o as int) as day_offset, count(*) as n, avg(case when abs(b.close / a.close - 1) <= 0.001 then 1e0 else 0e0 end) as agreement from MS a, (select unnest([0, 1, 2]) as o), M b
        where b.dt = a.dt - cast(o as int) and b.ticker = a.ticker and a.close > 0 and b.close > 0 group by o)
        select day_offset, n, {_r('agreement', 'agreement')}, day_offset = (select day_offset from J where n >= 15 order by agreement desc, day_offset limit 1) as is_best from J""",
    "coverage_regression": f"""with D as (select distinct dt from M order by dt desc limit 10), S as ({' union all '.join(f"select '{c}' as field, dt, count({c}) / cast(count(*) as double) as s from M where dt in (select dt from D) group by dt" for c in _COVERED)})
        select field, {_r('l', 'latest_share')}, {_r('b', 'baseline_share')}, n as baseline_days, coalesce(n >= 2 and b >= 0.9 and l < 0.9, false) as regressed from (select field, max(case when dt = (select max(dt) from D) then s end) as l, avg(case when dt < (select max(dt) from D) then s end) as b, count(case when dt < (select max(dt) from D) then 1 end) as n from S group by field)""",
    "freshness": f"select table_name, latest, k as stale_weekdays, k <= 2 as ok from (select *, {_WEEK.format(a='latest', b=chr(100) + 'ate ' + chr(39) + '2024-02-01' + chr(39))} as k from (select 'prices' as table_name, max(dt) as latest from P union all select 'summary', max(dt) from M union all select 'flow', max(dt) from B))",
    "value_sanity": "select dt, ticker from M where dt in (select distinct dt from M order by dt desc limit 10) and (close is null or close <= 0 or m_dn_0 < -40 or high < low)",
    "capture_shape": "select dt, count(*) as n_rows, count(case when not regexp_full_match(ticker, '[A-Za-z]{1,4}') then 1 end) as n_junk, count(*) between 80 and 400 as ok from M where dt = (select max(dt) from M) group by dt",
    "signals_measurable": "select flag_date, ticker from G g where flag_date = (select max(flag_date) from G) and not exists (select 1 from M m where m.clean_score is not null and m.close is not null and m.dt = g.flag_date and m.ticker = g.ticker)",
    "signal_projection": f"select s as signals, d as days, k as weekdays_left, cast(floor(s + s / cast(greatest(d, 1) as double) * k) as bigint) as projected from (select (select count(*) from G where flag_date >= (select min(dt) from M)) as s, (select count(distinct dt) from M) as d, {_WEEK.format(a=chr(100) + 'ate ' + chr(39) + '2024-02-01' + chr(39), b=chr(100) + 'ate ' + chr(39) + '2024-03-01' + chr(39))} as k)",
    "new_contamination": "select dt, ticker, reasons from AUD where suspect and dt >= date '1998-06-01' and dt in (select distinct dt from PD order by dt desc limit 12)",
    "panel_invariants": """with A as (select cast(count(*) as double) as rows, cast(count(distinct dt) as double) as dates, cast(count(distinct ticker) as double) as tickers,
          greatest({}) as worst_missing, cast(count(case when target > 0.355 or target < -0.155 then 1 end) as double) as impossible_targets from PANEL)
        select metric, round(value, 6) + 0.0 as value, cast(l as double) as limit_value, case when up then value >= l else value <= l end as ok from (
          select 'rows' as metric, rows as value, 5000.0 as l, true as up from A union all select 'dates', dates, 150.0, true from A union all select 'tickers', tickers, 30.0, true from A
          union all select 'worst_missing', worst_missing, 0.15, false from A union all select 'impossible_targets', impossible_targets, 82.0, false from A)""".format(
        ", ".join(f"avg(case when {c} is null then 1e0 else 0e0 end)" for c in ("broker_concentration", "net_buy_ratio", "broker_correlation_1d", "momentum_1d", "volume_ratio"))
    ),
    "backfill_progress": "select ticker, count(distinct dt) as days, greatest(80 - count(distinct dt), 0) as pending from B group by ticker",
    "backfill_netval": f"""select t.dt, t.ticker, t.broker_code, {_r('lots * 100 * p.close / 1e9', 'netval')} from (select dt, ticker, broker_code, c - lag(c) over (partition by ticker, broker_code order by dt) as lots from (
        select dt, ticker, broker_code, cast(sum(cast(netval as decimal(24, 9))) over (partition by ticker, broker_code order by dt) as double) as c from B)) t join P p using (dt, ticker) where lots is not null and t.dt <= date '1996-12-31' and p.close is not null""",
    "latest_wins_upsert": f"select dt, ticker, {_r('close', 'close')} from PD where month(dt) = 6 union all select dt, ticker, {_r('close', 'close')} from P p where not exists (select 1 from PD d where month(d.dt) = 6 and d.dt = p.dt and d.ticker = p.ticker)",
    "parse_scalars": f"""select dt as d1, cast(e as date) as d2, ticker, case k % 4 when 0 then -r when 1 then r else cast(0 as double) end + 0.0 as num,
        round(case when k % 7 = 0 then 0 else cast(format('{{:.2f}}', close / 100) as double) * [1e12, 1e9, 1e6, 1e3, 1.0][k % 5 + 1] end, 6) + 0.0 as rupiah,
        case when l >= 1e6 then printf('%.2fM lot', l / 1e6) when l >= 1e3 then printf('%.0fk lot', l / 1e3) else printf('%.0f lot', l) end as lot, 2 + k % 5 <= 4 as equity, case when k % 3 < 2 then substr(code, 1, 4) end as code_in_title,
        case when close < 200 then 0.35e0 when close <= 5000 then 0.25e0 else 0.2e0 end as ara, cast({_WEEK.format(a='dt', b='cast(e as date)')} as bigint) as weekdays
      from (select *, k * pow(10, k % 4) + 7 as l, dt + cast(k % 45 as int) - 5 as e, cast(format('{{:.2f}}', close) as double) as r from (select *, cast(volume as bigint) as k, reverse(upper(translate(ticker, '0123456789#', 'ABCDEFGHIJK'))) as code from P))""",
    "feature_correlation": " union all ".join(f"select '{c}' as feature, {_r(f'covar_pop({c}, target) / nullif(stddev_pop(case when target is not null then {c} end) * stddev_pop(case when {c} is not null then target end), 0)', 'r')} from PANEL" for c in ("broker_concentration", "net_flow_total", "n_brokers", "net_buy_ratio", "momentum_1d", "volume_ratio")),
}


#: Blocks of a ticker's rows give what whole histories give.
SELECTS |= {"price_features_blocks": SELECTS["price_features_target"], "rolling_features_blocks": SELECTS["rolling_broker_features"]}


def oracle_sql() -> dict[str, str]:
    views = duckdb_views() | VIEWS
    head = ", ".join(f"{k} as ({v})" for k, v in views.items())
    fine = {k: s.replace(", 6) + 0.0", ", 10) + 0.0") if k in EXACT else s for k, s in SELECTS.items()}
    return {k: f"with {head} select * from ({s})" for k, s in fine.items()}
