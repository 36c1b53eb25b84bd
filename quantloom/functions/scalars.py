"""Scalar functions as column expressions. Missing values are NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ARA_TIERS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b) -> Column:
    """a / b, or NULL where b is zero."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0.0)))


def simple_return(price, base) -> Column:
    return ratio(_c(price) - _c(base), base)


def parse_num(s) -> Column:
    """Number with thousands commas and accounting parentheses; anything else is 0."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(s), ",", ""), r"\(", "-"), r"\)", ""))
    n = plain.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def parse_rupiah(s) -> Column:
    """'Rp 1.66Trl' and the like: Trl 1e12, Mlr 1e9, jt 1e6, rb 1e3; anything else is 0."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(_c(s), "Rp", ""), ",", ""))
    unit = F.regexp_extract(plain, "(Trl|Mlr|jt|rb)$", 1)
    times = F.when(unit == "Trl", 1e12).when(unit == "Mlr", 1e9).when(unit == "jt", 1e6).when(unit == "rb", 1e3).otherwise(1.0)
    return F.coalesce(F.trim(F.regexp_replace(plain, "(Trl|Mlr|jt|rb)$", "")).try_cast("double") * times, F.lit(0.0))


def format_lot(v) -> Column:
    v = _c(v)
    return F.when(v.isNull(), F.lit(None)).when(F.abs(v) >= 1e6, F.format_string("%.2fM lot", v / 1e6)).when(F.abs(v) >= 1e3, F.format_string("%.0fk lot", v / 1e3)).otherwise(F.format_string("%.0f lot", v))


def truthy(v) -> Column:
    return F.coalesce(F.lower(F.trim(_c(v).cast("string"))).isin("true", "v", "1"), F.lit(False))


def is_equity_code(s) -> Column:
    """Letters only, four at most."""
    return F.coalesce(_c(s).rlike(r"^\p{L}{1,4}$"), F.lit(False))


def clean_code(s) -> Column:
    return F.regexp_replace(_c(s), r"(?U)[^\w]", "")


def ticker_from_title(s) -> Column:
    return F.nullif(F.regexp_extract(_c(s), r"\b([A-Z]{4})\b", 1), F.lit(""))


def series_signature(x, close) -> Column:
    """(n, first and last three dates, first and last three closes), NULL for an empty series."""
    x, close = _c(x), _c(close)
    last = lambda a: F.slice(a, F.greatest(F.size(a) - 2, F.lit(1)), F.lit(3))
    sig = F.struct(F.size(x).alias("n"), F.slice(x, 1, 3).alias("x_head"), last(x).alias("x_tail"), F.slice(close, 1, 3).alias("c_head"), last(close).alias("c_tail"))
    return F.when(F.size(F.coalesce(x, F.array())) > 0, sig)


def ara_bound(prev_close) -> Column:
    p = _c(prev_close)
    (low, a), (mid, b), (_, c) = ARA_TIERS
    return F.when(p < low, a).when(p <= mid, b).when(p.isNotNull(), c)


def reasons(**flags) -> Column:
    """Names of the flags that hold, joined by '+'."""
    return F.concat_ws("+", *[F.when(_c(v), F.lit(k)) for k, v in flags.items()])


def shift_date(d, days: int) -> Column:
    return F.date_sub(_c(d), days)


def weekdays_between(d1, d2) -> Column:
    """Weekdays in (d1, d2]; 0 where d2 is not after d1."""
    d1, d2 = _c(d1), _c(d2)
    days = F.filter(F.sequence(F.date_add(d1, 1), d2), lambda d: F.weekday(d) < 5)
    return F.when(d2 > d1, F.size(days)).otherwise(0)


def kelly_fraction(p, win, loss, cap: float = 0.5) -> Column:
    """Share to stake; invalid arguments raise."""
    p, win, loss = _c(p), _c(win), _c(loss)
    bad = (win <= 0) | (loss <= 0) | (p < 0) | (p > 1)
    f = p - (1 - p) / (win / loss)
    return F.when(bad, F.raise_error(F.lit("win and loss must be positive and p within [0, 1]")).cast("double")).when(f <= 0, 0.0).otherwise(F.least(f * cap, F.lit(1.0)))


def net_value(lots, close) -> Column:
    """Billions from lots of 100 shares."""
    return _c(lots) * 100 * _c(close) / 1e9


def average_cost(rupiah, lots) -> Column:
    return F.coalesce(ratio(rupiah, _c(lots) * 100), F.lit(0.0))


def zscore(x, mean, std, clip: float = 5.0) -> Column:
    z = (_c(x) - _c(mean)) / F.when(_c(std) == 0, 1.0).otherwise(_c(std))
    return F.coalesce(F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)), F.lit(0.0))


def should_fail_run(failed, total, rate: float = 0.30) -> Column:
    f, t = _c(failed), _c(total)
    return (t <= 0) | (F.try_divide(f, t) > rate)


def close_by_date(x, close) -> Column:
    return F.map_from_arrays(_c(x), _c(close))


def to_text(v) -> Column:
    return F.to_json(_c(v))


def lgamma(x) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series after eight steps up."""
    x = _c(x)
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    steps = F.log(x)
    for k in range(1, 8):
        steps = steps + F.log(x + float(k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def _beta_fraction(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """Continued fraction of the incomplete beta function, folded over its terms."""
    full = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    step = lambda s, k: (lambda d, c: F.struct(c.alias("c"), d.alias("d"), (s["v"] * c * d).alias("v")))(1 / full(1 + k * s["d"]), full(1 + k / s["c"]))

    def two(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # F.transform over one element names the half step, so that it is not computed thrice.
        return F.element_at(F.transform(F.array(step(s, even)), lambda h: step(h, odd)), 1)

    d = 1 / full(1 - (a + b) * x / (a + 1))
    first = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("v"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), first, two)["v"]


def t_two_sided(t, dof) -> Column:
    """Two-sided p-value of Student's t; NULL without t or degrees of freedom."""
    t, dof = _c(t).cast("double"), _c(dof).cast("double")
    x, rest = dof / (dof + t * t), t * t / (dof + t * t)
    a, b = dof / 2, F.lit(0.5)
    half = F.when(a > 1e4, 0.5 * F.log(a) - 1 / (8 * a)).otherwise(lgamma(a + 0.5) - lgamma(a))
    front = F.exp(half - 0.5 * math.log(math.pi) - a * F.log1p(t * t / dof) + 0.5 * F.log(rest))
    near = x < (a + 1) / (a + 2.5)
    p = F.when(near, front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, rest) * 2)
    return F.when(x >= 1, 1.0).when(x <= 0, 0.0).otherwise(p)
