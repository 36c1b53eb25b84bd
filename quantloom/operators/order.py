"""Exact ranks and quantiles without a task that holds all values.

Equal values are one row first. The distinct values of a group are then dealt to bins
whose borders are values of the group itself, drawn by hash: about one in ``EACH``, so
bins grow in number, not in size, with the data, and any two readings of the plan draw
the same ones. Each bin is counted by itself and starts after the bins below it; the
only windows over a whole group run over its bins. Nothing runs while the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a bin, on average.
EACH = 4096


def _bin(value: Column, borders: Column) -> Column:
    """How many of the ascending borders are below the value, by halving."""
    steps = F.sequence(F.ceil(F.log2(F.size(borders) + 1.0)).cast("int"), F.lit(0), F.lit(-1))

    def take(at: Column, bit: Column) -> Column:
        to = at + F.pow(F.lit(2.0), bit).cast("int")
        return F.when((to <= F.size(borders)) & (F.try_element_at(borders, to) < value), to).otherwise(at)

    return F.when(F.size(borders) == 0, 0).otherwise(F.aggregate(steps, F.lit(0), take))


def cumulative(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, c, upto, n): every distinct value with its rows, the rows up to it and all rows of its group.

    NULL values and rows of a group with NULL keys are left out of the count and the result.
    """
    by = list(by or [])
    d = df.where(F.col(col).isNotNull()).select(*by, F.col(col).alias("value"))
    c = d.groupBy(*by, "value").agg(F.count("*").alias("c"))
    whole = c.groupBy(*by).agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.when(F.pmod(F.xxhash64("value"), F.lit(EACH)) == 0, F.col("value")))).alias("borders"))
    b = (c.join(whole, by) if by else c.join(F.broadcast(whole))).withColumn("bin", _bin(F.col("value"), F.col("borders"))).drop("borders")
    below = b.groupBy(*by, "bin").agg(F.sum("c").alias("own"))
    below = below.select(*by, "bin", (F.sum("own").over(Window.partitionBy(*by).orderBy("bin")) - F.col("own")).alias("below"))  # one row a bin
    inside = F.sum("c").over(Window.partitionBy(*by, "bin").orderBy("value"))
    return b.withColumn("inside", inside).join(below, [*by, "bin"]).select(*by, "value", "c", (F.col("below") + F.col("inside")).alias("upto"), "n")


def with_average_rank(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the rank of ``col`` over all rows (of the group), ties at their mean; rows without a value go."""
    by = list(by or [])
    r = cumulative(df, col, by).select(*by, F.col("value").alias(col), (F.col("upto") - (F.col("c") - 1) / 2.0).alias(out))
    return df.join(r, [*by, col])


def quantiles(df: DataFrame, col: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles, one column each, one row a group; no values give NULL (and, with ``by``, no row).

    The value at a fractional place lies between the two values that cover its neighbours,
    each of which is found in the running counts.
    """
    by = list(by or [])
    cum = cumulative(df, col, by)
    cols = []
    for name, q in at.items():
        place = (F.col("n") - 1) * F.lit(q)
        value = lambda k: F.max(F.when((F.col("upto") - F.col("c") < k) & (k <= F.col("upto")), F.col("value")))
        low, high = value(F.floor(place) + 1), value(F.ceil(place) + 1)
        part = F.max(place - F.floor(place))
        cols.append((low + (high - low) * part).alias(name))
    return (cum.groupBy(*by) if by else cum).agg(*cols)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
