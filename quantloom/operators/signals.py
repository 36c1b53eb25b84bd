"""Screens, recorded signals and what followed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import average_cost, is_equity_code, ratio, simple_return, truthy
from ..schema import STALKER_RETAIL, TRACKED
from .metrics import summarise
from .spine import by_ticker, date_spine, with_position


def top_akum(summary: DataFrame, n: int = 2) -> DataFrame:
    """The n names of unusual volume with most accumulation a day; ties by ticker."""
    z = F.lit(0.0)
    w = Window.partitionBy("dt").orderBy(F.coalesce("m_dn_0", z).desc(), F.coalesce("m_dn_3", z).desc(), "ticker")
    d = summary.where(truthy("is_unusual_volume")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return d.select("dt", "rank", "ticker", F.coalesce("m_dn_0", z).alias("dn_0"), F.coalesce("m_dn_3", z).alias("dn_3"), (F.coalesce("m_dn_0", z) < 0).alias("caution"))


def dashboard_top(summary: DataFrame, fields: list[str], n: int = 5, page: int = 20) -> DataFrame:
    """Per day and list, the first n real tickers of the first page by the list's field."""
    lists = F.explode(F.array(*[F.struct(F.lit(f).alias("list"), F.col(f).cast("double").alias("value")) for f in fields])).alias("l")
    d = summary.select("dt", "ticker", lists).select("dt", "ticker", "l.list", "l.value")
    w = Window.partitionBy("dt", "list").orderBy(F.desc_nulls_last("value"), "ticker")
    d = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= page).where(is_equity_code("ticker"))
    again = Window.partitionBy("dt", "list").orderBy("__rn")
    return d.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= n).select("dt", "list", "rank", "ticker", "value")


def retail_net_sells(flow: DataFrame, n: int = 3) -> DataFrame:
    """Per day the n tickers that the retail pair sold most."""
    g = flow.where(F.col("broker_code").isin(STALKER_RETAIL)).groupBy("dt", "ticker").agg(F.sum("netval").alias("netval")).where("netval < 0")
    w = Window.partitionBy("dt").orderBy("netval", "ticker")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("dt", "rank", "ticker", "netval")


def bag_holders(inventory: DataFrame, n: int = 2) -> DataFrame:
    """Per ticker the n brokers with most cumulated lots (ticker, broker_code, cum_lot, cum_rp) and their cost."""
    w = Window.partitionBy("ticker").orderBy(F.desc("cum_lot"), "broker_code")
    d = inventory.where("cum_lot > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return d.select("ticker", "rank", "broker_code", "cum_lot", average_cost("cum_rp", "cum_lot").alias("avg_cost"))


def record_signals(sections: dict[str, DataFrame], tracked=TRACKED) -> DataFrame:
    """(flag_date, ticker, sources, is_tracked) of the union of sections (dt, ticker)."""
    out = None
    for name, d in sections.items():
        s = d.where("ticker is not null and ticker <> ''").select(F.col("dt").alias("flag_date"), "ticker", F.lit(name).alias("source"))
        out = s if out is None else out.unionByName(s)
    g = out.groupBy("flag_date", "ticker").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return g.withColumn("is_tracked", F.col("ticker").isin(list(tracked)).cast("int"))


def _outcomes(panel: DataFrame, spine: DataFrame, horizons) -> DataFrame:
    """Per bar as entry: position, horizon, ret, mfe, mae in percent where every bar up to the exit is there."""
    p = with_position(panel.where("close is not null"), spine)
    cols = []
    for h in horizons:
        w = by_ticker().rowsBetween(1, h)
        ok = (F.lead("pos", h).over(by_ticker()) - F.col("pos") == h) & (F.col("close") != 0)
        pct = lambda x: 100.0 * simple_return(x, "close")
        cols.append(F.struct(F.lit(h).alias("h"), ok.alias("ok"), pct(F.lead("close", h).over(by_ticker())).alias("ret"), pct(F.max("high").over(w)).alias("mfe"), pct(F.min("low").over(w)).alias("mae")))
    d = p.select("ticker", "pos", F.array(*cols).alias("o")).select("ticker", "pos", F.explode("o").alias("o"))
    return d.where("o.ok").select("ticker", "pos", "o.h", "o.ret", "o.mfe", "o.mae")


def signal_outcomes(panel: DataFrame, signals: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """(flag_date, ticker, sources, h, ret, mfe, mae): entry at the close of the day after the flag."""
    spine = date_spine(panel.where("close is not null"))
    s = signals.join(F.broadcast(spine.withColumnRenamed("dt", "flag_date")), "flag_date").withColumn("pos", F.col("pos") + 1)
    return s.join(_outcomes(panel, spine, horizons), ["ticker", "pos"]).select("flag_date", "ticker", "sources", "h", "ret", "mfe", "mae")


def signal_by_source(outcomes: DataFrame) -> DataFrame:
    d = outcomes.withColumn("source", F.explode(F.split("sources", ","))).where("source <> ''")
    return summarise(d, ["source", "h"])


def control_outcomes(panel: DataFrame, signals: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """Outcomes of names in the panel that were not flagged that day."""
    flagged = signals.select(F.col("flag_date").alias("dt"), "ticker").distinct()
    rest = panel.where("close is not null").join(flagged, ["dt", "ticker"], "left_anti").select(F.col("dt").alias("flag_date"), "ticker", F.lit("").alias("sources"))
    return signal_outcomes(panel, rest, horizons)


def uncovered_signals(panel: DataFrame, signals: DataFrame) -> DataFrame:
    there = panel.where("close is not null").select(F.col("dt").alias("flag_date"), "ticker")
    return signals.join(there, ["flag_date", "ticker"], "left_anti")


def konglo_watch(prices: DataFrame, signals: DataFrame, days: int = 3) -> DataFrame:
    """What the next rows brought since the flag day's close; resolved after ``days`` rows."""
    w = by_ticker().rowsBetween(1, days)
    p = prices.select(
        F.col("dt").alias("flag_date"),
        "ticker",
        F.count("*").over(w).alias("days_elapsed"),
        ratio(F.last("close").over(w) - F.col("close"), "close").alias("current_pct"),
        ratio(F.max("high").over(w) - F.col("close"), "close").alias("highest_pct"),
        ratio(F.min("low").over(w) - F.col("close"), "close").alias("drawdown_pct"),
    )
    d = signals.join(p, ["flag_date", "ticker"]).where("days_elapsed > 0")
    return d.select("flag_date", "ticker", "sources", "days_elapsed", (F.col("days_elapsed") >= days).alias("resolved"), "current_pct", "highest_pct", "drawdown_pct")


def backfill_progress(flow: DataFrame, tickers: list[str] | None = None, target: int = 60) -> DataFrame:
    """Days of history of every listed ticker; none counts as 0."""
    g = flow.groupBy("ticker").agg(F.countDistinct("dt").alias("days"))
    if tickers is not None:
        names = flow.sparkSession.createDataFrame([(t,) for t in sorted(set(tickers))], "ticker string")
        g = names.join(g, "ticker", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return g.withColumn("pending", F.greatest(F.lit(target) - F.col("days"), F.lit(0)))


def backfill_netval(traces: DataFrame, prices: DataFrame, until: str | None = None) -> DataFrame:
    """Daily net value from cumulated lots (dt, ticker, broker_code, cum_lot); differences come before filters."""
    from ..functions.scalars import net_value

    w = Window.partitionBy("ticker", "broker_code").orderBy("dt")
    d = traces.withColumn("lots", F.col("cum_lot") - F.lag("cum_lot").over(w)).where("lots is not null")
    if until is not None:
        d = d.where(F.col("dt") <= F.lit(until).cast("date"))
    d = d.join(prices.where("close is not null").select("dt", "ticker", "close"), ["dt", "ticker"])
    return d.select("dt", "ticker", "broker_code", net_value("lots", "close").alias("netval"))


def liquid_screen(summary: DataFrame, liquid: str = "is_liquid", pinky: str = "is_pinky", crossing: str = "is_crossing") -> DataFrame:
    """Rows that are liquid, not on the special board and not crossed; a missing flag is false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return summary.where(flag(liquid) & ~flag(pinky) & ~flag(crossing))
