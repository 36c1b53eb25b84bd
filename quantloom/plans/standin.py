"""Stand-in tables over the synthetic data; the same text runs on Spark and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..schema import BROKER_CODES

PRICES = """
with x as (
  select cast(date_trunc('month', l_shipdate) as date) as dt, p_brand as ticker,
    cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / (10 * count(*)) as c,
    cast(sum(cast(l_extendedprice as decimal(18, 2)) * (1 - cast(l_discount as decimal(4, 2)))) as double) / (10 * count(*)) as o,
    cast(sum(cast(l_tax as decimal(4, 2))) as double) / count(*) as t,
    cast(sum(cast(l_discount as decimal(4, 2))) as double) / count(*) as d,
    cast(sum(l_quantity) as double) as v
  from {lineitem} join {part} on l_partkey = p_partkey group by 1, 2)
select dt, ticker, o as open, c * (1 + t) as high, c * (1 - d) as low, c as close, v as volume from x"""
_FLOW = """
select cast(date_trunc('month', l_shipdate) as date) as dt, p_brand as ticker,
  case l_suppkey % 30 {codes} end as broker_code,
  cast(sum(case l_returnflag when 'A' then cast(l_extendedprice as decimal(18, 2)) when 'R' then -cast(l_extendedprice as decimal(18, 2))
    else (cast(l_discount as decimal(4, 2)) - 0.05) * cast(l_extendedprice as decimal(18, 2)) end) as double) / 100000 as netval
from {{lineitem}} join {{part}} on l_partkey = p_partkey group by 1, 2, 3"""
FLOW = _FLOW.format(codes=" ".join(f"when {i} then '{c}'" for i, c in enumerate(BROKER_CODES)))
#: Contaminated prices: copies of another ticker's bars, and a tenfold break.
DIRTY = """
select p.dt, p.ticker,
  case when s.dt is not null then s.open when p.ticker = 'Brand#7' and month(p.dt) = 6 then p.open * 10 else p.open end as open,
  case when s.dt is not null then s.high when p.ticker = 'Brand#7' and month(p.dt) = 6 then p.high * 10 else p.high end as high,
  case when s.dt is not null then s.low when p.ticker = 'Brand#7' and month(p.dt) = 6 then p.low * 10 else p.low end as low,
  case when s.dt is not null then s.close when p.ticker = 'Brand#7' and month(p.dt) = 6 then p.close * 10 else p.close end as close,
  case when s.dt is not null then s.volume else p.volume end as volume
from {P} p left join {P} s on p.ticker = 'Brand#14' and s.ticker = 'Brand#13' and s.dt = p.dt and month(p.dt) in (2, 5, 8, 11)"""
SUMMARY = """
select cast(ts as date) as dt, concat('U', cast(user_id as varchar(20))) as ticker,
  max_by(value, event_id) as close, max(value) as high, min(value) as low,
  cast(sum(cast(value as decimal(18, 2))) as double) as tval,
  cast(sum(cast(case event_type when 'purchase' then value when 'error' then -value else 0 end as decimal(18, 2))) as double) / count(*) as m_dn_0,
  cast(sum(cast(case event_type when 'view' then value when 'click' then -value else 0 end as decimal(18, 2))) as double) / count(*) as m_dn_3,
  count(*) >= 4 as is_unusual_volume,
  case when cast(ts as date) = date '2024-01-30' and user_id % 3 = 0 then null else count(distinct event_type) end as clean_score
from {events} group by cast(ts as date), user_id"""
SIGNAL_ROWS = """
select distinct cast(ts as date) as flag_date, concat('U', cast(user_id as varchar(20))) as ticker, event_type as source
from {events} where event_type in ('purchase', 'signup', 'click') and value >= 60"""
SCRAPE = """
select cast(dt + interval 1 day as date) as dt, ticker,
  case when cast(substr(ticker, 2) as int) % 12 = 0 then close * 1.05 else close end as close
from {M}"""


class StandIn:
    """The stand-in tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def P(self) -> DataFrame:
        return self.spark.sql(PRICES, lineitem=self.table("lineitem"), part=self.table("part"))

    @cached_property
    def B(self) -> DataFrame:
        return self.spark.sql(FLOW, lineitem=self.table("lineitem"), part=self.table("part"))

    @cached_property
    def PD(self) -> DataFrame:
        return self.spark.sql(DIRTY, P=self.P)

    @cached_property
    def M(self) -> DataFrame:
        return self.spark.sql(SUMMARY, events=self.table("events"))

    @cached_property
    def G(self) -> DataFrame:
        from pyspark.sql import functions as F

        rows = self.spark.sql(SIGNAL_ROWS, events=self.table("events"))
        return rows.groupBy("flag_date", "ticker").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))

    @cached_property
    def MS(self) -> DataFrame:
        return self.spark.sql(SCRAPE, M=self.M)


def duckdb_views() -> dict[str, str]:
    """The same tables as SQL for DuckDB, in order of dependence."""
    t = {k: k for k in ("lineitem", "part", "events", "P", "M")}
    return {
        "P": PRICES.format(**t),
        "B": FLOW.format(**t),
        "PD": DIRTY.format(**t),
        "M": SUMMARY.format(**t),
        "GR": SIGNAL_ROWS.format(**t),
        "G": "select flag_date, ticker, string_agg(source, ',' order by source) as sources from GR group by 1, 2",
        "MS": SCRAPE.format(**t),
    }
