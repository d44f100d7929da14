"""What the query modules share: input series and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.operators.series import load_series, number_points
from wavelattice.session import read_table

#: Decimals that computed numbers are compared to.
DECIMALS = 8


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """All doubles rounded (and never -0.0), so that sums in different order compare equal."""
    return df.select(*[(F.round(c, decimals) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def r(expression: str, decimals: int = DECIMALS) -> str:
    """The same in SQL."""
    return f"(round({expression}, {decimals}) + 0.0)"


def user_points(spark: SparkSession, d: str) -> DataFrame:
    """events.value by user, numbered by (ts, event_id)."""
    return number_points(read_table(spark, d, "events"), "user_id", ("ts", "event_id"))


def type_days(spark: SparkSession, d: str) -> DataFrame:
    """Mean events.value by event type and day: the panel of aligned series."""
    loaded = load_series(read_table(spark, d, "events"), "ts", "value", "event_type", freq="1d")
    return number_points(loaded.withColumn("value", F.round("value", 6)))


def order_days(spark: SparkSession, d: str) -> DataFrame:
    """Total price of orders by day, one long series."""
    return number_points(load_series(read_table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="1d", agg="sum").withColumn("value", F.round("value", 2)))


POINTS = """pts as (select user_id as series_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as t, value as x
  from events where user_id is not null and value is not null and not isnan(value) and abs(value) < 'infinity'::double)"""

PANEL = """days as (select event_type as series_id, date_trunc('day', ts) as day, round(avg(value), 6) as x from events
  where event_type is not null and ts is not null and value is not null and not isnan(value) group by 1, 2),
pts as (select series_id, cast(row_number() over (partition by series_id order by day) - 1 as bigint) as t, x from days)"""

ORDERS = """days as (select date_trunc('day', o_orderdate) as day, round(sum(o_totalprice), 2) as x from orders where o_orderdate is not null and o_totalprice is not null group by 1),
pts as (select 'series' as series_id, cast(row_number() over (order by day) - 1 as bigint) as t, x from days)"""

HVG = """nsg as (select a.series_id, a.t as src, min(b.t) as dst from pts a join pts b on a.series_id = b.series_id and b.t > a.t and b.x > a.x group by 1, 2),
pge as (select b.series_id, max(a.t) as src, b.t as dst from pts a join pts b on a.series_id = b.series_id and a.t < b.t and a.x >= b.x group by b.series_id, b.t),
e as (select * from nsg union all select * from pge)"""


def nvg(limit: int | None = None, strict: bool = False) -> str:
    """Natural visibility of all pairs of a series, or of those at most ``limit`` points apart."""
    op, near = ">" if strict else ">=", "" if limit is None else f" and b.t <= a.t + {limit}"
    return f"""sl as (select a.series_id, a.t as src, b.t as dst, (b.x - a.x) / cast(b.t - a.t as double) as s
  from pts a join pts b on a.series_id = b.series_id and b.t > a.t{near}),
e as (select series_id, src, dst from (select *, max(s) over (partition by series_id, src order by dst rows between unbounded preceding and 1 preceding) as m from sl) where m is null or s {op} m)"""


DEGREES = """deg as (select p.series_id, p.t as node, count(k.v) as degree, count(case when k.w = 1 then 1 end) as in_degree, count(case when k.w = 0 then 1 end) as out_degree
  from pts p left join (select series_id, src as v, 0 as w from e union all select series_id, dst, 1 from e) k on k.series_id = p.series_id and k.v = p.t group by 1, 2)"""

SUMMARY = f"""select series_id, count(*) as n_nodes, cast(sum(out_degree) as bigint) as n_edges, {r('avg(degree)')} as avg_degree, {r('stddev_pop(degree)')} as std_degree,
  cast(min(degree) as bigint) as min_degree, cast(max(degree) as bigint) as max_degree,
  {r('case when count(*) > 1 then cast(sum(out_degree) as double) / (cast(count(*) as double) * (count(*) - 1) / 2.0) else 0.0 end')} as density from deg group by series_id"""
