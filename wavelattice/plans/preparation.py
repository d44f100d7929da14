"""Queries of the general preparation problems (p2 to p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.operators.anomalies import FILLERS, implausible_readings
from wavelattice.operators.grid import regular_grid
from wavelattice.operators.nested import areas_table, flatten_records, observations_table, revisions_table, series_table
from wavelattice.operators.rolling import rolling_totals
from wavelattice.operators.timestamps import estimate_zones, instants, read_times
from wavelattice.session import cut_lineage, read_table

Query = Callable[[SparkSession, str], DataFrame]
VERSIONS = ("ingested_at", "reading_id")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(read_table(spark, d, "spain_smart_meter_data"), "meter_id", "timestamp", "consumption_kwh", VERSIONS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Hours without a usable reading between a meter's first and last."""
    return _grid(spark, d).where("n_readings = 0").select(F.col("source").alias("meter_id"), F.col("step_start").alias("hour_start"))


def p2_hourly_grid(spark: SparkSession, d: str) -> DataFrame:
    """One row per meter and hour, observed, filled or marked."""
    return _grid(spark, d).select(F.col("source").alias("meter_id"), F.col("step_start").alias("hour_start"), F.round("value", 6).alias("consumption_kwh"), "n_readings", "status")


def _implausible(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(read_table(spark, d, "spain_smart_meter_data"), "reading_id", "meter_id", "timestamp", "consumption_kwh")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Spikes, stuck and impossible readings."""
    return _implausible(spark, d).select("reading_id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same with value and reasons."""
    return _implausible(spark, d).select("reading_id", F.col("source").alias("meter_id"), "value", F.array_join("why", ",").alias("why"))


def _feed_rows(spark: SparkSession, d: str, path: str = "data_morocco") -> tuple[DataFrame, Column]:
    """Rows with their dataset's configuration, and the raw time that its time_col names."""
    rows = read_table(spark, d, path)
    config = read_table(spark, d, "dataset_config").where((F.col("path") == path) & F.col("name").isNotNull())
    config = config.select(F.col("name").alias("dataset"), F.col("time_col").alias("__time_col"), F.coalesce("tz", F.lit("UTC")).alias("__tz"))
    joined = rows.join(config, "dataset")  # a small file, which Spark itself broadcasts by its size
    raw = F.coalesce(*[F.when(F.col("__time_col") == c, F.col(c)) for c, kind in rows.dtypes if kind == "string"])
    return joined, raw


def _read_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The feeds' rows with their times in parts, read once and kept, as the estimate and the result both use them."""
    rows, raw = _feed_rows(spark, d)
    read = read_times(rows.select("row_id", "dataset", "feeder", "__tz", raw.alias("__raw")), F.col("__raw"), F.col("dataset") == "newyork_vendor")
    return cut_lineage(read.select("row_id", "dataset", "feeder", "__tz", "__epoch", "__p", "__marked"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every row whose time denotes one; unzoned times by the offset history that order and declaration settle."""
    read = _read_feeds(spark, d)
    return instants(read, "row_id", "__tz", estimate_zones(read, "dataset", "row_id", ["feeder"], "__tz"), "dataset")


def p4_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Each feed's offset history as its own sequence order tells it, beside the declared one."""
    return estimate_zones(_read_feeds(spark, d), "dataset", "row_id", ["feeder"], "__tz").withColumnRenamed("feed", "dataset")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    out = rolling_totals(read_table(spark, d, "spain_smart_meter_data"), "meter_id", "timestamp", "consumption_kwh", VERSIONS)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    return out.withColumn("cal_day", day).withColumnRenamed("source", "meter_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days whose trailing window holds no usable reading."""
    return _rolling(spark, d).where("n_readings = 0").select("meter_id", "cal_day", "window_days")


def p5_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    """Trailing totals and means of 7 and 30 days for every calendar day."""
    return _rolling(spark, d).select("meter_id", "cal_day", "window_days", F.round("total", 4).alias("total_kwh"), F.round("mean_per_day", 4).alias("mean_kwh_per_day"), "n_readings")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(read_table(spark, d, "elec"), "record_id", "record")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child of every series with the series that holds it."""
    child = F.when(F.col("table_name") == "series", F.size("dewey") > 1).otherwise(F.col("table_name").isNotNull())
    return _nodes(spark, d).where(child).select("record_id", F.coalesce("series_id", F.lit("")).alias("series_id"), F.col("table_name").alias("child_kind"), F.col("pos").alias("child_pos"), F.col("key").alias("child_key"))


def _path(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".").alias(c)


def _table(nodes: DataFrame) -> DataFrame:
    """A flat table with printed labels; what has no column of its own is left to ``p6_further``."""
    return nodes.withColumns({"dewey": _path("dewey"), "parent": _path("parent")}).drop("extra_json")


def p6_series(spark: SparkSession, d: str) -> DataFrame:
    return _table(series_table(_nodes(spark, d)))


def p6_observations(spark: SparkSession, d: str) -> DataFrame:
    return _table(observations_table(_nodes(spark, d))).withColumn("value_text", F.when(F.col("value").isNull(), F.col("value_text")))


def p6_revisions(spark: SparkSession, d: str) -> DataFrame:
    return _table(revisions_table(_nodes(spark, d))).withColumn("value_text", F.when(F.col("value").isNull(), F.col("value_text")))


def p6_areas(spark: SparkSession, d: str) -> DataFrame:
    return _table(areas_table(_nodes(spark, d)))


def p6_further(spark: SparkSession, d: str) -> DataFrame:
    """Members without a column of their own, of all nodes."""
    n = _nodes(spark, d).where("extra is not null")
    return n.select("record_id", _path("dewey"), _path("parent"), "path", F.coalesce("table_name", F.lit("other")).alias("table_name"), "extra")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p2_found, p2_hourly_grid, p3_found, p3_reasons, p4_found, p4_zone_estimates, p5_found, p5_rolling_totals,
        p6_found, p6_series, p6_observations, p6_revisions, p6_areas, p6_further,
    )
}

_USABLE = """usable as (
  select reading_id, meter_id, "timestamp" ts, consumption_kwh v, ingested_at from spain_smart_meter_data
  where meter_id is not null and "timestamp" is not null and consumption_kwh is not null and not isnan(consumption_kwh)),
latest as (
  select meter_id, ts, v from usable
  qualify row_number() over (partition by meter_id, ts order by ingested_at desc nulls last, reading_id desc) = 1)"""

_HOURS = """hours as (
  select meter_id, epoch_us(ts) // 3600000000 h, avg(v) v, count(*) n from latest group by 1, 2),
spans as (
  select meter_id, h, v, n, lead(h) over (partition by meter_id order by h) h2, lead(v) over (partition by meter_id order by h) v2 from hours),
cells as (
  select meter_id, h, v, n, h2, v2, unnest(range(h, coalesce(h2, h + 1))) c from spans)"""

_ELEC = """with recursive valid as (select record_id, cast(record as json) as j from elec where record_id is not null and record is not null and json_valid(record)),
tops as (select record_id, unnest(a) as s, unnest(range(0, len(a))) as i from (select record_id, case when json_type(j) = 'OBJECT' and json_type(j, '$.series') = 'ARRAY' and json_type(j, '$.data') is null then json_extract(j, '$.series[*]')
  when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end as a from valid)),
tree(record_id, s, sid, holder, pos, dewey, parent) as (
  select record_id, s, coalesce(json_extract_string(s, '$.series_id'), ''), cast(null as varchar), cast(i as bigint), cast(i as varchar), cast(null as varchar) from tops
    where json_type(s) = 'OBJECT' and len(list_intersect(json_keys(s), ['series_id', 'name', 'data', 'children', 'geography', 'units'])) > 0
  union all
  select record_id, c, coalesce(json_extract_string(c, '$.series_id'), ''), sid, cast(k - 1 as bigint), dewey || '.2.' || (k - 1), dewey from (
    select record_id, sid, dewey, unnest(json_extract(s, '$.children[*]')) as c, unnest(range(1, len(json_extract(s, '$.children[*]')) + 1)) as k from tree)
    where json_type(c) = 'OBJECT' and c::varchar <> '{}'),
held as (select record_id, sid, dewey, case when json_type(s, '$.data') = 'VARCHAR' then case when json_valid(json_extract_string(s, '$.data')) then cast(json_extract_string(s, '$.data') as json) end else json_extract(s, '$.data') end as d, s from tree),
obs as (select record_id, sid, dewey, unnest(json_extract(d, '$[*]')) as o, unnest(range(0, len(json_extract(d, '$[*]')))) as pos from held where json_type(d) = 'ARRAY'),
revs as (select record_id, sid, dewey, pos, unnest(json_extract(o, '$.revisions[*]')) as v, unnest(range(0, len(json_extract(o, '$.revisions[*]')))) as j from obs where json_type(o) = 'OBJECT'),
geo as (select record_id, sid, dewey, unnest(case when json_type(s, '$.geography') = 'ARRAY' then json_extract(s, '$.geography[*]') else [json_extract(s, '$.geography')] end) as g,
  unnest(range(0, case when json_type(s, '$.geography') = 'ARRAY' then len(json_extract(s, '$.geography[*]')) else 1 end)) as pos from held),
codes as (select record_id, sid, dewey, pos, g, case when json_type(g) = 'OBJECT' then json_extract_string(g, '$.code') else json_extract_string(g, '$') end as code from geo where g is not null),
periods as (select record_id, sid, dewey, pos, o, case when json_type(o) = 'OBJECT' then json_extract_string(o, '$.period') else json_extract_string(o, '$[0]') end as period from obs)"""


def _words(place: str) -> str:
    """Text of a scalar, null where it is blank or no scalar."""
    return f"case when json_type({place}) not in ('OBJECT', 'ARRAY', 'NULL') then nullif(case when trim(json_extract_string({place})) <> '' then json_extract_string({place}) else '' end, '') end"


def _number(v: str) -> str:
    return f"case when json_type({v}) in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') or (json_type({v}) = 'VARCHAR' and regexp_full_match(json_extract_string({v}, '$'), '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')) then try_cast(trim(json_extract_string({v}, '$')) as double) end"


_ODD = f"""with {_USABLE},
      fill as (select unnest([{', '.join(map(repr, FILLERS))}]) as f),
      bad as (select reading_id from usable where v < 0 or isinf(v) or v in (select f from fill)),
      pos as (select reading_id, meter_id, ln(v) as y from usable where v > 0 and reading_id not in (select reading_id from bad)),
      ranked as (select *, row_number() over w as k, count(*) over (partition by meter_id) as n, y - lag(y) over w as gap from pos window w as (partition by meter_id order by y, reading_id)),
      hi as (select meter_id, min(y) as hi from ranked where n >= 7 and gap >= ln(3) and k > n - greatest(1, floor(n * 0.1)) group by 1),
      lo as (select meter_id, max(y) as lo from (select *, lead(y) over (partition by meter_id order by y, reading_id) - y as up from ranked) where n >= 7 and up >= ln(3) and k <= greatest(1, floor(n * 0.1)) group by 1),
      firsts as (select meter_id, ts, arg_min(v, reading_id) as v from usable where reading_id not in (select reading_id from bad) group by 1, 2),
      marks as (select *, case when v is distinct from lag(v) over (partition by meter_id order by ts) then 1 else 0 end as c from firsts),
      runs as (select meter_id, g, any_value(v) as v, count(*) as n, min(ts) as a, max(ts) as b from (select *, sum(c) over (partition by meter_id order by ts) as g from marks) group by 1, 2),
      long as (select * from runs where v > 0 and n >= 12 and meter_id in (select meter_id from runs where n < 12 group by 1 having count(*) >= 5))"""

ORACLES: dict[str, str] = {
    "p2_found": f"with {_USABLE}, {_HOURS} select meter_id, cast(c * 3600 as bigint) hour_start from cells where c <> h",
    "p2_hourly_grid": f"""with {_USABLE}, {_HOURS}
      select meter_id, cast(c * 3600 as bigint) hour_start,
        round(case when c = h then v when h2 - h - 1 <= 3 then v + (v2 - v) * (c - h) / (h2 - h) end, 6) consumption_kwh,
        cast(case when c = h then n else 0 end as bigint) n_readings,
        case when c = h then 'observed' when h2 - h - 1 <= 3 then 'filled' else 'missing' end status
      from cells""",
    "p5_found": f"""with {_USABLE},
      days as (select meter_id, cast(ts as date) d, count(*) n from latest group by 1, 2),
      cal as (select meter_id, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) d from days group by 1),
      full_cal as (select c.meter_id, c.d, coalesce(n, 0) n from cal c left join days using (meter_id, d)),
      framed as (
        select meter_id, d, 7 w, sum(n) over (partition by meter_id order by d range between interval 6 day preceding and current row) k from full_cal
        union all
        select meter_id, d, 30 w, sum(n) over (partition by meter_id order by d range between interval 29 day preceding and current row) k from full_cal)
      select meter_id, strftime(d, '%Y-%m-%d') cal_day, cast(w as bigint) window_days from framed where k = 0""",
    "p5_rolling_totals": f"""with {_USABLE},
      days as (select meter_id, cast(ts as date) d, sum(v) v, count(*) n from latest group by 1, 2),
      cal as (select meter_id, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) d from days group by 1),
      full_cal as (select c.meter_id, c.d, coalesce(v, 0) v, coalesce(n, 0) n from cal c left join days using (meter_id, d)),
      framed as (
        select a.meter_id, a.d, w.w, sum(b.v) total, sum(b.n) n
        from full_cal a cross join (values (7), (30)) w(w) join full_cal b on b.meter_id = a.meter_id and b.d between a.d - cast(w.w - 1 as integer) and a.d
        group by 1, 2, 3)
      select meter_id, strftime(d, '%Y-%m-%d') cal_day, cast(w as bigint) window_days, round(total, 4) total_kwh,
        round(total / w, 4) mean_kwh_per_day, cast(n as bigint) n_readings from framed""",
    "p6_found": f"""{_ELEC} select record_id, holder as series_id, 'series' as child_kind, pos as child_pos, sid as child_key from tree where holder is not null
      union all select record_id, sid, 'data', pos, period from periods where period is not null and trim(period) <> ''
      union all select record_id, sid, 'revision', pos, coalesce(json_extract_string(v, '$.on'), '') from revs where json_type(v) = 'OBJECT' and v::varchar <> '{{}}'
      union all select record_id, sid, 'geography', pos, code from codes where code is not null and trim(code) <> ''""",
    "p6_series": f"""{_ELEC} select record_id, dewey, parent, sid as series_id, holder as parent_series_id, pos, {_words("s, '$.name'")} as name, {_words("s, '$.units'")} as units, {_words("s, '$.f'")} as freq from tree""",
    "p6_observations": f"""{_ELEC} select record_id, dewey || '.0.' || pos as dewey, dewey as parent, sid as series_id, pos, period, {_number('v')} as value,
      case when {_number('v')} is null then {_words("v, '$'")} end as value_text
      from (select *, case when json_type(o) = 'OBJECT' then json_extract(o, '$.value') else json_extract(o, '$[1]') end as v from periods) where period is not null and trim(period) <> ''""",
    "p6_revisions": f"""{_ELEC} select record_id, dewey || '.0.' || pos || '.0.' || j as dewey, dewey || '.0.' || pos as parent, sid as series_id, pos, coalesce(json_extract_string(v, '$.on'), '') as revised_on,
      {_number("json_extract(v, '$.value')")} as value, case when {_number("json_extract(v, '$.value')")} is null then {_words("v, '$.value'")} end as value_text
      from revs where json_type(v) = 'OBJECT' and v::varchar <> '{{}}'""",
    "p6_areas": f"""{_ELEC} select record_id, dewey || '.1.' || pos as dewey, dewey as parent, sid as series_id, pos, code, case when json_type(g) = 'OBJECT' then {_number("json_extract(g, '$.share')")} end as share
      from codes where code is not null and trim(code) <> ''""",
    "p4_found": """with cfg as (select name, time_col, coalesce(tz, 'UTC') as tz from dataset_config where path = 'data_morocco'),
      raw as (select row_id, dataset, tz, regexp_replace(case time_col when 'datetime' then datetime when 'logged_at' then logged_at end, '^[\\s\u00a0"]+|[\\s\u00a0"]+$', '', 'g') as t from data_morocco join cfg on cfg.name = dataset),
      cut as (select *, regexp_extract(t, '(Z|[+-]\\d\\d:?\\d\\d|CEST|CET|WEST|WET|EDT|EST|GMT)(\\[.*\\])?$', 1) as z, regexp_matches(t, '^\\d+$') as digits from raw where t is not null),
      words as (select *, replace(regexp_replace(regexp_replace(regexp_replace(case when z = '' then t else regexp_replace(t, '\\s*(Z|[+-]\\d\\d:?\\d\\d|CEST|CET|WEST|WET|EDT|EST|GMT)(\\[.*\\])?$', '') end,
        '^[A-Z][a-z]{2}, (\\d)', '\\1'), '(\\d\\d)h(\\d\\d)$', '\\1:\\2'), '(\\d),(\\d{3})$', '\\1.\\2'), '.,', '.') as w from cut),
      names as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w,
        '(janv|ene)\\.?', 'Jan', 'i'), '(févr|feb)\\.?', 'Feb', 'i'), '(mars|mar)\\.?', 'Mar', 'i'), '(avr|abr)\\.?', 'Apr', 'i'), '(mai|may)\\.?', 'May', 'i'), '(juin|jun)\\.?', 'Jun', 'i'), '(juil|jul)\\.?', 'Jul', 'i'),
        '(août|ago)\\.?', 'Aug', 'i'), '(sept|sep)\\.?', 'Sep', 'i'), '(oct)\\.?', 'Oct', 'i'), '(nov)\\.?', 'Nov', 'i'), '(déc|dic|dec)\\.?', 'Dec', 'i') as b from words),
      parsed as (select *, case when dataset = 'newyork_vendor' then try_strptime(replace(b, ' 24:00', ' 00:00'), ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%b %d, %Y %H:%M:%S', '%Y-%m-%d'])
        else try_strptime(replace(b, ' 24:00', ' 00:00'), ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%y %H:%M:%S', '%d.%m.%Y %H:%M:%S', '%d-%b-%Y %H:%M', '%d %b %Y %H:%M:%S', '%d %b %Y %H:%M', '%d %b %Y, %H:%M:%S', '%Y%m%dT%H%M', '%Y-%m-%d']) end
        + case when b like '% 24:00' then interval 1 day else interval 0 day end as local from names where not digits),
      zoned as (select row_id, local, case z when 'Z' then 0 when 'GMT' then 0 when 'CEST' then 120 when 'CET' then 60 when 'WEST' then 60 when 'WET' then 0 when 'EDT' then -240 when 'EST' then -300
        else case when z <> '' then (case when z[1] = '-' then -1 else 1 end) * (cast(z[2:3] as int) * 60 + cast(right(z, 2) as int)) end end as off, timezone(tz, local) as u, tz from parsed where local is not null),
      stamps as (select row_id, case when length(t) = 14 then null when length(t) = 10 then cast(t as bigint) * 1000000 when length(t) = 13 then cast(t as bigint) * 1000 when length(t) = 16 then cast(t as bigint) end as us from cut where digits),
      spelled as (select row_id, timezone(tz, try_strptime(t, '%Y%m%d%H%M%S')) as u, tz, try_strptime(t, '%Y%m%d%H%M%S') as local from cut where digits and length(t) = 14)
      select row_id, us as utc_us from stamps where us is not null
      union all select row_id, epoch_us(case when timezone(tz, u - interval 1 hour) = local then u - interval 1 hour else u end) from spelled where u is not null
      union all select row_id, case when off is not null then epoch_us(local) - cast(off as bigint) * 60000000 else epoch_us(case when timezone(tz, u - interval 1 hour) = local then u - interval 1 hour else u end) end from zoned""",
    # The rule that the limits come down to on these tables: wide gaps in the outer tenth, long runs, impossible values.
    "p3_found": f"""{_ODD}
      select reading_id from bad union select reading_id from pos join hi using (meter_id) where y >= hi union select reading_id from pos join lo using (meter_id) where y <= lo
      union select u.reading_id from usable u join long l on u.meter_id = l.meter_id and u.ts between l.a and l.b and u.v = l.v""",
    "p3_reasons": f"""{_ODD}, odd as (select reading_id, 1 as k, 'impossible' as why from bad union select reading_id, 2, 'spike' from pos join hi using (meter_id) where y >= hi union select reading_id, 2, 'spike' from pos join lo using (meter_id) where y <= lo
        union select u.reading_id, 3, 'stuck' from usable u join long l on u.meter_id = l.meter_id and u.ts between l.a and l.b and u.v = l.v)
      select u.reading_id, u.meter_id, u.v as value, string_agg(why, ',' order by k) as why from odd join usable u using (reading_id) group by 1, 2, 3""",
}
