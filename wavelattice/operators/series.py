"""Series from tables: scan, filter, resample, clean, number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = ("mean", "sum", "min", "max", "median", "first", "last")
#: Bucket words beside Polars-like durations (1h, 15m, 1d, 1w).
FREQUENCIES = {"hourly": "1 hour", "daily": "1 day", "weekly": "7 days", "h": "hours", "m": "minutes", "s": "seconds", "d": "days", "w": "weeks"}


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def as_number(c: Column) -> Column:
    """The value as double; null where it cannot be read as one."""
    return c.try_cast("double")


def bucket_interval(freq: str) -> str:
    """A Spark interval for ``1h``, ``15m``, ``1d`` or a word such as ``hourly``."""
    if freq in FREQUENCIES and not freq[-1:].isdigit() and len(freq) > 1:
        return FREQUENCIES[freq]
    count, unit = freq[:-1], freq[-1:]
    if not count.isdigit() or unit not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}")
    return f"{count} {FREQUENCIES[unit]}"


def aggregate_of(name: str, value: str, time: str) -> Column:
    """One of the seven bucket aggregates; other names raise."""
    made = {
        "mean": lambda: F.avg(value),
        "sum": lambda: F.sum(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "median": lambda: F.percentile(value, F.lit(0.5)),
        "first": lambda: F.min_by(value, time),
        "last": lambda: F.max_by(value, time),
    }
    if name not in made:
        raise ValueError(f"unknown aggregate {name!r}; one of {', '.join(AGGREGATES)}")
    return made[name]()


def load_series(
    df: DataFrame,
    time_col: str,
    value_col: str,
    id_col: str | None = None,
    start: str | None = None,
    end: str | None = None,
    freq: str | None = None,
    agg: str = "mean",
    tz: str | None = None,
) -> DataFrame:
    """``series_id string, ts timestamp, value double`` of a table: project, zone, filter, bucket, clean.

    The range includes both ends.  Buckets are closed on the left, named by their left edge and
    aligned to the epoch; empty ones are not made.  Without ``freq`` several values of one
    time are aggregated where ``id_col`` is given.  Values that are no finite number are dropped.
    """
    ts = F.col(time_col).cast("timestamp")
    if tz:
        ts = F.to_utc_timestamp(ts, tz)
    sid = F.col(id_col).cast("string") if id_col else F.lit("series")
    out = df.select(sid.alias("series_id"), ts.alias("ts"), as_number(F.col(value_col)).alias("value")).where(F.col("ts").isNotNull() & finite(F.col("value")))
    if id_col:
        out = out.where(F.col("series_id").isNotNull())
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if freq:
        out = out.groupBy("series_id", F.window("ts", bucket_interval(freq)).start.alias("b")).agg(aggregate_of(agg, "value", "ts").alias("value")).select("series_id", F.col("b").alias("ts"), "value")
    elif id_col:
        out = out.groupBy("series_id", "ts").agg(aggregate_of(agg, "value", "ts").alias("value"))
    return out


def _place(c: Column, kind: T.DataType) -> Column | None:
    """A number that never falls where ``c`` rises; None for types that have no such number."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("double") if isinstance(kind, (T.IntegralType, T.DecimalType)) else None


def number_points(df: DataFrame, series: str = "series_id", order: Sequence[str] = ("ts",), value: str = "value", shard_rows: int = 1_000_000) -> DataFrame:
    """``series_id, t bigint, value double``: finite values, numbered from 0 in order within their series.

    Series of more than ``shard_rows`` values are cut into ranges of their first order column; a range
    is numbered on its own and shifted by the number of values in the ranges before it, so that no
    task holds a long series.  A first order column that is no time, date, integer or decimal leaves a series whole.
    """
    clean = df.select(F.col(series).alias("series_id"), as_number(F.col(value)).alias("value"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    clean = clean.where(F.col("series_id").isNotNull() & finite(F.col("value")))
    keys = [f"__o{i}" for i in range(len(order))]
    place = _place(F.col("__o0"), clean.schema["__o0"].dataType)
    if place is not None:
        sizes = clean.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).cast("double").alias("lo"), F.max(place).cast("double").alias("hi"))
        long = sizes.where(F.col("n") > shard_rows).select("series_id", "lo", ((F.col("hi") - F.col("lo")) / F.ceil(4 * F.col("n") / shard_rows)).alias("width"))
        if long.limit(1).count():
            return _number_by_range(clean, keys, place, long)
    by = Window.partitionBy("series_id").orderBy(*keys)
    return clean.select("series_id", (F.row_number().over(by) - 1).cast("long").alias("t"), "value")


def _number_by_range(clean: DataFrame, keys: Sequence[str], place: Column, long: DataFrame) -> DataFrame:
    # Nulls come first in order, so they make the range before all others.
    shard = F.when(place.isNull(), -1).when(F.col("width") > 0, F.floor((place - F.col("lo")) / F.col("width"))).otherwise(0)
    rows = clean.join(long, "series_id", "left").withColumn("shard", shard.cast("long")).drop("lo", "width")
    counts = rows.groupBy("series_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("series_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("series_id", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("series_id", "shard").orderBy(*keys)) - 1
    numbered = rows.select("series_id", "shard", "value", inside.alias("i"))
    return numbered.join(offsets, ["series_id", "shard"]).select("series_id", (F.col("i") + F.col("offset")).cast("long").alias("t"), "value")


def sizes_of(points: DataFrame) -> DataFrame:
    """``series_id, __n``: points of each series, counted in the partitions before any exchange."""
    return points.groupBy("series_id").agg(F.count(F.lit(1)).alias("__n"))


def series_warnings(points: DataFrame) -> DataFrame:
    """Per series its size and the warnings of the input check: constant, short, long, extreme."""
    s = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return s.select(
        "series_id",
        "n_points",
        (F.col("lo") == F.col("hi")).alias("is_constant"),
        (F.col("n_points") < 3).alias("is_short"),
        (F.col("n_points") > 100_000).alias("is_long"),
        (F.greatest(F.abs("lo"), F.abs("hi")) > 1e10).alias("is_extreme"),
    )


def keep_long(points: DataFrame, least: int, varying: bool = False) -> DataFrame:
    """Only series of at least ``least`` points, and not constant ones where ``varying``."""
    kept = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("__n"), F.stddev_pop("value").alias("__sd")).where(F.col("__n") >= least)
    if varying:
        kept = kept.where(F.col("__sd") > 0)
    return points.join(kept.select("series_id"), "series_id", "left_semi")


def top_series(points: DataFrame, n: int, least: int = 1) -> DataFrame:
    """The ``n`` series with most points (a report), ties by id."""
    return points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points")).where(F.col("n_points") >= least).orderBy(F.desc("n_points"), "series_id").limit(n)
