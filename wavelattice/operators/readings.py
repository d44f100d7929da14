"""Shared preparation of irregular source readings: usable rows, re-deliveries, time shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def to_micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp or timestamp-without-zone column (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def usable_readings(df: DataFrame, source: str, time: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Columns ``src, us, val`` and ``x0, x1, ...`` (from ``extra``) of the usable rows.

    A row is usable when its source and time are not null and its value is neither
    null nor NaN.  Other input columns, whatever their names, are left behind, so
    clashing names cannot occur.  Empty input gives empty output.
    """
    cols = [F.col(source).cast("string").alias("src"), to_micros(F.col(time)).alias("us"), F.col(value).cast("double").alias("val")]
    cols += [F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]
    out = df.select(*cols)
    return out.where(F.col("src").isNotNull() & F.col("us").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val"))


def sharded(df: DataFrame, shard_us: int) -> DataFrame:
    """Adds ``shard``, the time shard, and places each (src, shard) in one partition.

    Splitting by time bounds what one task holds of a source, however many rows
    the source has; every later step keyed by (src, shard, ...) needs no further exchange.
    """
    return df.withColumn("shard", F.floor(F.col("us") / F.lit(shard_us)).cast("long")).repartition("src", "shard")


def latest_delivery(df: DataFrame, versions: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (src, shard, us): the value with the greatest ``versions`` (null lowest).

    Second deliveries of a reading count once, with the value delivered last.
    Ties on all versions take the greater value.
    """
    if not versions:
        return df.groupBy("src", "shard", "us").agg(F.max("val").alias("val"), *[F.max(k).alias(k) for k in keep])
    order = F.struct(*[F.col(v) for v in versions], F.col("val"))
    return df.groupBy("src", "shard", "us").agg(F.max_by("val", order).alias("val"), *[F.max_by(k, order).alias(k) for k in keep])
