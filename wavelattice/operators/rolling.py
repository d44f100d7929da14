"""Rolling totals over trailing calendar periods on sparse daily totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.readings import MICROS, latest_delivery, sharded, usable_readings

DAY_US = 86_400 * MICROS


def rolling_totals(
    df: DataFrame,
    source: str,
    time: str,
    value: str,
    versions: Sequence[str] = (),
    windows: Sequence[int] = (7, 30),
    shard_days: int = 7,
) -> DataFrame:
    """Trailing totals and means per source, calendar day (UTC) and window length.

    Usable readings are sharded by time, re-deliveries collapse to the latest version
    and daily totals are taken inside the shard, so only one row per active day travels
    on.  Inactive days between a source's first and last active day become calendar
    rows of zero.  Windows are RANGE frames over the integer day number; the mean's
    denominator is the window length in days, active or not, from the first day on.

    Output: ``source, day int`` (days since epoch), ``window_days bigint,
    total double, mean_per_day double, n_readings bigint, n_active_days bigint``.
    A source without usable reading has no rows; empty input gives none.
    """
    names = [f"x{i}" for i in range(len(versions))]
    rows = latest_delivery(sharded(usable_readings(df, source, time, value, versions), shard_days * DAY_US), names)
    daily = (
        rows.withColumn("day", F.floor(F.col("us") / F.lit(DAY_US)).cast("int"))
        .groupBy("src", "shard", "day")
        .agg(F.sum("val").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    by_day = Window.partitionBy("src").orderBy("day")
    upto = F.coalesce(F.lead("day").over(by_day) - 1, F.col("day"))
    calendar = daily.withColumn("upto", upto).select("src", "total", "n", F.col("day").alias("d0"), F.explode(F.sequence("day", "upto")).alias("day"))
    active = F.col("day") == F.col("d0")
    calendar = calendar.select(
        "src",
        "day",
        F.when(active, F.col("total")).otherwise(F.lit(0.0)).alias("total"),
        F.when(active, F.col("n")).otherwise(F.lit(0)).alias("n"),
        active.cast("long").alias("a"),
    )
    frames = []
    for w in windows:
        over = by_day.rangeBetween(-(w - 1), 0)
        total = F.sum("total").over(over)
        frames.append(
            F.struct(
                F.lit(w).cast("long").alias("window_days"),
                total.alias("total"),
                (total / F.lit(float(w))).alias("mean_per_day"),
                F.sum("n").over(over).cast("long").alias("n_readings"),
                F.sum("a").over(over).cast("long").alias("n_active_days"),
            )
        )
    framed = calendar.select("src", "day", *[f.alias(f"w{i}") for i, f in enumerate(frames)])
    each = framed.select("src", "day", F.explode(F.array(*[F.col(f"w{i}") for i in range(len(frames))])).alias("w"))
    return each.select(F.col("src").alias("source"), "day", "w.window_days", "w.total", "w.mean_per_day", "w.n_readings", "w.n_active_days")
