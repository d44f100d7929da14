"""Irregular readings onto a regular grid, by time shards and a prefix scan of boundary carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.readings import MICROS, latest_delivery, sharded, usable_readings


def regular_grid(
    df: DataFrame,
    source: str,
    time: str,
    value: str,
    versions: Sequence[str] = (),
    step_s: int = 3600,
    shard_steps: int = 168,
    fill_steps: int = 3,
) -> DataFrame:
    """One row per source and grid step between its first and last usable reading.

    Stages: (1) usable readings go to (source, time shard), re-deliveries collapse
    to the latest version, and each shard becomes one row: its steps with mean value
    and count.  A shard holds at most ``shard_steps`` steps, so the row is bounded.
    (2) Each shard's summary is its first step; only these summaries go to the whole source, where a
    scan carries the first step of the next non-empty shard to each shard, so that gaps
    across shards, empty shards included, have a known right end.  (3) The carries come back to
    where the shards lie, and every shard is filled on its own: each observed step emits itself
    and the gap up to its successor.

    Output: ``source string, step_start bigint`` (epoch seconds), ``value double,
    n_readings bigint, status string``: ``observed``; ``filled`` (linear between the
    neighbours, for gaps of at most ``fill_steps`` steps); ``missing`` (null value).
    Null/NaN rows never make a step; a source without a usable reading has no rows;
    empty input gives no rows; an infinite value is kept as observed and its gaps are marked missing.
    """
    shard_us = step_s * shard_steps * MICROS
    step_us = step_s * MICROS
    rows = usable_readings(df, source, time, value, versions)
    names = [f"x{i}" for i in range(len(versions))]
    readings = latest_delivery(sharded(rows, shard_us), names)
    steps = (
        readings.withColumn("step", F.floor(F.col("us") / F.lit(step_us)).cast("long"))
        .groupBy("src", "shard", "step")
        .agg(F.avg("val").alias("v"), F.count(F.lit(1)).alias("n"))
    )
    shards = steps.groupBy("src", "shard").agg(F.array_sort(F.collect_list(F.struct("step", "v", "n"))).alias("own"))
    # The carry: the first step of the next non-empty shard of the source.
    order = Window.partitionBy("src").orderBy("shard")
    carries = shards.select("src", "shard", F.get("own", F.lit(0)).alias("head")).select("src", "shard", F.lead("head").over(order).alias("carry"))
    # An outer join keeps both uses of the shards alike, so that their exchange is made once.
    carried = shards.join(carries, ["src", "shard"], "left")
    spans = carried.select(
        "src",
        F.explode(
            F.transform("own", lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get("own", i + 1), F.col("carry")).alias("b")))
        ).alias("s"),
    )
    last = F.when(F.col("s.b").isNull(), F.col("s.a.step")).otherwise(F.col("s.b.step") - 1)
    cells = spans.select("src", "s", F.explode(F.sequence(F.col("s.a.step"), last)).alias("step"))
    gap = F.col("s.b.step") - F.col("s.a.step") - 1
    own = F.col("step") == F.col("s.a.step")
    finite = (F.abs("s.a.v") < F.lit(float("inf"))) & (F.abs("s.b.v") < F.lit(float("inf")))
    linear = F.col("s.a.v") + (F.col("s.b.v") - F.col("s.a.v")) * (F.col("step") - F.col("s.a.step")) / (gap + 1)
    fill = (gap <= fill_steps) & finite
    return cells.select(
        F.col("src").alias("source"),
        (F.col("step") * step_s).alias("step_start"),
        F.when(own, F.col("s.a.v")).when(fill, linear).alias("value"),
        F.when(own, F.col("s.a.n")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        F.when(own, "observed").when(fill, "filled").otherwise("missing").alias("status"),
    )
