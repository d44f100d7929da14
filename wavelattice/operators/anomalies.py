"""Implausible measurements per source: spikes, stuck values, impossible readings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.functions.stats import esd_limit
from wavelattice.operators.readings import MICROS, sharded, usable_readings
from wavelattice.session import cut_lineage

#: Numbers that meters and loggers send in place of a measurement.
FILLERS = (9999.0, 9999.9, 9999.99, 9999.999, 99999.0, 99999.9, 99999.99, 99999.999, 999999.0, 999999.9, 999999.99, 999999.999, 32767.0, 65535.0, 2147483647.0, 4294967295.0, 4294967.295)

_HOUR_US = 3600 * MICROS


def _decompose(rows: DataFrame, min_rows: int, min_shards: int = 3, min_cells: int = 4) -> DataFrame:
    """Trend and season of ``y`` by medians: one row per (src, shard) with its trend ``t``,
    the source's season ``s`` (by hour of day), robust spread ``sd``, readings ``n_src`` and active ``days``.

    Medians are taken per (src, shard, hour of day); the trend of a shard is the median of its
    cells, the season of an hour the median over shards of cell minus trend (one sweep of
    median polish).  The spread joins the spread inside cells (interquartile) and the
    remainder of the cell medians (median absolute deviation).  A shard of fewer than
    ``min_rows`` readings takes the source's median as its trend, and an hour met in
    fewer than ``min_cells`` shards, or a source of fewer than ``min_shards`` shards or with too few cells
    an hour, has no season: it would be fitted to the very readings in question.
    """
    cells = rows.groupBy("src", "shard", "hour").agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"), F.collect_set("day").alias("days"))
    cells = cells.select("src", "shard", "hour", "n", "days", F.get("q", F.lit(1)).alias("m"), F.when(F.col("n") >= 4, (F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / 1.349).alias("w"))
    shards = cells.groupBy("src", "shard").agg(F.percentile("m", F.lit(0.5)).alias("own"), F.sum("n").alias("rows"), F.collect_list(F.struct("hour", "m", "w", "n")).alias("cells"), F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"))
    # From here on one row of at most 24 cells per shard, kept, as four branches use it; a source has as many as its life has shards.
    shards = cut_lineage(shards)
    whole = Window.partitionBy("src")
    shards = shards.withColumn("mid", F.percentile("own", F.lit(0.5), F.col("rows")).over(whole)).withColumn("days", F.sum("days").over(whole)).withColumn("t", F.when(F.col("rows") >= min_rows, F.col("own")).otherwise(F.col("mid")))
    flat = shards.select("src", "shard", "t", F.inline("cells"))
    hours = flat.groupBy("src", "hour").agg(
        F.percentile(F.col("m") - F.col("t"), F.lit(0.5)).alias("s"),
        F.percentile(F.coalesce("w", F.lit(0.0)), F.lit(0.5), F.col("n")).alias("w"),
        F.percentile(F.col("m") - F.col("t"), F.array(F.lit(0.25), F.lit(0.75))).alias("r"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("cells"),
    )
    flatly = flat.groupBy("src").agg(F.count_distinct("shard").alias("shards"), F.percentile(F.col("m") - F.col("t"), F.array(F.lit(0.25), F.lit(0.75))).alias("r0"))
    remainder = (F.get("r", F.lit(1)) - F.get("r", F.lit(0))) / 1.349
    season = hours.groupBy("src").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cells") >= min_cells, F.struct("hour", "s")))).alias("s"),
        F.avg("cells").alias("cells"),
        F.percentile("w", F.lit(0.5), F.col("n")).alias("w"),
        F.percentile(remainder, F.lit(0.5), F.col("n")).alias("r"),
        F.sum("n").alias("n_src"),
    )
    long = (F.col("shards") >= min_shards) & (F.col("cells") >= min_cells)
    spread = F.when(long, F.col("r")).otherwise((F.get("r0", F.lit(1)) - F.get("r0", F.lit(0))) / 1.349)
    season = season.join(flatly, "src").select("src", "n_src", F.when(long, F.col("s")).alias("s"), F.sqrt(F.col("w") * F.col("w") + spread * spread).alias("sd"))
    return shards.select("src", "shard", "t", "days").join(season, "src")


def spike_limits(rows: DataFrame, parts: DataFrame, alpha: float, max_share: float, far: float, min_sd: float = 0.05) -> DataFrame:
    """``src, hi, lo``: values of ``y`` at and beyond which a source's readings are spikes (null: none).

    Residuals are studentised by the robust spread and counted in a histogram per source
    (bins of the residual and of ``y``; only bins beyond two spreads are kept by day, which the
    recurrence below needs, so these grow with the days a source has such values).  Walking the bins from the largest residual down, the generalised ESD
    limit for the number of values so far is compared with the bin; the last bin above
    its limit ends the outliers, at most ``max_share`` of the readings.  Of these, only
    values parted by a factor ``far`` from all that the source shows otherwise are spikes.
    Values beyond such a gap are yet normal where they recur: on more than five days and either
    on a fifth of the source's days and once in 125 readings, or on more than half of its days
    and at a regular hour: one that has them on more than three times as many days, beyond
    chance, as it would if they were scattered over the readings.  Scattered values thus
    do not recur, however many readings a day there are.  The limit is the first gap outwards
    beyond which nothing recurs, so spikes far above recurring peaks are found.
    """
    r = (F.col("y") - F.col("t") - F.coalesce(F.try_element_at("s", F.col("hour")), F.lit(0.0))) / F.greatest("sd", F.lit(min_sd))
    scored = rows.join(parts, ["src", "shard"]).select("src", "y", "hour", "day", "n_src", "days", r.alias("r"))
    wide = F.abs("r") > 2.0
    bins = scored.groupBy(
        "src",
        "hour",
        F.when(wide, F.signum("r")).otherwise(0).cast("int").alias("side"),
        F.when(wide, F.floor(F.abs("r") * 20)).otherwise(0).cast("long").alias("rb"),
        F.when(wide, F.floor(F.col("y") * 50)).otherwise(0).cast("long").alias("yb"),
        F.when(wide, F.col("day")).alias("day"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("n_src").alias("n_src"), F.max("days").alias("days"))
    down = Window.partitionBy("src").orderBy(F.desc("rb")).rangeBetween(Window.unboundedPreceding, 0)
    walked = bins.withColumn("i", F.sum("n").over(down)).withColumn("limit", esd_limit(F.col("n_src").cast("double"), F.col("i").cast("double"), alpha))
    beyond = (F.col("n_src") >= 7) & (F.col("side") != 0) & (F.col("i") <= F.greatest(F.floor(F.col("n_src") * max_share), F.lit(1))) & (F.col("rb") / 20.0 > F.col("limit"))
    whole = Window.partitionBy("src")
    cut = F.min(F.when(beyond, F.col("rb"))).over(whole)
    out = walked.withColumn("out", F.coalesce((F.col("side") != 0) & (F.col("rb") >= cut), F.lit(False)))
    # The chain of values from the normal ones outwards, broken at every wide gap.
    rest = out.withColumn("top", F.max(F.when(~F.col("out"), F.col("y1"))).over(whole)).withColumn("low", F.min(F.when(~F.col("out"), F.col("y0"))).over(whole))
    upward = Window.partitionBy("src").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    downward = Window.partitionBy("src").orderBy(F.desc("y1"), F.desc("y0")).rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("below", F.greatest("top", F.max("y1").over(upward))).withColumn("above", F.least("low", F.min("y0").over(downward)))
    gap = math.log(far)
    high = F.when(F.col("out") & (F.col("side") > 0) & (F.col("y0") > F.col("top")) & (F.col("y0") - F.col("below") >= gap), F.col("y0"))
    deep = F.when(F.col("out") & (F.col("side") < 0) & (F.col("y1") < F.col("low")) & (F.col("above") - F.col("y1") >= gap), F.col("y1"))
    # Every gap is a limit that may be taken; each parts values by a factor ``far``, so a source has few.
    limits = rest.groupBy("src").agg(F.collect_set(high).alias("highs"), F.collect_set(deep).alias("deeps"))
    # How often, on which days and at which hours values lie beyond each limit.
    passed = F.concat(
        F.transform(F.filter("highs", lambda v: F.col("y0") >= v), lambda v: F.struct(F.lit(1).alias("way"), v.alias("at"))),
        F.transform(F.filter("deeps", lambda v: F.col("y1") <= v), lambda v: F.struct(F.lit(-1).alias("way"), v.alias("at"))),
    )
    far_out = rest.where("out").join(limits.where((F.size("highs") > 0) | (F.size("deeps") > 0)), "src").select("src", "hour", "day", "n", "n_src", "days", F.inline(passed))
    hourly = far_out.groupBy("src", "way", "at", "hour").agg(F.sum("n").alias("n"), F.collect_set("day").alias("on"), F.max("n_src").alias("n_src"), F.max("days").alias("days"))
    hourly = hourly.join(bins.groupBy("src", "hour").agg(F.sum("n").alias("n_hour")), ["src", "hour"])
    judged = hourly.groupBy("src", "way", "at").agg(
        F.sum("n").alias("n"),
        F.max("n_src").alias("n_src"),
        F.max("days").alias("days"),
        F.size(F.array_distinct(F.flatten(F.collect_list("on")))).alias("d"),
        F.sum(F.size("on")).alias("slots"),
        F.collect_list(F.struct(F.size("on").alias("on"), (F.col("n_hour") / F.col("n_src")).alias("share"))).alias("hours"),
    )

    def kept(h: Column) -> Column:
        by_chance = F.col("slots") * h["share"]
        return (h["on"] > 3 * by_chance) & (h["on"] > by_chance + 5 * F.sqrt(by_chance) + 3)

    often = (F.col("d") > 0.2 * F.col("days")) & (F.col("n") > F.col("n_src") / 125)
    regular = (F.col("d") > 0.5 * F.col("days")) & F.exists("hours", kept)
    ways = judged.withColumn("recurs", (F.col("d") > 5) & (often | regular)).withColumn("out_by", F.col("way") * F.col("at"))  # grows outwards on either side
    ways = ways.withColumn("usual", F.max(F.when(F.col("recurs"), F.col("out_by"))).over(Window.partitionBy("src", "way")))
    rare = ways.where(F.col("usual").isNull() | (F.col("out_by") > F.col("usual")))
    return rare.groupBy("src").agg(F.min(F.when(F.col("way") > 0, F.col("at"))).alias("hi"), F.max(F.when(F.col("way") < 0, F.col("at"))).alias("lo"))


def stuck_runs(rows: DataFrame, min_run: int, expected: float) -> DataFrame:
    """``src, from_us, to_us, val, n``: long stretches of one non-zero value at sources that otherwise vary.

    Runs are found inside each time shard (gaps and islands on the first delivery of each
    time).  Only a shard's first and last run and its long ones go on; runs that touch a
    shard's border are joined over neighbouring shards by a scan of these summaries.  A run
    counts from ``min_run`` readings on, and more where the source repeats values by chance:
    the expected number of chance runs of that length must stay below ``expected``.
    """
    first = rows.groupBy("src", "shard", "us").agg(F.min_by("val", "ord").alias("val"))
    by_time = Window.partitionBy("src", "shard").orderBy("us")
    start = F.when(F.lag("val").over(by_time).isNull() | (F.lag("val").over(by_time) != F.col("val")), F.col("us"))
    runs = first.withColumn("start", start).withColumn("start", F.last("start", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("src", "shard", "start").agg(F.first("val").alias("val"), F.max("us").alias("end"), F.count(F.lit(1)).alias("n"))
    shard = Window.partitionBy("src", "shard")
    runs = runs.withColumn("edge", (F.col("start") == F.min("start").over(shard)) | (F.col("start") == F.max("start").over(shard)))
    # One row per shard: how often values repeat, and its first, last and long runs.
    summaries = cut_lineage(
        runs.groupBy("src", "shard").agg(
            F.sum("n").alias("n_src"),
            F.sum(F.when(F.col("n") < min_run, F.col("n") - 1).otherwise(0)).alias("repeats"),
            F.sum(F.when(F.col("n") < min_run, 1).otherwise(0)).alias("short_runs"),
            F.collect_list(F.when(F.col("edge") | (F.col("n") >= min_run), F.struct("start", "end", "val", "n"))).alias("kept"),
        )
    )
    habits = summaries.groupBy("src").agg(F.sum("n_src").alias("n_src"), F.sum("repeats").alias("repeats"), F.sum("short_runs").alias("short_runs"))
    kept = summaries.select("src", "shard", F.inline("kept"))
    # Joined over borders: consecutive kept runs of equal value whose shards' borders meet.
    order = Window.partitionBy("src").orderBy("start")
    last_of = F.max("start").over(Window.partitionBy("src", "shard")) == F.col("start")
    first_of = F.min("start").over(Window.partitionBy("src", "shard")) == F.col("start")
    linked = kept.withColumn("is_last", last_of).withColumn("is_first", first_of)
    joins = F.col("is_first") & F.lag("is_last").over(order) & (F.lag("val").over(order) == F.col("val"))
    linked = linked.withColumn("head", F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.col("start")))
    linked = linked.withColumn("head", F.last("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = linked.groupBy("src", "head").agg(F.first("val").alias("val"), F.max("end").alias("to_us"), F.sum("n").alias("n"))
    chance = F.greatest(F.col("repeats"), F.lit(1)) / F.greatest(F.col("repeats") + F.col("short_runs"), F.lit(2))
    needed = 1 + F.log(F.col("n_src") / F.lit(expected)) / -F.log(F.least(chance, F.lit(0.95)))
    return (
        merged.join(habits, "src")
        .where((F.col("val") > 0) & (F.col("n") >= min_run) & (F.col("n") >= needed) & (F.col("short_runs") >= 5))
        .select("src", F.col("head").alias("from_us"), "to_us", "val", "n")
    )


def implausible_readings(
    df: DataFrame,
    reading_id: str,
    source: str,
    time: str,
    value: str,
    order: Sequence[str] = (),
    shard_hours: int = 168,
    alpha: float = 0.05,
    max_share: float = 0.1,
    far: float = 3.0,
    min_run: int = 12,
    expected_chance_runs: float = 0.1,
    fillers: Sequence[float] = FILLERS,
    broadcast_bytes: int = 32_000_000,
    salts: int = 32,
) -> DataFrame:
    """``reading_id, source, value, why`` of the implausible usable readings; ``why`` is an array.

    ``impossible``: negative, infinite or a filler number.  ``spike``: see ``spike_limits``, on
    the logarithm of positive values, so that sources of any size are judged alike.
    ``stuck``: see ``stuck_runs``.  Readings go to (source, time shard) once; trend, season,
    histogram and runs are all taken there, and only summaries cross to the whole source,
    so a source of any size is spread over its shards.  What comes out are the limits of the sources
    that have some, and the runs by source and shard; the readings are held against them in
    a second scan, without an exchange where these take at most ``broadcast_bytes``, else by
    joins on source and part of time.  Zeros are never spikes or stuck.
    Second deliveries are judged like first ones.  Sources of fewer than 7 positive
    readings have no spikes.  Null or NaN readings are not judged; empty input gives no rows.
    """
    keys = list(order) or [reading_id]
    base = usable_readings(df, source, time, value, [reading_id, *keys])
    rows = sharded(base.withColumn("ord", F.struct(*[F.col(f"x{i + 1}") for i in range(len(keys))])), shard_hours * _HOUR_US)
    rows = rows.select("src", "shard", "us", "val", F.col("x0").alias("id"), "ord")
    bad = (F.col("val") < 0) | F.col("val").isin([float(f) for f in fillers]) | (F.abs("val") == float("inf"))
    positive = rows.where(~bad & (F.col("val") > 0)).select(
        "src", "shard", F.floor(F.pmod(F.col("us"), F.lit(24 * _HOUR_US)) / F.lit(_HOUR_US)).cast("int").alias("hour"), F.floor(F.col("us") / F.lit(24 * _HOUR_US)).cast("int").alias("day"), F.log("val").alias("y")
    )
    parts = _decompose(positive, min_rows=24)
    limits = spike_limits(positive, parts, alpha, max_share, far)
    stuck = stuck_runs(rows.where(~bad), min_run, expected_chance_runs)
    limits = cut_lineage(limits)
    width = F.lit(shard_hours * _HOUR_US)
    spread = stuck.select("src", F.struct("from_us", "to_us", "val").alias("run"), F.explode(F.sequence(F.floor(F.col("from_us") / width).cast("long"), F.floor(F.col("to_us") / width).cast("long"))).alias("shard"))
    spread = cut_lineage(spread.groupBy("src", "shard").agg(F.collect_list("run").alias("runs")))
    judged = base.select("src", "us", "val", F.col("x0").alias("id"), F.floor(F.col("us") / width).cast("long").alias("shard"))
    size = limits.agg(F.coalesce(F.sum(F.length("src") + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        judged = judged.join(F.broadcast(limits), "src", "left")
    else:  # by source and part, so that a source with many readings is spread
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        judged = judged.withColumn("salt", F.pmod("shard", F.lit(salts)).cast("int")).join(salted, ["src", "salt"], "left")
    size = spread.agg(F.coalesce(F.sum(F.length("src") + 96 + 32 * F.size("runs")), F.lit(0))).first()[0]
    judged = judged.join(F.broadcast(spread) if size <= broadcast_bytes else spread, ["src", "shard"], "left")
    y = F.when(~bad & (F.col("val") > 0), F.log("val"))
    spike = F.coalesce((y >= F.col("hi")) | (y <= F.col("lo")), F.lit(False))
    is_stuck = F.coalesce(F.exists("runs", lambda q: (F.col("us") >= q.from_us) & (F.col("us") <= q.to_us) & (F.col("val") == q.val)), F.lit(False))
    why = F.array_compact(F.array(F.when(bad, "impossible"), F.when(spike, "spike"), F.when(is_stuck, "stuck")))
    return judged.where(bad | spike | is_stuck).select(F.col("id").alias("reading_id"), F.col("src").alias("source"), F.col("val").alias("value"), why.alias("why"))
