"""Sliding windows, coarse-graining and what is computed on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.series import sizes_of

COARSE = ("mean", "median", "max", "min", "std")


def sliding_windows(points: DataFrame, width: int, by: int = 1) -> DataFrame:
    """``series_id, window_id, pos, t, value``: windows of ``width`` points every ``by`` points; the tail is dropped.

    Each point is copied to the windows that hold it by arithmetic on its place, without a join.
    Series shorter than ``width`` have no window.
    """
    if width < 1 or by < 1:
        raise ValueError("width and by must be positive")
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (width - 1)) / F.lit(by))).cast("long")
    last = F.least(F.floor(F.col("t") / F.lit(by)), F.floor((F.col("__n") - width) / F.lit(by))).cast("long")
    sized = points.join(sizes_of(points), "series_id").where(F.col("__n") >= width).withColumn("__a", first).withColumn("__b", last).where("__a <= __b")
    out = sized.select("series_id", "t", "value", F.explode(F.sequence("__a", "__b")).alias("window_id"))
    return out.select("series_id", "window_id", (F.col("t") - F.col("window_id") * by).alias("pos"), "t", "value")


def window_points(windows: DataFrame) -> DataFrame:
    """Windows as series of their own: ``series_id`` a struct (series_id, window_id), ``t`` the place inside."""
    return windows.select(F.struct("series_id", "window_id").alias("series_id"), F.col("pos").alias("t"), "value")


def window_stats(windows: DataFrame) -> DataFrame:
    """Mean, spread, extremes, median, skew, excess kurtosis (all of the population) and trend per window."""
    return windows.groupBy("series_id", "window_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", F.lit(0.5)).alias("median"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"),
        F.regr_slope("value", "pos").alias("trend"),
    )


def windowed_graph_stats(points: DataFrame, width: int, by: int, builder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Graph size and degrees of every window: ``builder`` makes edges of points, windows being series.

    ``series_id, window_id, n_nodes, n_edges, avg_degree, std_degree``.
    """
    from wavelattice.operators.graph import nodes_of, summary

    p = window_points(sliding_windows(points, width, by))
    s = summary(nodes_of(p), builder(p))
    return s.select("series_id.series_id", "series_id.window_id", "n_nodes", "n_edges", "avg_degree", "std_degree")


def window_aggregate(stats: DataFrame, aggregate: str) -> DataFrame:
    """``series_id, window_id, value``: one number per window out of its graph statistics.

    ``mean``, ``std``, ``min`` and ``max`` are those of the degrees, other names are columns; a name that is no column gives 0.
    """
    name = {"mean": "avg_degree", "std": "std_degree", "min": "min_degree", "max": "max_degree"}.get(aggregate, aggregate)
    value = F.col(name).cast("double") if name in stats.columns else F.lit(0.0)
    return stats.select("series_id", "window_id", value.alias("value"))


def coarse_grain(points: DataFrame, scale: int, method: str = "mean") -> DataFrame:
    """Blocks of ``scale`` points as one; the rest is dropped, as are series not longer than ``scale``. ``std`` has ddof 1."""
    if method not in COARSE:
        raise ValueError(f"method must be one of {COARSE}")
    made = {"mean": F.avg("value"), "median": F.percentile("value", F.lit(0.5)), "max": F.max("value"), "min": F.min("value"), "std": F.stddev_samp("value")}
    sized = points.join(sizes_of(points), "series_id").where(F.col("__n") > scale)
    full = sized.where(F.col("t") < F.floor(F.col("__n") / scale) * scale)
    return full.groupBy("series_id", F.floor(F.col("t") / scale).cast("long").alias("t")).agg(made[method].alias("value"))


def multiscale(points: DataFrame, scales: Sequence[int], builder: Callable[[DataFrame], DataFrame], method: str = "mean", least: int = 10) -> DataFrame:
    """``series_id, scale`` and graph statistics of the coarse-grained series (null below ``least`` points)."""
    from wavelattice.operators.graph import nodes_of, summary

    each = None
    for scale in sorted(set(scales)):
        c = points.select("series_id", "t", "value") if scale == 1 else coarse_grain(points, scale, method)
        c = c.select(F.struct("series_id", F.lit(scale).cast("long").alias("scale")).alias("series_id"), "t", "value")
        each = c if each is None else each.unionByName(c)
    from wavelattice.operators.series import keep_long

    kept = keep_long(each, least)
    stats = summary(nodes_of(kept), builder(kept)).select("series_id.series_id", "series_id.scale", "n_nodes", "n_edges", "avg_degree", "std_degree", "density")
    wanted = points.select("series_id").distinct().select("series_id", F.explode(F.array(*[F.lit(s).cast("long") for s in sorted(set(scales))])).alias("scale"))
    return wanted.join(stats, ["series_id", "scale"], "left")


def lag_autocorrelation(points: DataFrame, lag: int = 1) -> DataFrame:
    """Pearson correlation of a series with itself ``lag`` points before (0 where undefined)."""
    by = Window.partitionBy("series_id").orderBy("t")
    pairs = points.withColumn("before", F.lag("value", lag).over(by))
    return pairs.where("before is not null").groupBy("series_id").agg(F.coalesce(F.nanvl(F.corr("before", "value"), F.lit(0.0)), F.lit(0.0)).alias("autocorrelation"))


def neighbour_gap(events: DataFrame) -> DataFrame:
    """Distance of each event ``series_id, event_t`` to its nearest neighbour (1 for a lone event)."""
    by = Window.partitionBy("series_id").orderBy("event_t")
    gap = F.least(F.col("event_t") - F.lag("event_t").over(by), F.lead("event_t").over(by) - F.col("event_t"))
    return events.select("series_id", "event_t", F.coalesce(gap.cast("double"), F.lit(1.0)).alias("gap"))
