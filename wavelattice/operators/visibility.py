"""Horizontal and natural visibility graphs per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.grouped import stream_groups
from wavelattice.operators.series import sizes_of

TIE_RULES = ("stack", "strict", "loose")
WEIGHTS = ("absdiff", "time_gap", "slope", "min_clearance", "inv_dist", "distance", "product", "mean")


def _horizontal(x: np.ndarray, rule: str) -> tuple[list[int], list[int]]:
    """Positions of mutually visible points, one pass with a stack of falling values."""
    src: list[int] = []
    dst: list[int] = []
    if rule == "loose":
        levels: list[list[int]] = []  # members of equal value, values falling
        for j, v in enumerate(x.tolist()):
            while levels and x[levels[-1][0]] < v:
                for i in levels.pop():
                    src.append(i)
                    dst.append(j)
            if levels and x[levels[-1][0]] == v:
                src += levels[-1]
                dst += [j] * len(levels[-1])
                if len(levels) > 1:
                    src.append(levels[-2][-1])
                    dst.append(j)
                levels[-1].append(j)
            else:
                if levels:
                    src.append(levels[-1][-1])
                    dst.append(j)
                levels.append([j])
        return src, dst
    values = x.tolist()
    stack: list[int] = []
    for j, v in enumerate(values):
        while stack and values[stack[-1]] < v:
            src.append(stack.pop())
            dst.append(j)
        if stack:
            src.append(stack[-1])
            dst.append(j)
            if rule == "strict" and values[stack[-1]] == v:
                stack.pop()
        stack.append(j)
    return src, dst


def _records(x: np.ndarray, rule: str) -> np.ndarray:
    """Mask of the points that can see beyond the stretch: records from the left and from the right."""
    left, right = np.maximum.accumulate(x), np.maximum.accumulate(x[::-1])[::-1]
    return (x >= left) | (x >= right)


def hvg_edges(points: DataFrame, tie_rule: str = "stack", limit: int | None = None, shard_points: int = 100_000) -> DataFrame:
    """``series_id, src, dst`` of the horizontal visibility graph (src < dst).

    ``stack``: next strictly greater and previous greater-or-equal value; ``strict``: everything
    between is below both; ``loose``: everything between is at most the smaller.  ``limit`` keeps
    pairs at most that far apart.  Series are cut into shards of ``shard_points`` points, each
    swept on its own in O(points); only the records of a shard can see beyond it, so the edges
    between shards come from a second sweep over the records of the whole series.  Null
    series or values must have been cleaned off (see ``number_points``).
    """
    if tie_rule not in TIE_RULES:
        raise ValueError(f"tie_rule must be one of {TIE_RULES}")
    kind = points.schema["series_id"].dataType.simpleString()
    longest = points.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0

    def sweep(rows: pd.DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = rows["value"].to_numpy()
        src: list[int] = []
        dst: list[int] = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(x)]):
            a, b = _horizontal(x[lo:hi], tie_rule)
            src += (np.asarray(a, dtype=np.int64) + lo).tolist()
            dst += (np.asarray(b, dtype=np.int64) + lo).tolist()
        return np.asarray(src, dtype=np.int64), np.asarray(dst, dtype=np.int64)

    def edges_of(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        a, b = sweep(rows, starts)
        t = rows["t"].to_numpy()
        return pd.DataFrame({"series_id": rows["series_id"].to_numpy()[a], "src": t[a], "dst": t[b]})

    def records_of(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x = rows["value"].to_numpy()
        keep = np.concatenate([_records(x[lo:hi], tie_rule) for lo, hi in zip(starts, np.r_[starts[1:], len(x)])])
        return rows.loc[keep, ["series_id", "t", "value"]]

    def bridges(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = edges_of(rows, starts)
        return out[out["src"] // shard_points != out["dst"] // shard_points]

    edge = f"series_id {kind}, src long, dst long"
    sharded = points.select("series_id", "t", "value", F.floor(F.col("t") / F.lit(shard_points)).alias("shard"))
    edges = stream_groups(sharded, ["series_id", "shard"], "t", edges_of, edge)
    if longest > shard_points:  # else no series has a second shard
        records = stream_groups(sharded, ["series_id", "shard"], "t", records_of, f"series_id {kind}, t long, value double")
        edges = edges.unionByName(stream_groups(records, ["series_id"], "t", bridges, edge))
    if limit is not None and limit > 0:
        edges = edges.where(F.col("dst") - F.col("src") <= limit)
    return edges


def nvg_edges(
    points: DataFrame,
    limit: int | None = None,
    strict: bool = False,
    max_edges: int | None = None,
    max_edges_per_node: int | None = None,
    shard_points: int = 50_000,
    long_series: int = 10_000,
    long_limit: int = 5_000,
) -> DataFrame:
    """``series_id, src, dst`` of the natural visibility graph within a horizon of ``limit`` points.

    j is visible from i when its slope is not below (``strict``: above) every slope to points
    between.  Without a limit, series of more than ``long_series`` points get ``long_limit``.
    A shard is swept lag by lag on whole arrays; it carries the next ``limit`` points of its series
    so that edges over its border are found there.  ``max_edges_per_node`` keeps the nearest
    right neighbours of a point, ``max_edges`` the first edges of a series in (src, dst) order.
    """
    kind = points.schema["series_id"].dataType.simpleString()
    if limit is not None and limit > 0:
        reach, sized = F.lit(limit), points
    else:
        sized = points.join(sizes_of(points), "series_id")
        reach = F.when(F.col("__n") > long_series, F.lit(long_limit)).otherwise(F.col("__n"))
    sized = sized.select("series_id", "t", "value", reach.cast("long").alias("reach"))
    shard = F.floor(F.col("t") / F.lit(shard_points)).cast("long")
    # A point belongs to its shard and, as context only, to the shard before it where that can reach it.
    first = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("reach")) / F.lit(shard_points))).cast("long")
    spread = sized.withColumn("shard", F.explode(F.sequence(first, shard)))

    def sweep(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        t, x = rows["t"].to_numpy(), rows["value"].to_numpy()
        n = len(x)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        own = t // shard_points == rows["shard"].to_numpy()  # others are context of the shard
        most = rows["reach"].to_numpy()
        ends = np.r_[starts[1:], n][group]
        far = np.where(own, np.minimum(most, ends - 1 - np.arange(n)), 0)
        top = np.full(n, -np.inf)
        src, dst = [], []
        live = np.flatnonzero(far > 0)
        k = 1
        while len(live):
            slope = (x[live + k] - x[live]) / k
            seen = slope > top[live] if strict else slope >= top[live]
            at = live[seen]
            src.append(at)
            dst.append(at + k)
            top[live] = np.maximum(top[live], slope)
            k += 1
            live = live[far[live] >= k]
        a = np.concatenate(src) if src else np.empty(0, dtype=np.int64)
        b = np.concatenate(dst) if dst else np.empty(0, dtype=np.int64)
        return pd.DataFrame({"series_id": rows["series_id"].to_numpy()[a], "src": t[a], "dst": t[b]})

    edges = stream_groups(spread, ["series_id", "shard"], "t", sweep, f"series_id {kind}, src long, dst long")
    if max_edges_per_node:
        edges = edges.withColumn("__k", F.row_number().over(Window.partitionBy("series_id", "src").orderBy("dst"))).where(F.col("__k") <= max_edges_per_node).drop("__k")
    if max_edges:
        edges = edges.withColumn("__k", F.row_number().over(Window.partitionBy("series_id").orderBy("src", "dst"))).where(F.col("__k") <= max_edges).drop("__k")
    return edges


def edges_for_memory(max_memory_mb: float, max_edges: int | None = None) -> int:
    """The edge cap that a memory budget implies (16 bytes an edge), with any given cap."""
    cap = int(max_memory_mb * 1_048_576 / 16)
    return min(cap, max_edges) if max_edges else cap


def _weight(mode: str) -> Column:
    a, b, gap = F.col("xa"), F.col("xb"), (F.col("dst") - F.col("src")).cast("double")
    flat = F.abs(b - a)
    made = {
        "absdiff": flat,
        "time_gap": gap,
        "slope": (b - a) / gap,
        "inv_dist": 1.0 / (gap + 1e-12),
        "distance": F.sqrt(gap * gap + (b - a) * (b - a)),
        "product": a * b,
        "mean": (a + b) / 2,
    }
    return made[mode]


def edge_weights(points: DataFrame, edges: DataFrame, mode: str = "absdiff") -> DataFrame:
    """``edges`` with ``weight``: of their end values and places.

    ``min_clearance``: smaller end value less the greatest value between, infinite for neighbours;
    the values between are met by a join within the series.
    """
    if mode not in WEIGHTS:
        raise ValueError(f"weight mode must be one of {WEIGHTS}")
    a = points.select("series_id", F.col("t").alias("src"), F.col("value").alias("xa"))
    b = points.select("series_id", F.col("t").alias("dst"), F.col("value").alias("xb"))
    both = edges.join(a, ["series_id", "src"]).join(b, ["series_id", "dst"])
    if mode != "min_clearance":
        return both.select("series_id", "src", "dst", _weight(mode).alias("weight"))
    # The values of a series in order, once per series, and a slice of them per edge.
    values = points.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda p: p["value"]).alias("all"))
    between = F.array_max(F.slice("all", (F.col("src") + 2).cast("int"), (F.col("dst") - F.col("src") - 1).cast("int")))
    clear = F.when(F.col("dst") - F.col("src") == 1, F.lit(float("inf"))).otherwise(F.least("xa", "xb") - between)
    return both.join(values, "series_id").select("series_id", "src", "dst", clear.alias("weight"))
