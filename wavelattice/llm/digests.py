"""Percentiles of very large columns by merging centroid digests, with certified rank error."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.session import cut_lineage

DIGEST_COLUMNS = ("mean", "weight", "low", "high")


def _scale(q: Column, delta: float) -> Column:
    """The size function k(q): a cluster spans at most one unit of it, so clusters shrink towards both tails."""
    return F.asin(F.greatest(F.least(2 * q - 1, F.lit(1.0)), F.lit(-1.0))) * (delta / (2 * math.pi))


def _finite(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``k0, k1, ..., v``: rows whose keys are not null and whose value is a finite number."""
    if not keys:
        raise ValueError("at least one key column is needed")
    out = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    keep = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    for i in range(len(keys)):
        keep = keep & F.col(f"k{i}").isNotNull()
    return out.where(keep)


def partial_digests(df: DataFrame, keys: Sequence[str], value: str, delta: float = 200.0, buffer: int = 200_000) -> DataFrame:
    """One digest per key and stretch of a partition: ``k0.., part, mean, weight, low, high``.

    Runs inside the scan's own partitions without exchange: up to ``buffer`` values are sorted by
    key and value and clustered, so what leaves a task is its digests, however hot a key is.
    """
    rows = _finite(df, keys, value)
    names = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["part long", "mean double", "weight long", "low double", "high double"])

    def digest(pdf: pd.DataFrame, part: int) -> pd.DataFrame:
        code = pdf.groupby(names, sort=False).ngroup().to_numpy() if names else np.zeros(len(pdf), dtype=np.int64)
        v = pdf["v"].to_numpy()
        order = np.lexsort((v, code))
        code, v = code[order], v[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[first, len(code)])
        rank = np.arange(len(code)) - np.repeat(first, size)
        q = (rank + 0.5) / np.repeat(size, size)
        k = np.floor(np.arcsin(2 * q - 1) * (delta / (2 * math.pi)) + delta / 4).astype(np.int64)
        at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (k[1:] != k[:-1])])
        weight = np.diff(np.r_[at, len(code)])
        out = {n: pdf[n].to_numpy()[order[at]] for n in names}
        low, high = v[at], v[at + weight - 1]
        mean = np.where(low == high, low, np.add.reduceat(v, at) / weight)
        return pd.DataFrame(out | {"part": part, "mean": mean, "weight": weight, "low": low, "high": high})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if n >= buffer:
                yield digest(pd.concat(held, ignore_index=True), part)
                held, n = [], 0
        if held:
            yield digest(pd.concat(held, ignore_index=True), part)

    return rows.mapInPandas(scan, schema)


def _recluster(df: DataFrame, by: Sequence[str], delta: float) -> DataFrame:
    """Centroids of each group, sorted by mean and clustered anew by the size function."""
    ordered = Window.partitionBy(*by).orderBy("mean", "low", "weight")
    upto = F.sum("weight").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(Window.partitionBy(*by))
    q = (F.col("upto") - F.col("weight") / 2) / F.col("total")
    numbered = df.withColumn("upto", upto).withColumn("total", total).withColumn("cluster", F.floor(_scale(q, delta) + delta / 4))
    merged = numbered.groupBy(*by, "cluster").agg(
        # a cluster of one value keeps that very value, so that ties stay ties
        F.when(F.min("low") == F.max("high"), F.min("low")).otherwise(F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"),
        F.sum("weight").alias("w"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return merged.select(*by, "mean", F.col("w").alias("weight"), "low", "high")


def merge_digests(digests: DataFrame, keys: Sequence[str], part: str | None = None, delta: float = 200.0, fan_in: int = 64, levels: int = 3) -> DataFrame:
    """One digest per key out of many, by re-clustering: digests of days, files or partitions combine alike.

    With ``part`` (the place a digest comes from) they are merged in a tree: groups of at most ``fan_in`` neighbours
    of one level make one digest of the next, so that no task gets more than ``fan_in`` digests of
    a key, hot or not, up to ``fan_in ** levels`` places.
    """
    out = digests.select(*keys, *([F.col(part).cast("long").alias("place")] if part else []), *DIGEST_COLUMNS)
    if part:
        for level in range(levels - 1, 0, -1):
            out = _recluster(out.withColumn("place", F.pmod("place", F.lit(fan_in**level))), [*keys, "place"], delta)
    return _recluster(out.select(*keys, *DIGEST_COLUMNS), list(keys), delta)


def quantiles(digests: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``keys, n bigint, q double, estimate double``: percentiles interpolated between centroid middles.

    Where the rank that is asked for falls on a centroid of one value, that value is the answer, so groups
    that fit into centroids of their own are exact.  Below the first and above the last middle the ends
    are the exact minimum and maximum.
    """
    c = F.array_sort(F.collect_list(F.struct("mean", "weight", "low", "high")))
    packed = digests.groupBy(*keys).agg(c.alias("c"), F.sum("weight").alias("n"), F.min("low").alias("lo"), F.max("high").alias("hi"))

    # Points (cumulated weight, value, weight before, single value): the minimum, each centroid at the middle of its weight, the maximum.
    def point(r: Column, v: Column, before: Column, sure: Column) -> Column:
        return F.array(F.named_struct(F.lit("r"), r, F.lit("v"), v, F.lit("before"), before, F.lit("sure"), sure))

    never = F.lit(False)
    running = F.aggregate(
        "c",
        F.named_struct(F.lit("w"), F.lit(0.0), F.lit("p"), point(F.lit(0.0), F.col("lo"), F.lit(0.0), never)),
        lambda a, x: F.named_struct(F.lit("w"), a["w"] + x["weight"], F.lit("p"), F.concat(a["p"], point(a["w"] + x["weight"] / 2, x["mean"], a["w"], x["low"] == x["high"]))),
        lambda a: F.concat(a["p"], point(a["w"], F.col("hi"), a["w"], never)),
    )
    points = packed.select(*keys, "n", running.alias("p"), F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    target = F.col("q") * F.col("n")
    left = F.element_at(F.filter("p", lambda x: x["r"] <= target), -1)
    right = F.get(F.filter("p", lambda x: x["r"] > target), F.lit(0))
    placed = points.withColumn("a", left).withColumn("b", right)
    share = (target - F.col("a.r")) / (F.col("b.r") - F.col("a.r"))
    # The rank lies in the left centroid up to where the right one's weight begins.
    within = F.when(target < F.col("b.before"), F.col("a")).otherwise(F.col("b"))
    between = F.when(F.col("a.v") == F.col("b.v"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share)
    return placed.select(*keys, "n", "q", F.when(F.col("b").isNull(), F.col("a.v")).when(within["sure"], within["v"]).otherwise(between).alias("estimate"))


def certify(df: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame, broadcast_bytes: int = 32_000_000, salts: int = 32) -> DataFrame:
    """Second counting pass: ``keys, n, q, estimate, below, upto, rank_error`` for every estimate.

    ``below`` and ``upto`` count the values smaller than, and not larger than, the estimate; the
    certified ``rank_error`` is the distance of q from the interval [below/n, upto/n].  Counts are
    summed in the scan's partitions before any exchange.  The estimates go to all tasks when
    they take at most ``broadcast_bytes``; beyond, both sides are joined by key and salt,
    which splits hot keys over ``salts`` tasks.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = _finite(df, keys, value)
    held = cut_lineage(estimates.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "n", "q", "estimate"))
    grouped = held.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("q", "estimate"))).alias("e"))
    width = max(1, held.agg(F.count_distinct("q")).first()[0])
    size = grouped.agg(F.count(F.lit(1)), F.sum(sum((F.length(F.col(k).cast("string")) for k in names), F.lit(0)))).first()
    if size[0] * (64 + 24 * width) + (size[1] or 0) <= broadcast_bytes:
        joined = rows.join(F.broadcast(grouped), names)
    else:
        salted = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(salted, [*names, "salt"])
    counts = []
    for i in range(width):
        e = F.get("e", F.lit(i))["estimate"]
        counts += [F.sum((F.col("v") < e).cast("long")).alias(f"b{i}"), F.sum((F.col("v") <= e).cast("long")).alias(f"u{i}")]
    by = [*names, "salt"] if "salt" in joined.columns else names
    counted = joined.groupBy(*by).agg(*counts, F.first("e").alias("e"))
    if "salt" in by:
        counted = counted.groupBy(*names).agg(*[F.sum(f"{p}{i}").alias(f"{p}{i}") for i in range(width) for p in "bu"], F.first("e").alias("e"))
    flat = counted.select(*names, F.inline(F.array(*[F.struct(F.get("e", F.lit(i))["q"].alias("q"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto")) for i in range(width)])))
    out = held.join(flat, [*names, "q"])
    n = F.col("n").cast("double")
    error = F.greatest(F.col("below") / n - F.col("q"), F.col("q") - F.col("upto") / n, F.lit(0.0))
    return out.select(*[F.col(a).alias(k) for a, k in zip(names, keys)], "n", "q", "estimate", "below", "upto", error.alias("rank_error"))


def error_bound(delta: float, levels: int = 3) -> float:
    """The stated bound on the rank error: half a cluster in the middle, pi / (2 delta), for the first digest and for every merge."""
    return (levels + 1) * math.pi / (2 * delta)


def refined(df: DataFrame, keys: Sequence[str], value: str, certified: DataFrame, qs: Sequence[float], bound: float, delta: float, rounds: int = 4) -> DataFrame:
    """``certified`` with the groups that break ``bound`` done again, each round with digests four times as fine.

    What the last round leaves keeps its proven ``rank_error``, whatever it is.
    """
    for i in range(1, rounds + 1):
        certified = cut_lineage(certified)
        bad = certified.where(F.col("rank_error") > bound).select(*keys).distinct()
        if not bad.limit(1).count():
            return certified
        again = _estimates(df.join(bad, list(keys), "left_semi"), keys, value, qs, delta * 4**i)
        certified = certified.join(bad, list(keys), "left_anti").unionByName(certify(df, keys, value, again))
    return certified


def _estimates(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], delta: float) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    merged = merge_digests(partial_digests(df, keys, value, delta), names, "part", delta)
    return quantiles(merged, names, qs).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", "q", "estimate")


def grouped_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99), delta: float = 200.0) -> DataFrame:
    """Certified percentiles per group: partial digests, merging, interpolation, counting pass.

    ``keys, n, q, estimate, below, upto, rank_error, bound``: ``bound`` is ``error_bound(delta)``, the returned ``rank_error`` is
    what the counting pass proves, and a group that breaks the bound is done again with finer digests.
    Null keys and null, NaN or infinite values are left out; a group without values has no rows; empty input gives none.
    """
    bound = error_bound(delta)
    certified = certify(df, keys, value, _estimates(df, keys, value, qs, delta))
    return refined(df, keys, value, certified, qs, bound, delta).withColumn("bound", F.lit(bound))
