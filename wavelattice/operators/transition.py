"""Symbols, transition and ordinal-partition networks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLISERS = ("ordinal", "equal_width", "equal_freq", "kmeans")


def _windowed(points: DataFrame, order: int, delay: int) -> DataFrame:
    by = Window.partitionBy("series_id").orderBy("t")
    parts = [F.col("value"), *[F.lead("value", k * delay).over(by) for k in range(1, order)]]
    return points.select("series_id", "t", F.array(*parts).alias("arr")).where(F.element_at("arr", -1).isNotNull())


def ordinal_pattern(arr: str) -> Column:
    """Indices of the array's values in rising order, equal ones by place."""
    return F.transform(F.array_sort(F.transform(arr, lambda x, k: F.named_struct(F.lit("x"), x, F.lit("k"), k))), lambda s: s["k"].cast("int"))


def ordinal_symbols(points: DataFrame, order: int = 3, delay: int = 1) -> DataFrame:
    """``series_id, t, symbol array<int>``: the ordinal pattern of ``order`` values ``delay`` apart."""
    if order < 2 or delay < 1:
        raise ValueError("order must be 2 or more and delay positive")
    return _windowed(points, order, delay).select("series_id", "t", ordinal_pattern("arr").alias("symbol"))


def lehmer_codes(points: DataFrame, order: int = 3, delay: int = 1) -> DataFrame:
    """``series_id, t, code``: the canonical number of each pattern, 0 for rising values."""
    p = ordinal_symbols(points, order, delay)
    code = F.lit(0)
    for i in range(order):
        smaller = F.lit(0)
        for j in range(i + 1, order):
            smaller = smaller + (F.col("symbol")[j] < F.col("symbol")[i]).cast("int")
        code = code + smaller * math.factorial(order - 1 - i)
    return p.select("series_id", "t", code.cast("long").alias("code"))


def value_symbols(points: DataFrame, bins: int = 5, how: str = "equal_width") -> DataFrame:
    """``series_id, t, symbol``: number of inner edges not above the value; edges by width, by quantile, or by k-means centres."""
    if how not in SYMBOLISERS[1:]:
        raise ValueError(f"how must be one of {SYMBOLISERS[1:]}")
    if how == "equal_width":
        lim = points.groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        edges = F.array(*[F.col("lo") + F.lit(k) * (F.col("hi") - F.col("lo")) / F.lit(bins) for k in range(1, bins)])
        table = lim.select("series_id", edges.alias("edges"))
    elif how == "equal_freq":
        table = points.groupBy("series_id").agg(F.percentile("value", F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("edges"))
    else:
        return _kmeans_symbols(points, bins)
    near = points.join(table, "series_id")
    return near.select("series_id", "t", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("symbol"))


def _kmeans_symbols(points: DataFrame, bins: int) -> DataFrame:
    """One-dimensional k-means per series, started at quantiles; symbols by rising centre."""
    import numpy as np
    import pandas as pd

    kind = points.schema["series_id"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy()
        c = np.unique(np.quantile(x, (np.arange(bins) + 0.5) / bins))
        for _ in range(100):
            at = np.abs(x[:, None] - c[None, :]).argmin(1)
            new = np.array([x[at == i].mean() if (at == i).any() else c[i] for i in range(len(c))])
            if np.allclose(new, c):
                break
            c = np.sort(new)
        return pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "symbol": np.abs(x[:, None] - c[None, :]).argmin(1).astype("int32")})

    return points.select("series_id", "t", "value").groupBy("series_id").applyInPandas(fit, f"series_id {kind}, t long, symbol int")


def transitions(symbols: DataFrame, memory: int = 1) -> DataFrame:
    """``series_id, src array, dst array, weight``: counts of overlapping tuples of ``memory`` symbols that follow one another."""
    by = Window.partitionBy("series_id").orderBy("t")
    steps = [F.col("symbol"), *[F.lead("symbol", k).over(by) for k in range(1, memory + 1)]]
    seq = symbols.select("series_id", F.array(*steps).alias("s")).where(F.element_at("s", -1).isNotNull())
    pairs = seq.select("series_id", F.slice("s", 1, memory).alias("src"), F.slice("s", 2, memory).alias("dst"))
    return pairs.groupBy("series_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def transition_network(points: DataFrame, symboliser: str = "ordinal", order: int = 3, delay: int = 1, bins: int = 5, memory: int = 1) -> DataFrame:
    """Weighted transitions of the chosen symbols."""
    if symboliser not in SYMBOLISERS:
        raise ValueError(f"symboliser must be one of {SYMBOLISERS}")
    s = ordinal_symbols(points, order, delay) if symboliser == "ordinal" else value_symbols(points, bins, symboliser)
    return transitions(s, memory)


def transition_stats(net: DataFrame) -> DataFrame:
    """Nodes, edges, density and degrees of each series' transition network (self loops included)."""
    ends = net.select("series_id", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    deg = ends.groupBy("series_id", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    n = F.count(F.lit(1))
    pairs = n * (n - 1)
    return deg.groupBy("series_id").agg(
        n.alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.when(pairs > 0, F.sum("out_degree") / pairs).otherwise(0.0).alias("density"),
        F.avg("out_degree").alias("avg_out_degree"), F.stddev_pop("out_degree").alias("std_out_degree"),
    )


def entropy_rate(net: DataFrame) -> DataFrame:
    """Sum over nodes of their share of incoming weight times the entropy (bits) of what follows them."""
    out = F.col("weight") / F.sum("weight").over(Window.partitionBy("series_id", "src"))
    h = net.withColumn("p", out).groupBy("series_id", "src").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    into = net.groupBy("series_id", F.col("dst").alias("src")).agg(F.sum("weight").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("series_id"))
    return into.withColumn("pi", share).join(h, ["series_id", "src"], "left").groupBy("series_id").agg((F.sum(F.col("pi") * F.coalesce("h", F.lit(0.0))) + 0.0).alias("entropy_rate"))


def pattern_distribution(symbols: DataFrame) -> DataFrame:
    """``series_id, symbol, n, share`` of every pattern."""
    c = symbols.groupBy("series_id", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))


def permutation_entropy(points: DataFrame, order: int = 3, delay: int = 1) -> DataFrame:
    """Entropy of the ordinal patterns of every ``delay``-th point, as a share of its greatest value."""
    thin = points.where(F.pmod("t", F.lit(delay)) == 0).withColumn("t", F.floor(F.col("t") / delay).cast("long"))
    p = pattern_distribution(ordinal_symbols(thin, order))
    return p.groupBy("series_id").agg((-F.sum(F.col("share") * F.log("share")) / math.log(math.factorial(order)) + 0.0).alias("permutation_entropy"))


def optimal_lag(points: DataFrame, max_lag: int = 50) -> DataFrame:
    """First lag whose autocorrelation is not positive, else the lag of the least; at most a quarter of the series."""
    whole = Window.partitionBy("series_id")
    c = points.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("x", F.col("value") - F.avg("value").over(whole))
    lags = c.select("series_id", "t", "x", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(max_lag), F.floor(F.col("n") / 4)).cast("int")))).alias("lag"))
    later = c.select("series_id", F.col("t").alias("u"), F.col("x").alias("y"))
    var = c.groupBy("series_id").agg(F.sum(F.col("x") * F.col("x")).alias("v"))
    acf = lags.withColumn("u", F.col("t") + F.col("lag")).join(later, ["series_id", "u"]).groupBy("series_id", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s")).join(var, "series_id")
    acf = acf.select("series_id", "lag", F.round(F.col("s") / F.col("v"), 10).alias("r"))
    return acf.groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("r") <= 0, F.col("lag"))), F.min_by("lag", F.struct("r", "lag"))).cast("long").alias("lag"))


def optimal_dimension(points: DataFrame, delay: int = 1, least: int = 2, most: int = 8) -> DataFrame:
    """The pattern length whose ordinal partition network has the greatest variance of degree (first on ties)."""
    each = None
    for m in range(least, most + 1):
        net = transitions(ordinal_symbols(points, m, delay))
        ends = net.select("series_id", F.inline(F.array(F.struct(F.col("src").alias("node")), F.struct(F.col("dst").alias("node")))))
        v = ends.groupBy("series_id", "node").agg(F.count(F.lit(1)).alias("d")).groupBy("series_id").agg(F.round(F.var_pop("d"), 9).alias("v")).withColumn("m", F.lit(m))
        each = v if each is None else each.unionByName(v)
    return each.groupBy("series_id").agg(F.max(F.struct(F.col("v"), (-F.col("m")).alias("k"))).alias("b")).select("series_id", (-F.col("b.k")).cast("long").alias("dimension"), F.col("b.v").alias("degree_variance"))


def transition_map(network: DataFrame) -> DataFrame:
    """``series_id, counts map<string, bigint>``: a transition network as a map from "source>target" to its count."""
    entry = F.struct(F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("k"), F.col("weight").cast("long").alias("v"))
    return network.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"))
