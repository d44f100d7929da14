"""Significance of correlations, surrogates and null models (Q1-Q14, Q16, Q19, SP3)."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SURROGATES = ("shuffle", "phase", "circular", "iaaft", "block_bootstrap")


def fisher_interval(rho: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Confidence limits of a correlation of n >= 4 values (null below)."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    capped = F.greatest(F.least(rho, F.lit(1 - 1e-12)), F.lit(-1 + 1e-12))
    half = F.lit(z) / F.sqrt(n - 3)
    ok = n >= 4
    return F.when(ok, F.tanh(F.atanh(capped) - half)), F.when(ok, F.tanh(F.atanh(capped) + half))


def correlation_significance(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``series_id, r, n, lo, hi, significant`` of value pairs ``series_id, x, y``."""
    c = pairs.groupBy("series_id").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    lo, hi = fisher_interval(F.col("r"), F.col("n"), alpha)
    return c.withColumn("lo", lo).withColumn("hi", hi).withColumn("significant", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))


def cross_correlation_significance(x1: DataFrame, x2: DataFrame, max_lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """``series_id, lag, r, n, lo, hi, significant``: the greatest signed correlation over lags (first on ties), at least 4 pairs."""
    a = x1.select("series_id", "t", F.col("value").alias("x"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("u", F.col("t") + F.col("lag"))
    b = x2.select("series_id", F.col("t").alias("u"), F.col("value").alias("y"))
    c = a.join(b, ["series_id", "u"]).groupBy("series_id", "lag").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 4 and r is not null and not isnan(r)")
    best = c.groupBy("series_id").agg(F.max(F.struct(F.round("r", 12).alias("k"), (-F.col("lag")).alias("first"), "r", "n")).alias("m")).select("series_id", (-F.col("m.first")).cast("long").alias("lag"), "m.r", "m.n")
    lo, hi = fisher_interval(F.col("r"), F.col("n"), alpha)
    return best.withColumn("lo", lo).withColumn("hi", hi).withColumn("significant", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))


def false_discovery(tests: DataFrame, p: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: adds ``reject``, true for every p not above the largest p(k) with p(k) <= alpha k / m.

    Ranks come from counts of distinct p values, a small table where p values are rounded, and not from one window over all tests.
    """
    keys = list(by or [])
    levels = tests.groupBy(*keys, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*keys).orderBy("__p") if keys else Window.orderBy("__p")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ranked = levels.withColumn("__k", F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__m", F.sum("__c").over(whole))
    cut = ranked.where(F.col("__p") <= F.lit(alpha) * F.col("__k") / F.col("__m")).groupBy(*keys).agg(F.max("__p").alias("__cut"))
    joined = tests.join(cut, keys, "left") if keys else tests.crossJoin(F.broadcast(cut.agg(F.max("__cut").alias("__cut"))))
    return joined.withColumn("reject", F.coalesce(F.col(p) <= F.col("__cut"), F.lit(False))).drop("__cut")


def t_pvalue(r: float, n: int) -> float:
    """Two-sided p of a correlation under the t distribution (1 where it has no degree of freedom)."""
    df = n - 2
    if df <= 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * df / (1 - r * r)
    return _beta(df / 2, 0.5, df / (df + t2))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def surrogate(x: np.ndarray, method: str, rng: np.random.Generator, block: int = 10, rounds: int = 50) -> np.ndarray:
    """One surrogate: shuffled, of random phases, circularly shifted, amplitude-adjusted (iterated), or of resampled blocks."""
    n = len(x)
    if method == "shuffle":
        return rng.permutation(x)
    if method == "circular":
        return np.roll(x, int(rng.integers(0, n)))
    if method == "phase":
        s = np.fft.rfft(x)
        turn = rng.uniform(0, 2 * np.pi, len(s))
        turn[0] = 0
        if n % 2 == 0:
            turn[-1] = 0
        return np.fft.irfft(s * np.exp(1j * turn), n)
    if method == "iaaft":
        level, size = np.sort(x), np.abs(np.fft.rfft(x))
        y = rng.permutation(x)
        for _ in range(rounds):
            s = np.fft.rfft(y)
            y = np.fft.irfft(size * np.exp(1j * np.angle(s)), n)
            y = level[np.argsort(np.argsort(y, kind="stable"), kind="stable")]
        return y
    if method == "block_bootstrap":
        b = min(block, n)
        starts = rng.integers(0, n - b + 1, -(-n // b))
        return np.concatenate([x[s : s + b] for s in starts])[:n]
    raise ValueError(f"method must be one of {SURROGATES}")


def surrogates(points: DataFrame, method: str = "shuffle", count: int = 20, seed: int = 42) -> DataFrame:
    """``series_id struct(series_id, k), t, value``: ``count`` surrogates of every series, each a series of its own.

    A surrogate is made in its own group from the packed series, so the work spreads over series times count.
    """
    kind = points.schema["series_id"].dataType.simpleString()
    packed = points.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda p: p["value"]).alias("x"), F.xxhash64("series_id").alias("h"))
    spread = packed.select("series_id", "x", "h", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))

    def make(batches):
        for pdf in batches:
            for sid, x, h, k in zip(pdf["series_id"], pdf["x"], pdf["h"], pdf["k"]):
                rng = np.random.default_rng([seed, int(k), int(h) & 0xFFFFFFFF])
                y = surrogate(np.asarray(x, dtype=np.float64), method, rng)
                yield pd.DataFrame({"sid": [sid] * len(y), "k": np.int32(k), "t": np.arange(len(y)), "value": y})

    flat = spread.repartition("series_id", "k").mapInPandas(make, f"sid {kind}, k int, t long, value double")
    return flat.select(F.struct(F.col("sid").alias("series_id"), "k").alias("series_id"), "t", "value")


def metric_significance(points: DataFrame, metric: Callable[[DataFrame], DataFrame], names: list[str], method: str = "shuffle", count: int = 20, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``series_id, metric, observed, null_mean, null_std, z, p, lo, hi, significant``.

    ``metric`` maps points to one row per series with the columns ``names``; it is applied once to the series
    and once to all their surrogates together.  The spread has ddof 1 and a floor of 1e-12; p is two-sided normal.
    """

    def long(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])))

    observed = long(metric(points), "series_id").withColumnRenamed("v", "observed")
    null = long(metric(surrogates(points, method, count, seed)), "series_id").select(F.col("series_id.series_id").alias("series_id"), "metric", "v")
    stats = null.groupBy("series_id", "metric").agg(F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_std"))
    z = (F.col("observed") - F.col("null_mean")) / F.greatest("null_std", F.lit(1e-12))
    q = NormalDist().inv_cdf(1 - alpha / 2)

    @F.pandas_udf("double")
    def two_sided(zs: pd.Series) -> pd.Series:
        return zs.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else float("nan"))

    out = observed.join(stats, ["series_id", "metric"]).withColumn("z", z).withColumn("p", two_sided(F.col("z")))
    return out.withColumn("lo", F.col("null_mean") - q * F.col("null_std")).withColumn("hi", F.col("null_mean") + q * F.col("null_std")).withColumn("significant", F.col("p") < alpha)


def permutation_pvalues(pairs: DataFrame, count: int = 199, seed: int = 42, max_lag: int = 0) -> DataFrame:
    """``series_id, r, p``: correlation (or its greatest value over lags) against shuffled partners, p = (hits + 1) / (count + 1)."""
    kind = pairs.schema["series_id"].dataType.simpleString()

    def score(x: np.ndarray, y: np.ndarray) -> float:
        if not max_lag:
            return abs(float(np.corrcoef(x, y)[0, 1]))
        best = -1.0
        for k in range(-max_lag, max_lag + 1):
            a, b = (x[k:], y[: len(y) - k]) if k >= 0 else (x[: len(x) + k], y[-k:])
            if len(a) > 3:
                best = max(best, float(np.corrcoef(a, b)[0, 1]))
        return best

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        rng = np.random.default_rng(seed)
        r = score(x, y)
        hits = sum(score(x, rng.permutation(y)) >= r for _ in range(count))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1].tolist(), "r": [r], "p": [(hits + 1) / (count + 1)]})

    return pairs.groupBy("series_id").applyInPandas(run, f"series_id {kind}, r double, p double")


def zscores(observed: DataFrame, null: DataFrame, ddof: int = 1) -> DataFrame:
    """``series_id, z, null_mean, null_std`` of ``observed`` (series_id, v) against rows of ``null`` (series_id, v)."""
    sd = F.stddev_samp("v") if ddof else F.stddev_pop("v")
    n = null.groupBy("series_id").agg(F.avg("v").alias("null_mean"), sd.alias("null_std"))
    return observed.join(n, "series_id").select("series_id", ((F.col("v") - F.col("null_mean")) / F.greatest("null_std", F.lit(1e-12))).alias("z"), "null_mean", "null_std")


def link_significance(d: DataFrame, epsilon: float, alpha: float = 0.05) -> DataFrame:
    """``i, j, dist, p, significant``: links (distance at most epsilon) against random relabelling of the series.

    Under a random permutation of rows and columns every pair is as likely to sit at (i, j), so p, one minus the share
    of permutations with a distance of at most epsilon there, is exactly the share of all pairs above epsilon;
    no drawing is needed.  The one-row share goes to all tasks.
    """
    share = d.agg(F.avg((F.col("dist") > epsilon).cast("double")).alias("p"))
    return d.crossJoin(F.broadcast(share)).select("i", "j", "dist", "p", ((F.col("dist") <= epsilon) & (F.col("p") < alpha)).alias("significant"))


def motif_zscores(nodes: DataFrame, edges: DataFrame, count: int = 10, seed: int = 42) -> DataFrame:
    """``series_id, observed, null_mean, null_std, z`` of the triangle count against degree-preserving double edge swaps."""
    from wavelattice.operators.graphpaths import _per_graph

    def triangles(n: int, pairs: set[tuple[int, int]]) -> int:
        near: list[set[int]] = [set() for _ in range(n)]
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        return sum(len(near[a] & near[b]) for a, b in pairs) // 3

    def fn(own, u, v):
        n = len(own)
        real = set(zip(u.tolist(), v.tolist()))
        rng = np.random.default_rng(seed)
        null = []
        for _ in range(count):
            pairs, listed = set(real), list(real)
            listed.sort()
            for _ in range(5 * len(listed)):
                i, j = rng.integers(0, len(listed), 2)
                (a, b), (c, e) = listed[i], listed[j]
                if rng.random() < 0.5:
                    c, e = e, c
                p, q = (min(a, e), max(a, e)), (min(c, b), max(c, b))
                if len({a, b, c, e}) == 4 and p not in pairs and q not in pairs:
                    pairs -= {listed[i], listed[j]}
                    pairs |= {p, q}
                    listed[i], listed[j] = p, q
            null.append(triangles(n, pairs))
        sd = float(np.std(null, ddof=1)) if count > 1 else 0.0
        t = triangles(n, real)
        return pd.DataFrame({"observed": [t], "null_mean": [float(np.mean(null))], "null_std": [sd], "z": [(t - float(np.mean(null))) / max(sd, 1e-12)]})

    return _per_graph(nodes, edges, fn, "observed long, null_mean double, null_std double, z double")


def partial_correlations(panel: DataFrame, most_series: int = 2_000) -> DataFrame:
    """``i, j, r``: partial correlation of all pairs given the others, from the inverse of the correlation matrix.

    The matrix is small by its definition (an error beyond ``most_series`` series); its entries are made by Spark.
    """
    from wavelattice.operators.distances import pair_distances

    names = sorted(r[0] for r in panel.select("series_id").distinct().limit(most_series + 1).collect())
    if len(names) > most_series:
        raise ValueError(f"more than {most_series} series")
    at = {s: k for k, s in enumerate(names)}
    m = np.eye(len(names))
    for i, j, v in pair_distances(panel, _signed).collect():
        m[at[i], at[j]] = m[at[j], at[i]] = v
    inv = np.linalg.pinv(m)
    rows = [(a, b, float(-inv[at[a], at[b]] / np.sqrt(inv[at[a], at[a]] * inv[at[b], at[b]]))) for a in names for b in names if a < b]
    kind = panel.schema["series_id"].dataType.simpleString()
    return panel.sparkSession.createDataFrame(rows, f"i {kind}, j {kind}, r double")


def _signed(x, y):
    return float(np.corrcoef(x, y)[0, 1])


def moran(values: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: Moran's I of ``node, value`` under ``i, j, weight`` (both directions listed); null without weights."""
    mu = values.agg(F.avg("value").alias("mu"), F.count(F.lit(1)).alias("n"))
    z = values.crossJoin(F.broadcast(mu)).select("node", (F.col("value") - F.col("mu")).alias("z"), "n")
    w = weights.join(z.select(F.col("node").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("node").alias("j"), F.col("z").alias("zj")), "j")
    s = w.agg(F.sum("weight").alias("s0"), F.sum(F.col("weight") * F.col("zi") * F.col("zj")).alias("wz"))
    v = z.agg(F.sum(F.col("z") * F.col("z")).alias("v"), F.max("n").alias("n"))
    return s.crossJoin(F.broadcast(v)).select(F.when(F.col("s0") > 0, F.col("n") / F.col("s0") * F.col("wz") / F.col("v")).alias("moran_i"))
