"""Distances between series of a panel and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _z(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / (x.std() + 1e-10)


def correlation(x, y):
    """1 - |r| (nan for a constant series, which becomes null in a table)."""
    if x.std() == 0 or y.std() == 0:
        return np.nan
    return 1 - abs(float(np.corrcoef(x, y)[0, 1]))


def overlap_correlation(x, y):
    """1 - |r| over the places where both have a value (see ``aligned``; nan where fewer than two, or constant there)."""
    both = ~(np.isnan(x) | np.isnan(y))
    return correlation(x[both], y[both]) if both.sum() > 1 else np.nan


def _overlap_tiles(left: list[np.ndarray], right: list[np.ndarray]) -> Callable[[int, int], np.ndarray]:
    """``overlap_correlation`` of ``left[lo:hi]`` with all of ``right``, by matrix products of the values and of their masks (inf where no place has both)."""

    def parts(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack(xs)
        has = ~np.isnan(m)
        m = np.where(has, m, 0.0)
        return np.where(has, m - m.sum(1, keepdims=True) / np.maximum(has.sum(1, keepdims=True), 1), 0.0), has.astype(np.float64)

    (a, has_a), (b, has_b) = parts(left), parts(right)
    ways, k = np.concatenate([has_b, b, b * b]).T, len(b)

    def tile(lo: int, hi: int) -> np.ndarray:
        x = a[lo:hi]
        own = has_a[lo:hi] @ ways
        n, sb, qb = own[:, :k], own[:, k : 2 * k], own[:, 2 * k :]
        sa, qa = x @ ways[:, :k], (x * x) @ ways[:, :k]
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb, cov = qa - sa * sa / n, qb - sb * sb / n, x @ ways[:, k : 2 * k] - sa * sb / n
            good = (n > 1) & (va > 1e-12 * qa) & (vb > 1e-12 * qb)  # else constant where both have a value
            out = np.where(good, 1 - np.minimum(np.abs(cov / np.sqrt(va * vb)), 1), np.nan)
        out[n == 0] = np.inf
        return out

    return tile


def cross_correlation(x, y, max_lag=None):
    """1 - the greatest |cross-correlation| of the standardised series over all lags."""
    n = len(x)
    full = np.correlate(_z(x), _z(y), "full") / n
    if max_lag is not None:
        full = full[n - 1 - max_lag : n + max_lag]
    return 1 - float(np.abs(full).max())


def dtw(x, y, window=None, normalise=True, squared=False):
    """Dynamic time warping with absolute (or squared) cost in a band; infinite where the band is too narrow."""
    n, m = len(x), len(y)
    band = max(n, m) if window is None else window
    if band < abs(n - m):
        if not squared:
            return np.inf
        band = abs(n - m)
    prev = np.full(m + 1, np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        cur = np.full(m + 1, np.inf)
        lo, hi = max(1, i - band), min(m, i + band)
        cost = x[i - 1] - y[lo - 1 : hi]
        cost = cost * cost if squared else np.abs(cost)
        best = np.minimum(prev[lo : hi + 1], prev[lo - 1 : hi])
        left = np.inf
        for j in range(hi - lo + 1):
            left = cost[j] + min(best[j], left)
            cur[lo + j] = left
        prev = cur
    total = float(prev[m])
    if squared:
        return total**0.5
    return total / (n + m) if normalise else total


def _codes(x, bins):
    lo, hi = x.min(), x.max()
    edges = lo + np.arange(1, bins) * (hi - lo) / bins
    return (edges[None, :] <= x[:, None]).sum(1)


def _entropies(x, y, bins):
    joint = np.zeros((bins, bins))
    np.add.at(joint, (_codes(x, bins), _codes(y, bins)), 1)
    joint /= joint.sum()

    def h(p):
        p = p[p > 0]
        return float(-(p * np.log(p)).sum())

    return h(joint.sum(1)), h(joint.sum(0)), h(joint.ravel())


def mutual_information(x, y, bins=10):
    """1 - 2 I / (Hx + Hy) on equal-width codes (1 where both are constant)."""
    hx, hy, hxy = _entropies(x, y, bins)
    return 1 - 2 * (hx + hy - hxy) / (hx + hy) if hx + hy > 0 else 1.0


def variation_of_information(x, y, bins=10):
    """Hx + Hy - 2 I on equal-width codes."""
    hx, hy, hxy = _entropies(x, y, bins)
    return 2 * hxy - hx - hy


def event_synchronisation(x, y, threshold=None, tau=1):
    """1 - 2 c / (nx + ny): events above x's median in both; c of x's have one of y's within tau."""
    t = float(np.median(x)) if threshold is None else threshold
    ex, ey = np.flatnonzero(x > t), np.flatnonzero(y > t)
    if not len(ex) or not len(ey):
        return 1.0
    c = int((np.abs(ex[:, None] - ey[None, :]).min(1) <= tau).sum())
    return 1 - 2 * c / (len(ex) + len(ey))


def van_rossum(x, y, tau=1.0, threshold=None):
    """Distance of spike trains (values above the own median) after two-sided exponential smoothing."""

    def smooth(v):
        s = np.flatnonzero(v > (np.median(v) if threshold is None else threshold))
        return np.exp(-np.abs(np.arange(len(v))[:, None] - s[None, :]) / tau).sum(1) if len(s) else np.zeros(len(v))

    fx, fy = smooth(x), smooth(y)
    norm = float(np.sqrt((fx**2).sum() + (fy**2).sum()))
    return float(np.sqrt(((fx - fy) ** 2).sum())) / norm if norm > 0 else 0.0


def maximal_information(x, y, alpha=0.6):
    """1 - the greatest normalised mutual information over equal-frequency grids of at most n^alpha cells."""
    n = len(x)
    limit = max(4.0, n**alpha)
    rx, ry = (np.argsort(np.argsort(v, kind="stable"), kind="stable") for v in (x, y))
    best = 0.0
    for a in range(2, int(limit // 2) + 1):
        for b in range(2, int(limit // a) + 1):
            joint = np.zeros((a, b))
            np.add.at(joint, (rx * a // n, ry * b // n), 1.0 / n)
            outer = joint.sum(1)[:, None] * joint.sum(0)[None, :]
            p = joint > 0
            best = max(best, float((joint[p] * np.log(joint[p] / outer[p])).sum()) / np.log(min(a, b)))
    return 1 - best


def _ranks(x):
    return pd.Series(x).rank().to_numpy()


def metric_correlation(x, y, method="pearson", absolute=False):
    """sqrt(2 (1 - r)), of ranks for spearman, of |r| where absolute."""
    a, b = (_ranks(x), _ranks(y)) if method == "spearman" else (x, y)
    if a.std() == 0 or b.std() == 0:
        return np.nan
    r = float(np.corrcoef(a, b)[0, 1])
    return float(np.sqrt(max(0.0, 2 * (1 - (abs(r) if absolute else r)))))


def metric_cross_correlation(x, y, max_lag=10):
    """sqrt(2 (1 - greatest |r|)) over lags within max_lag, r of the overlapping parts."""
    best = 0.0
    for k in range(-max_lag, max_lag + 1):
        a, b = (x[k:], y[: len(y) - k]) if k >= 0 else (x[: len(x) + k], y[-k:])
        if len(a) > 2 and a.std() > 0 and b.std() > 0:
            best = max(best, abs(float(np.corrcoef(a, b)[0, 1])))
    return float(np.sqrt(max(0.0, 2 * (1 - best))))


def euclidean(x, y):
    return float(np.sqrt(((x - y) ** 2).sum()))


#: Name -> function of two arrays; a user may add their own (UF5).
REGISTRY: dict[str, Callable[..., float]] = {
    "correlation": correlation, "cor": correlation, "ccf": cross_correlation, "cross_correlation": cross_correlation, "dtw": dtw,
    "nmi": mutual_information, "mutual_information": mutual_information, "voi": variation_of_information, "variation_of_information": variation_of_information,
    "es": event_synchronisation, "event_sync": event_synchronisation, "vr": van_rossum, "van_rossum": van_rossum, "mic": maximal_information,
    "metric_correlation": metric_correlation, "metric_ccf": metric_cross_correlation, "euclidean": euclidean, "overlap_correlation": overlap_correlation,
}


def pack(panel: DataFrame) -> DataFrame:
    """``series_id, x array<double>``: each series' values in order."""
    return panel.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda p: p["value"]).alias("x"))


def aligned(panel: DataFrame) -> DataFrame:
    """Every series at every ``t`` of the panel, nan where it has no value there."""
    every = panel.select("series_id").distinct().crossJoin(panel.select("t").distinct())
    return every.join(panel, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("value", F.lit(float("nan"))).alias("value"))


#: Pairs of one Arrow batch that leaves a task; bytes of a block's series.
TILE_PAIRS, BLOCK_BYTES = 500_000, 48_000_000


def pair_tiles(packed: DataFrame, tiles: Callable[[list, list], Callable[[int, int], np.ndarray]], least: int = 256, most: int = 8_192, decimals: int | None = None) -> DataFrame:
    """``i, j, dist`` with i < j for all pairs of ``series_id, x array<double>`` by a symmetric distance.

    ``tiles(left, right)`` gives a function of (lo, hi) with the distances of ``left[lo:hi]`` to all of ``right``; nan becomes
    null, and pairs of infinite distance are left out.  Series are dealt into blocks, each pair of blocks is one Arrow group, and a
    series is sent once per block: so blocks have ``least`` series or more, up to 16 blocks, and only ``most`` series or
    ``BLOCK_BYTES`` make more than 16.  Pairs leave a task in batches, its memory is two blocks and one batch.
    """
    kind = packed.schema["series_id"].dataType.simpleString()
    n, size = packed.agg(F.count(F.lit(1)), F.sum(8 * F.size("x") + 16)).first()
    blocks = max(1, min(-(-n // least), 16), -(-n // most), -(-(size or 0) // BLOCK_BYTES))
    dealt = packed.withColumn("b", F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int"))
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = dealt.select("series_id", "x", "b", F.explode(other).alias("o")).select("series_id", "x", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        order = rows["series_id"].to_pandas().argsort(kind="stable").to_numpy()
        rows = rows.take(pa.array(order))  # places are in order of the ids
        ids, x, own = rows["series_id"].combine_chunks(), rows["x"].combine_chunks(), rows["b"].to_numpy()
        xs = np.split(x.flatten().to_numpy(zero_copy_only=False), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        same = rows["p"][0].as_py() == rows["q"][0].as_py()
        a = np.flatnonzero(own == rows["p"][0].as_py())
        b = a if same else np.flatnonzero(own == rows["q"][0].as_py())
        if not len(a) or not len(b):
            return
        tile = tiles([xs[k] for k in a], [xs[k] for k in b])
        step = max(1, TILE_PAIRS // len(b))
        for lo in range(0, len(a), step):
            d = tile(lo, min(lo + step, len(a)))
            u, v = np.broadcast_arrays(a[lo : lo + step, None], b[None, :])
            keep = ~np.isinf(d)
            if same:
                keep &= u < v
            d, u, v = d[keep], u[keep], v[keep]
            if decimals is not None:
                d = np.floor(d * 10.0**decimals + 0.5) / 10.0**decimals
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.minimum(u, v))), ids.take(pa.array(np.maximum(u, v))), pa.array(d, from_pandas=True)], ["i", "j", "dist"])

    return sent.groupBy("p", "q").applyInArrow(work, f"i {kind}, j {kind}, dist double")


def pair_distances(panel: DataFrame, method: str | Callable[..., float] = "correlation", block: int = 256, only: list | None = None, **options) -> DataFrame:
    """``i, j, dist`` with i < j for all pairs of series of a panel ``series_id, t, value``.

    Packed series are dealt into blocks of about ``block``; each pair of blocks is one Arrow group,
    so a series is sent once per block of partners instead of once per partner, and no task holds
    more than two blocks.  Correlations of a block pair are one matrix product.  ``only`` keeps the
    rows of these i (a partial job).  Series of one panel have equal length, but for dtw.
    ``overlap_correlation`` goes by ``pair_tiles`` and has no row for series that share no place.
    """
    fn = REGISTRY[method] if isinstance(method, str) else method
    name = getattr(fn, "__name__", "")
    kind = panel.schema["series_id"].dataType.simpleString()
    packed = pack(panel)
    if name == "overlap_correlation":
        out = pair_tiles(packed, _overlap_tiles, block, **options)
        return out.where(F.col("i").isin(only)) if only is not None else out
    n = packed.count()
    blocks = max(1, -(-n // block))
    dealt = packed.withColumn("b", F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int"))
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = dealt.select("series_id", "x", "b", F.explode(other).alias("o")).select("series_id", "x", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, own = pdf["series_id"].tolist(), pdf["b"].tolist()
        xs = [np.asarray(x, dtype=np.float64) for x in pdf["x"]]
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        fast = None
        if name == "correlation" and len({len(x) for x in xs}) == 1 and len(xs):
            m = np.stack(xs)
            sd = m.std(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.where(sd > 0, (m - m.mean(1, keepdims=True)) / sd, np.nan)
            fast = 1 - np.abs(np.clip(z @ z.T / m.shape[1], -1, 1))
        rows = []
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                if p != q and own[a] == own[b]:
                    continue  # that pair belongs to its own block
                i, j = (a, b) if ids[a] < ids[b] else (b, a)
                rows.append((ids[i], ids[j], float(fast[i, j]) if fast is not None else float(fn(xs[i], xs[j], **options))))
        return pd.DataFrame(rows, columns=["i", "j", "dist"])

    out = sent.groupBy("p", "q").applyInPandas(work, f"i {kind}, j {kind}, dist double")
    return out.where(F.col("i").isin(only)) if only is not None else out


def both_triangles(d: DataFrame) -> DataFrame:
    """The distances in either direction."""
    return d.unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))


def distance_percentile(d: DataFrame, q: float) -> DataFrame:
    """One row: the q-th percentile of the pair distances, interpolated."""
    return d.agg(F.percentile("dist", F.lit(q / 100)).alias("value"))


def normalise_distances(d: DataFrame, n: int, how: str = "minmax") -> DataFrame:
    """Distances scaled by all entries of the full matrix, its zero diagonal included (min-max, or z with ddof 0)."""
    stats = d.agg(F.max("dist").alias("hi"), F.least(F.min("dist"), F.lit(0.0)).alias("lo"), (F.sum("dist") * 2 / (n * n)).alias("mu"), (F.sum(F.col("dist") * F.col("dist")) * 2 / (n * n)).alias("sq"))
    both = d.crossJoin(F.broadcast(stats))  # one row
    if how == "minmax":
        return both.select("i", "j", F.when(F.col("hi") > F.col("lo"), (F.col("dist") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("dist"))
    sd = F.sqrt(F.col("sq") - F.col("mu") * F.col("mu"))
    return both.select("i", "j", F.when(sd > 0, (F.col("dist") - F.col("mu")) / sd).otherwise(0.0).alias("dist"))


# --- networks of series (N1-N12) ---


def knn_network(d: DataFrame, k: int, mutual: bool = False, directed: bool = False) -> DataFrame:
    """``i, j, dist``: the k nearest of each series (ties by the smaller id); undirected by default, mutual ones only where asked."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    arcs = both_triangles(d).withColumn("r", rank).where(F.col("r") <= k).select("i", "j", "dist")
    if directed and not mutual:
        return arcs
    both = arcs.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("n"))
    both = both.where("n = 2") if mutual else both
    return both.select(F.col("a").alias("i"), F.col("b").alias("j"), "dist")


def epsilon_network(d: DataFrame, epsilon: float | None = None, percentile: float | None = None, closed: bool = False) -> DataFrame:
    """Pairs nearer than epsilon (or the percentile of all pairs); ``closed`` takes equality in."""
    if (epsilon is None) == (percentile is None):
        raise ValueError("give epsilon or percentile")
    e = d.crossJoin(F.broadcast(distance_percentile(d, percentile).withColumnRenamed("value", "eps"))) if epsilon is None else d.withColumn("eps", F.lit(float(epsilon)))
    return e.where((F.col("dist") <= F.col("eps")) if closed else (F.col("dist") < F.col("eps"))).select("i", "j", "dist")


def weighted_network(d: DataFrame, threshold: float | None = None, weight=None) -> DataFrame:
    """All pairs with a positive distance (at most ``threshold``); ``weight`` maps the distance column, e.g. 1 / (1 + d)."""
    out = d.where(F.col("dist") > 0)
    if threshold is not None:
        out = out.where(F.col("dist") <= threshold)
    return out.select("i", "j", "dist", (weight(F.col("dist")) if weight else F.col("dist")).alias("weight"))


def density_network(d: DataFrame, density: float) -> DataFrame:
    """Pairs within the exact distance that gives the wanted density."""
    return epsilon_network(d, percentile=100 * density, closed=True)


def nearest_vectors(vectors: DataFrame, k: int, block: int = 2_048) -> DataFrame:
    """``i, j, dist``: the k nearest others of each vector ``id, vec array<double>`` (Euclidean, ties by the smaller id).

    Exact: blocks of vectors meet in pairs, a pair's distances are one matrix product, and only the k best
    of each row leave the task; a second step takes the best over blocks.  This stands in for a
    neighbour-descent index, whose result it bounds from above in every case.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = dealt.select("id", "vec", F.lit(0).alias("side"), F.col("b").alias("p"), F.explode(others).alias("q"))
    right = dealt.select("id", "vec", F.lit(1).alias("side"), F.explode(others).alias("p"), F.col("b").alias("q"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        own, far = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        empty = pd.DataFrame({"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "dist": np.empty(0)})
        if not len(own) or not len(far):
            return empty
        a, b = np.stack(own["vec"].to_numpy()), np.stack(far["vec"].to_numpy())
        ia, ib = own["id"].to_numpy(np.int64), far["id"].to_numpy(np.int64)
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        square[ia[:, None] == ib[None, :]] = np.inf
        m = min(k + 16, square.shape[1])  # a few more than k, for what rounding of the product may swap
        near = np.argpartition(square, m - 1, axis=1)[:, :m] if m < square.shape[1] else np.tile(np.arange(m), (len(a), 1))
        dist = np.sqrt(((a[:, None, :] - b[near]) ** 2).sum(2))
        dist[np.isinf(np.take_along_axis(square, near, 1))] = np.inf
        order = np.lexsort((ib[near], dist), axis=1)[:, :k]
        out = pd.DataFrame({"i": np.repeat(ia, order.shape[1]), "j": ib[np.take_along_axis(near, order, 1)].ravel(), "dist": np.take_along_axis(dist, order, 1).ravel()})
        return out[np.isfinite(out["dist"])]

    found = left.unionByName(right).groupBy("p", "q").applyInPandas(work, "i long, j long, dist double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def nearest_within(vectors: DataFrame, k: int, epsilon: float, block: int = 2_048) -> DataFrame:
    """``i, j, dist``: those of the k nearest that are nearer than epsilon."""
    return nearest_vectors(vectors, k, block).where(F.col("dist") < epsilon)
