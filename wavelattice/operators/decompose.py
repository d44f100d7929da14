"""Structural decomposition, window embeddings, simulated dynamics and network inference (M1-M6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.operators.grouped import stream_groups


def _system(level: bool, trend: bool, period: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Transition, observation and the places that receive noise."""
    blocks: list[np.ndarray] = []
    seen: list[float] = []
    noisy: list[int] = []
    if level:
        noisy.append(0)
        if trend:
            noisy.append(1)
            blocks.append(np.array([[1.0, 1.0], [0.0, 1.0]]))
            seen += [1.0, 0.0]
        else:
            blocks.append(np.array([[1.0]]))
            seen += [1.0]
    if period > 1:
        s = np.zeros((period - 1, period - 1))
        s[0] = -1.0
        s[np.arange(1, period - 1), np.arange(period - 2)] = 1.0
        noisy.append(len(seen))
        blocks.append(s)
        seen += [1.0] + [0.0] * (period - 2)
    t = np.zeros((len(seen), len(seen)))
    at = 0
    for b in blocks:
        t[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return t, np.array(seen), noisy


def _filter(x: np.ndarray, live: np.ndarray, t: np.ndarray, z: np.ndarray, noisy: list[int], ratios: np.ndarray, keep: bool = False):
    """Kalman filter of many series at once, observation variance 1: concentrated likelihoods, scales, and the passes for smoothing.

    ``x`` has a row per series, padded at its end; ``live`` tells the real values.
    """
    s, n = x.shape
    k = len(z)
    q = np.zeros((s, k, k))
    q[:, noisy, noisy] = ratios
    a, p = np.zeros((s, k)), np.tile(np.eye(k) * 1e6, (s, 1, 1))
    total, logs, used = np.zeros(s), np.zeros(s), np.zeros(s)
    passes = []
    for i in range(n):
        pz = p @ z
        f = pz @ z + 1.0
        e = x[:, i] - a @ z
        g = pz / f[:, None]
        if keep:
            passes.append((a, p, e, f, g))
        if i >= k:
            m = live[:, i]
            total += np.where(m, e * e / f, 0.0)
            logs += np.where(m, np.log(f), 0.0)
            used += m
        a = (a + g * e[:, None]) @ t.T
        p = t @ (p - g[:, :, None] * pz[:, None, :]) @ t.T + q
    scale = total / np.maximum(1, used)
    return -0.5 * (used * np.log(np.maximum(scale, 1e-300)) + logs), scale, passes


def structural(x: np.ndarray, live: np.ndarray, trend: bool = False, period: int = 0, rounds: int = 2, steps: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed level, trend and seasonal part of many series (rows of ``x``) by maximum likelihood.

    Variances relative to the observation's are found by golden sections over their logarithms, one after
    another, for all series side by side.
    """
    t, z, noisy = _system(True, trend, period)
    s, n = x.shape
    ratios = np.full((s, len(noisy)), 0.1)
    golden = (5**0.5 - 1) / 2
    for _ in range(rounds):
        for j in range(len(noisy)):

            def score(v: np.ndarray, j: int = j) -> np.ndarray:
                trial = ratios.copy()
                trial[:, j] = np.exp(v)
                return _filter(x, live, t, z, noisy, trial)[0]

            lo, hi = np.full(s, -14.0), np.full(s, 6.0)
            c, d = hi - golden * (hi - lo), lo + golden * (hi - lo)
            fc, fd = score(c), score(d)
            for _ in range(steps):
                left = fc > fd
                lo, hi = np.where(left, lo, c), np.where(left, d, hi)
                new = np.where(left, hi - golden * (hi - lo), lo + golden * (hi - lo))
                fn = score(new)
                c, d, fc, fd = np.where(left, new, d), np.where(left, c, new), np.where(left, fn, fd), np.where(left, fc, fn)
            ratios[:, j] = np.exp((lo + hi) / 2)
    passes = _filter(x, live, t, z, noisy, ratios, keep=True)[2]
    states = np.zeros((n, s, len(z)))
    back = np.zeros((s, len(z)))
    for i in range(n - 1, -1, -1):
        a, p, e, f, g = passes[i]
        tb = back @ t
        back = np.where(live[:, i][:, None], z * (e / f - (g * tb).sum(1))[:, None] + tb, 0.0)
        states[i] = a + np.einsum("sij,sj->si", p, back)
    level = states[:, :, 0].T
    slope = states[:, :, 1].T if trend else np.zeros((s, n))
    season = states[:, :, 2 if trend else 1].T if period > 1 else np.zeros((s, n))
    return level, slope, season


def decompose(points: DataFrame, trend: bool = False, period: int = 0, standardise: bool = False) -> DataFrame:
    """``series_id, t, level, trend, seasonal, residual`` of every series of at least 10 points that varies; others have no rows.

    The series that an Arrow batch completes are filtered side by side.
    """
    kind = points.schema["series_id"].dataType.simpleString()

    def fit(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        v = rows["value"].to_numpy(np.float64)
        ends = np.r_[starts[1:], len(v)]
        spans = [(lo, hi) for lo, hi in zip(starts, ends) if hi - lo >= 10 and v[lo:hi].std() > 0]
        at = np.concatenate([np.arange(lo, hi) for lo, hi in spans]) if spans else np.empty(0, dtype=np.int64)
        parts = {c: np.empty(0) for c in ("level", "trend", "seasonal", "residual")}
        if spans:
            n = max(hi - lo for lo, hi in spans)
            live = np.arange(n)[None, :] < np.array([hi - lo for lo, hi in spans])[:, None]
            x = np.zeros(live.shape)
            x[live] = v[at]
            level, slope, season = structural(x, live, trend, period)
            rest = x - level - season
            if standardise:
                size = live.sum(1, keepdims=True)
                mean = np.where(live, rest, 0).sum(1, keepdims=True) / size
                sd = np.sqrt((np.where(live, rest - mean, 0) ** 2).sum(1, keepdims=True) / size)
                rest = (rest - mean) / np.where(sd > 0, sd, 1.0)
            parts = {"level": level[live], "trend": slope[live], "seasonal": season[live], "residual": rest[live]}
        return pd.DataFrame({"series_id": rows["series_id"].to_numpy()[at], "t": rows["t"].to_numpy()[at]} | parts)

    return stream_groups(points.select("series_id", "t", "value"), ["series_id"], "t", fit, f"series_id {kind}, t long, level double, trend double, seasonal double, residual double")


def structural_stats(parts: DataFrame) -> DataFrame:
    """Seasonal strength (seasonal variance over that of level and residual), residual spread and lag-1 correlation per series."""
    from wavelattice.operators.windows import lag_autocorrelation

    s = parts.groupBy("series_id").agg(F.var_pop("seasonal").alias("vs"), F.var_pop(F.col("level") + F.col("residual")).alias("vr"), F.stddev_pop("residual").alias("residual_std"))
    lag1 = lag_autocorrelation(parts.select("series_id", "t", F.col("residual").alias("value")))
    return s.join(lag1, "series_id").select("series_id", F.when(F.col("vr") > 0, F.col("vs") / F.col("vr")).otherwise(0.0).alias("seasonal_strength"), "residual_std", F.col("autocorrelation").alias("residual_lag1"))


def residual_features(points: DataFrame, width: int = 20, trend: bool = False, period: int = 0) -> DataFrame:
    """Median and quartiles of the visibility degree over non-overlapping windows of the residuals, per series."""
    from wavelattice.operators.visibility import hvg_edges
    from wavelattice.operators.windows import windowed_graph_stats

    res = decompose(points, trend, period).select("series_id", "t", F.col("residual").alias("value"))
    w = windowed_graph_stats(res, width, width, hvg_edges)
    q = F.percentile("avg_degree", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return w.groupBy("series_id").agg(q.alias("q"), F.percentile("n_edges", F.lit(0.5)).alias("median_edges"), F.count(F.lit(1)).alias("n_windows")).select(
        "series_id", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "median_edges", "n_windows"
    )


def convolution_embeddings(windows: DataFrame, channels: tuple[int, ...] = (32, 64, 64), kernel: int = 5, dilations: tuple[int, ...] = (1, 2, 4), seed: int = 7) -> DataFrame:
    """``series_id, window_id, embedding array<float>``: a seeded, untrained stack of causal dilated convolutions, averaged over time."""
    kind = windows.schema["series_id"].dataType.simpleString()
    packed = windows.groupBy("series_id", "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]).alias("x"))

    def embed(batches):
        rng = np.random.default_rng(seed)
        layers, width = [], 1
        for c in channels:
            layers.append((rng.normal(0, (2 / (width * kernel)) ** 0.5, (c, width, kernel)), np.zeros(c)))
            width = c
        for pdf in batches:
            out = []
            for x in pdf["x"]:
                h = np.asarray(x, dtype=np.float64)[None, :]
                h = (h - h.mean()) / (h.std() + 1e-8)
                for (w, b), d in zip(layers, dilations):
                    pad = np.pad(h, ((0, 0), ((kernel - 1) * d, 0)))
                    n = h.shape[1]
                    h = np.maximum(sum(w[:, :, k] @ pad[:, k * d : k * d + n] for k in range(kernel)) + b[:, None], 0)
                out.append(h.mean(1).astype(np.float32))
            yield pd.DataFrame({"series_id": pdf["series_id"], "window_id": pdf["window_id"], "embedding": out})

    return packed.mapInPandas(embed, f"series_id {kind}, window_id long, embedding array<float>")


def simulate(spark, adjacency: list[list[float]], model: str = "kuramoto", steps: int = 200, dt: float = 0.01, runs: int = 1, coupling: float = 1.0, seed: int = 42) -> DataFrame:
    """``run, step, node, x``: Euler steps of coupled phases (kuramoto) or of dx/dt = -x + A x (linear), each run in its own task."""
    if model not in ("kuramoto", "linear"):
        raise ValueError("model must be kuramoto or linear")
    a = np.asarray(adjacency, dtype=np.float64)

    def go(batches):
        for pdf in batches:
            for run in pdf["id"]:
                rng = np.random.default_rng([seed, int(run)])
                n = len(a)
                x = rng.uniform(0, 2 * np.pi, n) if model == "kuramoto" else rng.normal(size=n)
                speed = rng.normal(1.0, 0.1, n)
                path = [x]
                for _ in range(steps):
                    slope = speed + coupling * (a * np.sin(x[None, :] - x[:, None])).sum(1) if model == "kuramoto" else coupling * (a @ x) - x
                    x = x + dt * slope
                    path.append(x)
                p = np.array(path)
                yield pd.DataFrame({"run": run, "step": np.repeat(np.arange(steps + 1), n), "node": np.tile(np.arange(n), steps + 1), "x": p.ravel()})

    return spark.range(runs).repartition(max(1, runs)).mapInPandas(go, "run long, step long, node long, x double")


def infer_network(paths: DataFrame, dt: float = 0.01) -> DataFrame:
    """``node, source, weight``: linear couplings by least squares of dx/dt on all nodes, one node's equation per group.

    The normal equations are sums over the steps, made by Spark; only a node-by-node matrix meets a task.
    """
    nxt = paths.select("run", (F.col("step") - 1).alias("step"), "node", F.col("x").alias("y"))
    slope = paths.join(nxt, ["run", "step", "node"]).select("run", "step", "node", ((F.col("y") - F.col("x")) / dt).alias("d"))
    src = paths.select("run", "step", F.col("node").alias("source"), F.col("x").alias("xs"))
    right = slope.join(src, ["run", "step"]).groupBy("node", "source").agg(F.sum(F.col("d") * F.col("xs")).alias("b"))
    used = slope.select("run", "step").distinct()
    s = src.join(used, ["run", "step"])
    gram = s.join(s.select("run", "step", F.col("source").alias("other"), F.col("xs").alias("xo")), ["run", "step"]).groupBy("source", "other").agg(F.sum(F.col("xs") * F.col("xo")).alias("g"))
    both = right.join(gram, "source")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf["source"].unique())
        at = {v: k for k, v in enumerate(names)}
        g, b = np.zeros((len(names), len(names))), np.zeros(len(names))
        for s_, o, v, w in zip(pdf["source"], pdf["other"], pdf["g"], pdf["b"]):
            g[at[s_], at[o]] = v
            b[at[s_]] = w
        return pd.DataFrame({"node": pdf["node"].iloc[0], "source": names, "weight": np.linalg.lstsq(g, b, rcond=None)[0]})

    return both.groupBy("node").applyInPandas(solve, "node long, source long, weight double")
