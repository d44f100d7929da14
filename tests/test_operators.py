import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelattice.operators import decompose, distances, events, multivariate, recurrence, significance, transition, windows
from wavelattice.operators.graph import nodes_of
from wavelattice.operators.series import keep_long, load_series, number_points, series_warnings
from wavelattice.operators.visibility import hvg_edges


def test_load_and_number(spark):
    rows = [("a", "2024-01-01 00:10:00", "1"), ("a", "2024-01-01 00:50:00", "3"), ("a", "2024-01-01 01:00:00", "x"), ("a", "2024-01-01 02:00:00", "inf"), ("a", "2024-01-02 00:00:00", "5"), (None, "2024-01-01 00:00:00", "9"), ("b", None, "1")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "series string, at string, v string, value int")
    out = {(r.series_id, str(r.ts)): r.value for r in load_series(df, "at", "v", "series", "2024-01-01", "2024-01-02", "1h").collect()}
    assert out == {("a", "2024-01-01 00:00:00"): 2.0, ("a", "2024-01-02 00:00:00"): 5.0}
    for agg, v in (("sum", 4.0), ("first", 1.0), ("last", 3.0), ("median", 2.0), ("min", 1.0), ("max", 3.0)):
        assert load_series(df, "at", "v", "series", end="2024-01-01 00:59:59", freq="hourly", agg=agg).first().value == v
    with pytest.raises(ValueError):
        load_series(df, "at", "v", "series", freq="1h", agg="mode")
    with pytest.raises(ValueError):
        load_series(df, "at", "v", freq="often")
    p = number_points(df, "series", ("at",), "v")
    assert [(r.t, r.value) for r in p.where("series_id = 'a'").orderBy("t").collect()] == [(0, 1.0), (1, 3.0), (2, 5.0)]
    assert series_warnings(p).first().is_short is False and keep_long(p, 4).count() == 0


def test_windows(points):
    p = points({"a": range(10), "b": range(3), "c": [1, 2, 4, 8, 16]})
    w = windows.sliding_windows(p, 4, 3)
    got = {}
    for r in w.collect():
        got.setdefault((r.series_id, r.window_id), []).append(r.value)
    assert {k: sorted(v) for k, v in got.items()} == {("a", 0): [0, 1, 2, 3], ("a", 1): [3, 4, 5, 6], ("a", 2): [6, 7, 8, 9], ("c", 0): [1, 2, 4, 8]}
    assert [r.value for r in windows.coarse_grain(points({"a": range(12)}), 3).orderBy("t").collect()] == [1, 4, 7, 10]
    assert windows.coarse_grain(p, 3).where("series_id = 'b'").count() == 0
    m = {(r.series_id, r.scale): r.n_nodes for r in windows.multiscale(p, (1, 2), hvg_edges).collect()}
    assert m["a", 1] == 10 and m["a", 2] is None and m["b", 1] is None


def test_transitions(points):
    p = points({"a": [1, 3, 2, 4, 1, 3, 2, 4], "flat": [1] * 6, "short": [1, 2]})
    net = {("".join(map(str, r.src[0])), "".join(map(str, r.dst[0]))): r.weight for r in transition.transitions(transition.ordinal_symbols(p.where("series_id = 'a'"), 3)).collect()}
    assert sum(net.values()) == 5 and net["021", "102"] == 2
    assert {r.series_id: r.entropy_rate for r in transition.entropy_rate(transition.transition_network(p, order=3)).collect()}["flat"] == 0.0
    assert transition.permutation_entropy(p, 3).where("series_id = 'flat'").first().permutation_entropy == 0.0
    codes = {tuple(r.symbol): r.code for r in transition.ordinal_symbols(p, 3).join(transition.lehmer_codes(p, 3), ["series_id", "t"]).collect()}
    assert codes[(0, 1, 2)] == 0 and len(set(codes.values())) == len(codes)


def test_recurrence_against_all_pairs(points):
    rng = random.Random(4)
    x = [rng.randint(0, 6) for _ in range(40)]
    p = points({"a": x, "same": [2] * 9})
    got = {(r.src, r.dst) for r in recurrence.knn_arcs(p, 3).where("series_id = 'a'").collect()}
    want = {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (abs(x[i] - x[j]), j))[:3]}
    assert got == want
    assert {(r.src, r.dst) for r in recurrence.knn_arcs(p, 2).where("series_id = 'same' and src = 5").collect()} == {(5, 0), (5, 1)}
    for eps in (0.5, 2.0):
        assert {(r.src, r.dst) for r in recurrence.epsilon_edges(p, eps).where("series_id = 'a'").collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if abs(x[i] - x[j]) <= eps}
    e = recurrence.embed(p.where("series_id = 'a'"), 3, 2)
    assert e.count() == 36 and e.where("t = 0").first().vec == [x[0], x[2], x[4]]
    with pytest.raises(ValueError):
        recurrence.embed(p, 0)


def test_rqa(points):
    p = points({"a": [1, 2, 1, 2, 1, 2]})
    sizes = p.groupBy("series_id").agg(F.count("*").alias("n"))
    r = recurrence.rqa(recurrence.matrix_cells(recurrence.epsilon_edges(p, 0.1), sizes), sizes).first()
    assert r.rr == pytest.approx(0.5) and r.det == pytest.approx(1.0) and r.l_max == 6 and r.lam == 0.0


def test_distances(points):
    rng = np.random.default_rng(0)
    x = {f"s{k}": rng.normal(size=30).tolist() for k in range(9)} | {"const": [1.0] * 30}
    p = points(x)
    a = {(r.i, r.j): r.dist for r in distances.pair_distances(p, block=256).collect()}
    b = {(r.i, r.j): r.dist for r in distances.pair_distances(p, block=3).collect()}
    assert a.keys() == b.keys() and len(a) == 45
    assert a["s0", "s1"] == pytest.approx(1 - abs(np.corrcoef(x["s0"], x["s1"])[0, 1])) == pytest.approx(b["s0", "s1"])
    assert a["const", "s0"] is None
    assert distances.dtw(np.array([0.0, 1, 2]), np.array([0.0, 1, 1, 2]), normalise=False) == 0.0
    assert distances.dtw(np.array([0.0, 1, 2]), np.array([0.0, 1, 1, 2, 2, 2]), window=1) == math.inf
    d = distances.pair_distances(p.where("series_id <> 'const'"))
    mutual, plain = distances.knn_network(d, 2, mutual=True), distances.knn_network(d, 2)
    assert set(map(tuple, mutual.select("i", "j").collect())) <= set(map(tuple, plain.select("i", "j").collect()))
    assert distances.epsilon_network(d, percentile=100.0).count() == 35
    with pytest.raises(ValueError):
        distances.epsilon_network(d)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    v = np.vstack([rng.normal(size=(120, 4)), np.zeros((5, 4))])  # with ties
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id long, vec array<double>")
    want = {(i, j) for i in range(125) for j in sorted((j for j in range(125) if j != i), key=lambda j: (np.linalg.norm(v[i] - v[j]), j))[:5]}
    for block in (2_048, 20):
        assert {(r.i, r.j) for r in distances.nearest_vectors(df, 5, block).collect()} == want
    assert distances.nearest_vectors(df.limit(1), 5).count() == 0
    assert all(r.dist < 0.5 for r in distances.nearest_within(df, 5, 0.5).collect())


def test_events(spark, points):
    p = points({"a": [0, 5, 0, 0, 3, 3, 0, 9], "b": [0, 0, 5, 0, 0, 4, 0, 0]})
    assert sorted(r.event_t for r in events.detect_events(p, "peaks").where("series_id = 'a'").collect()) == [1, 4]
    ev = lambda s, ts: spark.createDataFrame([(s, t) for t in ts], "series_id string, event_t long")
    g = events.sync_greedy(ev("x", [1, 5, 9]), ev("x", [1, 5, 9])).first()
    assert g.strength == pytest.approx(1.0) and g.direction == 0.0
    s = events.sync_all_pairs(ev("x", [2, 6, 10]), ev("x", [1, 5, 9]), 3.0).first()
    assert s.q12 == pytest.approx(1.0) and s.q21 == 0.0
    with pytest.raises(ValueError):
        events.random_events(spark, 5, 3)
    assert events.random_events(spark, 5, 50).select("event_t").distinct().count() == 5


def test_significance(spark, points):
    assert significance.t_pvalue(0.0, 10) == pytest.approx(1.0) and significance.t_pvalue(0.6319, 10) == pytest.approx(0.05, abs=1e-3)
    x = np.random.default_rng(0).normal(size=64)
    for m in significance.SURROGATES:
        y = significance.surrogate(x, m, np.random.default_rng(1))
        assert len(y) == 64
        if m in ("shuffle", "circular", "iaaft"):
            assert np.allclose(np.sort(x), np.sort(y))
        if m == "phase":
            assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y)))
    tests = spark.createDataFrame([(0.001,), (0.01,), (0.03,), (0.04,), (0.9,)], "p double")
    assert [r.reject for r in significance.false_discovery(tests).orderBy("p").collect()] == [True, True, True, True, False]
    assert not any(r.reject for r in significance.false_discovery(tests.where("p > 0.5")).collect())
    p = points({"a": x.tolist()})
    s = significance.surrogates(p, "shuffle", 3)
    assert s.groupBy("series_id").count().count() == 3 and s.count() == 192
    assert sorted(map(tuple, significance.surrogates(p, "phase", 2).collect())) == sorted(map(tuple, significance.surrogates(p, "phase", 2).collect()))


def test_joint_and_cross(points):
    x1, x2 = points({"p": [1, 3, 2]}), points({"p": [2, 1, 4]})
    assert {(r.src, r.dst) for r in multivariate.cross_visibility(x1, x2).collect()} == {(2, 3), (1, 5)}
    n = nodes_of(x1)
    same = multivariate.compare_networks(n, hvg_edges(x1), n, hvg_edges(x1)).first()
    assert same.edge_overlap == 1.0 and same.density_similarity == 1.0


def test_decomposition(points):
    t = np.arange(84)
    season = 3 * np.sin(2 * np.pi * t / 7)
    x = 10 + 0.05 * t + season + np.random.default_rng(0).normal(0, 0.1, 84)
    out = decompose.decompose(points({"a": x.tolist(), "flat": [1.0] * 20, "few": [1.0, 2.0]}), period=7).orderBy("t").collect()
    assert len(out) == 84 and all(r.series_id == "a" for r in out)
    assert np.corrcoef([r.seasonal for r in out], season)[0, 1] > 0.98
    assert all(r.level + r.seasonal + r.residual == pytest.approx(v) for r, v in zip(out, x))


def test_network_inference(spark):
    ring = [[0.0, 0.5, 0.0], [0.0, 0.0, 0.5], [0.5, 0.0, 0.0]]
    got = {(r.node, r.source): r.weight for r in decompose.infer_network(decompose.simulate(spark, ring, "linear", 100, runs=3)).collect()}
    for i in range(3):
        for j in range(3):
            assert got[i, j] == pytest.approx(ring[i][j] - (i == j), abs=1e-6)
