import random

import pytest

from wavelattice.operators.graph import clustering_stats, components, core_numbers, nodes_of, summary
from wavelattice.operators.visibility import edge_weights, hvg_edges, nvg_edges

# Edges of small series under each rule.
CASES = {
    (1, 1, 2): ("01 02 12", "01 12", "01 02 12", "01 02 12", "01 02 12"),
    (2, 1, 1): ("01 12", "01 12", "01 02 12", "01 02 12", "01 02 12"),
    (1, 2, 1, 2): ("01 12 13 23", "01 12 13 23", "01 12 13 23", "01 12 13 23", "01 12 13 23"),
    (1, 1, 1): ("01 12", "01 12", "01 02 12", "01 02 12", "01 12"),
    (1, 2, 3): ("01 12", "01 12", "01 12", "01 02 12", "01 12"),
    (2, 1, 2): ("01 02 12", "01 02 12", "01 02 12", "01 02 12", "01 02 12"),
}


def text(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.series_id, set()).add(f"{r.src}{r.dst}")
    return out


def naive(x, rule):
    out = set()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            m = max(x[i + 1 : j], default=float("-inf"))
            if rule == "strict":
                ok = m < min(x[i], x[j])
            elif rule == "loose":
                ok = m <= min(x[i], x[j])
            elif rule == "stack":
                ok = (x[i] < x[j] and m <= x[i]) or (x[i] >= x[j] and m < x[j])
            else:
                ok = all(x[k] <= x[i] + (x[j] - x[i]) * (k - i) / (j - i) + 1e-9 for k in range(i + 1, j))
            if ok:
                out.add((i, j))
    return out


def test_small_cases(points):
    p = points({"-".join(map(str, k)): k for k in CASES})
    got = [text(hvg_edges(p, r)) for r in ("stack", "strict", "loose")] + [text(nvg_edges(p)), text(nvg_edges(p, strict=True))]
    for k, wanted in CASES.items():
        name = "-".join(map(str, k))
        assert [" ".join(sorted(g[name])) for g in got] == list(wanted)


@pytest.mark.parametrize("shard", [7, 1000])
def test_ties_and_shards(points, shard):
    rng = random.Random(3)
    series = {f"s{k}": [rng.randint(0, 4) for _ in range(rng.choice([1, 2, 40]))] for k in range(20)} | {"up": list(range(30)), "down": list(range(30, 0, -1)), "flat": [5] * 25}
    p = points(series)
    for rule in ("stack", "strict", "loose"):
        got = {}
        for r in hvg_edges(p, rule, shard_points=shard).collect():
            got.setdefault(r.series_id, []).append((r.src, r.dst))
        for k, x in series.items():
            assert sorted(got.get(k, [])) == sorted(naive(x, rule)), (rule, k)
    got = {}
    for r in nvg_edges(p, 9, shard_points=shard).collect():
        got.setdefault(r.series_id, []).append((r.src, r.dst))
    for k, x in series.items():
        assert sorted(got.get(k, [])) == sorted((i, j) for i, j in naive(x, "nvg") if j - i <= 9), k


def test_empty_and_weights(spark, points):
    none = spark.createDataFrame([], "series_id string, t long, value double")
    assert hvg_edges(none).count() == 0 and nvg_edges(none).count() == 0
    p = points({"a": [1, 3, 2, 4, 1]})
    w = {(r.src, r.dst): r.weight for r in edge_weights(p, hvg_edges(p), "min_clearance").collect()}
    assert w[(0, 1)] == float("inf") and w[(1, 3)] == 1.0
    with pytest.raises(ValueError):
        edge_weights(p, hvg_edges(p), "nonsense")
    with pytest.raises(ValueError):
        hvg_edges(p, "nonsense")


def test_graph_measures(spark, points):
    p = points({"a": [0] * 6, "one": [1]})
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 0, 2), ("a", 3, 4)], "series_id string, src long, dst long")
    n = nodes_of(p)
    s = {r.series_id: r for r in summary(n, e).collect()}
    assert s["a"].n_edges == 4 and s["a"].min_degree == 0 and s["one"].density == 0.0
    c = {r.series_id: r for r in clustering_stats(n, e).collect()}
    assert c["a"].triangles == 1 and c["a"].avg_clustering == pytest.approx(0.5) and c["a"].transitivity == pytest.approx(1.0)
    assert {(r.node, r.component) for r in components(n, e).where("series_id = 'a'").collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)}
    assert {(r.node, r.core) for r in core_numbers(n, e).where("series_id = 'a'").collect()} == {(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 0)}
