import math

import pytest
from pyspark.sql import functions as F

from wavelattice.operators.combined import circular_layout, detect_communities, label_propagation, motif_counts, network_metrics, scaled_layout
from wavelattice.operators.events import spike_distances
from wavelattice.operators.graph import nodes_of
from wavelattice.operators.significance import link_significance
from wavelattice.operators.visibility import hvg_edges
from wavelattice.operators.windows import window_aggregate
from wavelattice.plans.pipeline import GraphBuilder


@pytest.fixture(scope="module")
def two_cliques(spark):
    pairs = [(a, b) for lo in (0, 5) for a in range(lo, lo + 5) for b in range(a + 1, lo + 5)] + [(4, 5)]
    return spark.createDataFrame([("g", i) for i in range(11)], "series_id string, node long"), spark.createDataFrame([("g", a, b) for a, b in pairs], "series_id string, src long, dst long")


def test_communities(two_cliques):
    nodes, edges = two_cliques
    got = {r.node: r.community for r in label_propagation(nodes, edges).collect()}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9] and got[10] == 10
    assert detect_communities(nodes, edges).select("community").distinct().count() == 3
    with pytest.raises(ValueError):
        detect_communities(nodes, edges, "none")
    assert label_propagation(nodes.limit(0), edges.limit(0)).count() == 0


def test_network_metrics(two_cliques):
    nodes, edges = two_cliques
    (r,) = network_metrics(nodes, edges).collect()
    assert (r.n_nodes, r.triangles, r.n_largest, r.diameter, r.n_communities) == (11, 20, 10, 3, 3) and r.modularity > 0.4
    with pytest.raises(ValueError):
        network_metrics(nodes, edges, ("size",))
    with pytest.raises(ValueError):
        motif_counts(nodes, edges, "5")
    assert {r.motif: r.n for r in motif_counts(nodes, edges, "undirected-4").collect()}["K4"] == 10


def test_builder_methods(points):
    p = points({"a": [3, 1, 2, 5, 4, 1, 0, 2, 7, 1, 2, 2], "b": [1] * 12})
    out = {r.series_id: r for r in GraphBuilder("hvg").network_metrics(p, ("clustering",)).collect()}
    assert out["a"].n_nodes == 12 and set(out) == {"a", "b"}
    assert GraphBuilder("hvg").test_significance(p, ("avg_degree",), count=3).count() == 2
    with pytest.raises(ValueError):
        GraphBuilder("transition").network_metrics(p)


def test_layouts(points):
    p = points({"a": [0, 5, 10], "b": [2, 2]})
    rows = {(r.series_id, r.src, r.dst): (r.y_src, r.y_dst) for r in scaled_layout(p, hvg_edges(p)).collect()}
    assert rows["a", 0, 1] == (0.0, 0.5) and rows["b", 0, 1] == (0.5, 0.5)
    ring = circular_layout(nodes_of(p), hvg_edges(p), "t").collect()
    assert all(abs(r.x**2 + r.y**2 - 1) < 1e-12 for r in ring) and {r.colour for r in ring} == {0.0, 1.0, 2.0}
    with pytest.raises(ValueError):
        circular_layout(nodes_of(p), hvg_edges(p), "size")


def test_spike_distances(spark):
    trains = {"a": [0, 3, 7], "b": [1, 3], "c": [5000]}
    e = spark.createDataFrame([(k, float(t)) for k, ts in trains.items() for t in ts], "series_id string, event_t double")
    got = {(r.i, r.j): r.dist for r in spike_distances(e, 2.0).collect()}

    def s(x, y):
        return sum(math.exp(-abs(p - q) / 2.0) for p in x for q in y)

    for (i, j), d in got.items():
        assert d == pytest.approx(math.sqrt(s(trains[i], trains[i]) + s(trains[j], trains[j]) - 2 * s(trains[i], trains[j])), abs=1e-9)
    assert len(got) == 3 and spike_distances(e.limit(0), 2.0).count() == 0


def test_links_and_windows(spark):
    d = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (1, 2, 0.8), (0, 3, 0.7)], "i long, j long, dist double")
    assert {(r.i, r.j): (r.p, r.significant) for r in link_significance(d, 0.5, 0.8).collect()}[0, 1] == (0.75, True)
    w = spark.createDataFrame([("a", 0, 2.5, 7)], "series_id string, window_id long, avg_degree double, n_edges long")
    assert [window_aggregate(w, k).first().value for k in ("mean", "n_edges", "unknown")] == [2.5, 7.0, 0.0]
    assert window_aggregate(w.where(F.lit(False)), "mean").count() == 0
