"""Measures put together: network metrics, label propagation, extended roles, motif kinds, layouts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.graph import both_ways, clustering_stats, core_numbers, degrees, motifs3, node_triangles, simple_edges
from wavelattice.operators.graphpaths import communities, modularity, motifs4, path_lengths
from wavelattice.operators.grouped import stream_groups
from wavelattice.session import discard, written

METRICS = ("clustering", "paths", "modularity")
COMMUNITY_METHODS = ("louvain", "label_propagation")


def _propagate(u: np.ndarray, v: np.ndarray, graph: np.ndarray, turn: np.ndarray, most_rounds: int) -> np.ndarray:
    """Labels of nodes 0..n-1, given both directions of the edges in order of ``u``, each node's graph and its turn (0 or 1).

    Nodes of a graph are numbered in their order.  A graph of which two rounds in a row change nothing has come to rest.
    """
    n = len(graph)
    c = np.arange(n)
    calm = np.zeros(int(graph.max(initial=-1)) + 1, np.int64)
    sides = [(u[turn[u] == i], v[turn[u] == i]) for i in (0, 1)]
    for i in range(most_rounds):
        a, b = sides[i % 2]
        vote, count = np.unique(a * n + c[b], return_counts=True)
        node, label = vote // n, vote % n
        best = np.lexsort((label, label != c[node], -count, node))
        first = best[np.r_[True, node[best][1:] != node[best][:-1]][: len(best)]]
        moved = node[first][label[first] != c[node[first]]]
        c[node[first]] = label[first]
        calm += 1
        calm[graph[moved]] = 0
        if (calm >= 2).all():
            break
        awake = calm < 2
        if not awake.all():
            sides = [(a[awake[graph[a]]], b[awake[graph[a]]]) for a, b in sides]
    return c


def label_propagation(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50, most_local: int = 5_000_000) -> DataFrame:
    """``series_id, node, community``: every node takes the label most common among its neighbours.

    Ties keep a node's own label where it is among the best, else the smallest wins.  Nodes of even and odd hash take turns, so that
    two neighbours don't swap labels for ever.  Rounds end when two in a row change nothing, or after ``most_rounds``,
    which is part of the method: labels need not settle.  Graphs of at most ``most_local`` edges are followed to their end many to a batch; the
    rounds of larger ones are tables in the checkpoint folder.
    """
    kind = edges.schema["series_id"].dataType.simpleString()
    simple, _ = written(simple_edges(edges))
    large = simple.groupBy("series_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most_local).select("series_id")
    any_large = large.limit(1).count() > 0
    small = simple.join(large, "series_id", "left_anti") if any_large else simple
    near = both_ways(small).groupBy("series_id", F.col("u").alias("node")).agg(F.collect_list("v").alias("near")).withColumn("turn", F.pmod(F.xxhash64("node"), F.lit(2)))

    def follow(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids, sizes = rows["node"].to_numpy(), rows["near"].map(len).to_numpy()
        ends = np.r_[starts[1:], len(rows)]
        graph = np.repeat(np.arange(len(starts)), ends - starts)
        v = np.concatenate([np.searchsorted(ids[lo:hi], np.concatenate(rows["near"].iloc[lo:hi].to_list())) + lo for lo, hi in zip(starts, ends)])
        c = _propagate(np.repeat(np.arange(len(rows)), sizes), v, graph, rows["turn"].to_numpy(), most_rounds)
        return pd.DataFrame({"series_id": rows["series_id"], "node": rows["node"], "community": ids[c]})

    found = stream_groups(near, ["series_id"], "node", follow, f"series_id {kind}, node long, community long")
    if any_large:
        part = simple.join(large, "series_id", "left_semi")
        found = found.unionByName(_propagation_rounds(part.select("series_id", F.explode(F.array("src", "dst")).alias("node")).distinct(), part, most_rounds))
    return nodes.select("series_id", "node").join(found, ["series_id", "node"], "left").select("series_id", "node", F.coalesce("community", "node").alias("community"))


def _propagation_rounds(nodes: DataFrame, simple: DataFrame, most_rounds: int) -> DataFrame:
    """``label_propagation`` of graphs too large for a task: a round is a join and two aggregations."""
    e, _ = written(both_ways(simple))
    turn = F.pmod(F.xxhash64("node"), F.lit(2))
    label, path = written(nodes.select("series_id", "node", F.col("node").alias("c")))
    calm = 0
    for i in range(most_rounds):
        heard = e.join(label.select("series_id", F.col("node").alias("v"), F.col("c").alias("k")), ["series_id", "v"])
        votes = heard.groupBy("series_id", F.col("u").alias("node"), "k").agg(F.count(F.lit(1)).alias("n"))
        ranked = votes.join(label, ["series_id", "node"]).groupBy("series_id", "node").agg(F.max(F.struct("n", (F.col("k") == F.col("c")).alias("own"), (-F.col("k")).alias("k"))).alias("b"))
        moved = F.when(F.col("b").isNotNull() & (turn == i % 2), -F.col("b.k")).otherwise(F.col("c"))
        new, new_path = written(label.join(ranked, ["series_id", "node"], "left").select("series_id", "node", moved.alias("c"), F.col("c").alias("old")))
        discard(nodes.sparkSession, path)
        label, path = new.drop("old"), new_path
        calm = 0 if new.where("c <> old").limit(1).count() else calm + 1
        if calm == 2:
            break
    return label.withColumnRenamed("c", "community")


def detect_communities(nodes: DataFrame, edges: DataFrame, method: str = "louvain", seed: int = 42) -> DataFrame:
    """``series_id, node, community`` by ``louvain`` (a graph per task) or ``label_propagation`` (distributed)."""
    if method not in COMMUNITY_METHODS:
        raise ValueError(f"method must be one of {COMMUNITY_METHODS}")
    return communities(nodes, edges, seed) if method == "louvain" else label_propagation(nodes, edges)


def network_metrics(nodes: DataFrame, edges: DataFrame, include: Sequence[str] = METRICS, community: str = "louvain") -> DataFrame:
    """One row per series with the chosen groups of measures: clustering, path lengths of the largest component, modularity."""
    unknown = set(include) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; some of {METRICS}")
    out = nodes.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    if "clustering" in include:
        out = out.join(clustering_stats(nodes, edges), "series_id", "left")
    if "paths" in include:
        out = out.join(path_lengths(nodes, edges).withColumnRenamed("n_nodes", "n_largest"), "series_id", "left")
    if "modularity" in include:
        labels = detect_communities(nodes, edges, community)
        sizes = labels.groupBy("series_id").agg(F.count_distinct("community").alias("n_communities"))
        out = out.join(modularity(nodes, edges, labels), "series_id", "left").join(sizes, "series_id", "left")
    return out


def extended_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, node, degree, triangles, wedges, ego_edges, ego_density, core`` of every node."""
    d = F.col("degree")
    t = node_triangles(nodes, edges).select("series_id", "node", "degree", "triangles")
    ego = d + F.col("triangles")
    out = t.select(
        "series_id", "node", "degree", "triangles", (d * (d - 1) / 2).cast("long").alias("wedges"), ego.cast("long").alias("ego_edges"),
        F.when(d > 0, 2.0 * ego / (d * (d + 1))).otherwise(0.0).alias("ego_density"),
    )
    return out.join(core_numbers(nodes, edges), ["series_id", "node"])


def motif_counts(nodes: DataFrame, edges: DataFrame, kind: str = "directed-3") -> DataFrame:
    """Motifs by kind: ``directed-3`` (classes of directed triples) or ``undirected-4`` (kinds of quadruples); others raise."""
    if kind == "directed-3":
        return motifs3(nodes, edges).withColumn("motif", F.col("code").cast("string")).select("series_id", "motif", "n")
    if kind == "undirected-4":
        return motifs4(edges).select("series_id", "motif", "n")
    raise ValueError("kind must be directed-3 or undirected-4")


def scaled_layout(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, src, dst, y_src, y_dst``: edges over time with end values scaled to 0..1 within their series (0.5 where it is constant)."""
    ends = points.groupBy("series_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    y = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    placed = points.join(ends, "series_id").select("series_id", "t", y.alias("y"))
    a = placed.select("series_id", F.col("t").alias("src"), F.col("y").alias("y_src"))
    b = placed.select("series_id", F.col("t").alias("dst"), F.col("y").alias("y_dst"))
    return edges.join(a, ["series_id", "src"]).join(b, ["series_id", "dst"]).select("series_id", "src", "dst", "y_src", "y_dst")


def circular_layout(nodes: DataFrame, edges: DataFrame, colour: str = "degree") -> DataFrame:
    """``series_id, node, x, y, colour``: nodes on a circle in order of their number, coloured by ``degree``, ``t`` (place in time) or ``community``."""
    d = degrees(nodes, edges).select("series_id", "node", "degree")
    if colour == "degree":
        shade = d.select("series_id", "node", F.col("degree").cast("double").alias("colour"))
    elif colour == "t":
        shade = d.select("series_id", "node", F.col("node").cast("double").alias("colour"))
    elif colour == "community":
        shade = detect_communities(nodes, edges).select("series_id", "node", F.col("community").cast("double").alias("colour"))
    else:
        raise ValueError("colour must be degree, t or community")
    size = nodes.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("node")) - 1
    ring = nodes.select("series_id", "node", place.alias("i")).join(size, "series_id")
    angle = F.col("i") * (2 * math.pi) / F.col("n")
    return ring.select("series_id", "node", F.cos(angle).alias("x"), F.sin(angle).alias("y")).join(shade, ["series_id", "node"])
