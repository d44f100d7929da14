"""Statistics and algorithms on edge tables ``series_id, src, dst``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.grouped import stream_groups
from wavelattice.session import cut_lineage, discard, written


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in either direction: ``series_id, u, v`` (a self loop once)."""
    turned = edges.select("series_id", F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))))
    loops = F.col("u") == F.col("v")
    return turned.where(~loops).unionByName(edges.where("src = dst").select("series_id", F.col("src").alias("u"), F.col("dst").alias("v")))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops and repeats: ``series_id, src < dst``."""
    return edges.where("src <> dst").select("series_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def nodes_of(points: DataFrame) -> DataFrame:
    return points.select("series_id", F.col("t").alias("node"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, node, degree, in_degree, out_degree`` of every node, isolated ones included.

    One aggregation: each edge counts at its two ends, combined before the exchange.
    """
    ends = edges.select(
        "series_id",
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("d"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("node"), F.when(F.col("src") == F.col("dst"), 0).otherwise(1).alias("d"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ),
    )
    counted = ends.unionByName(nodes.select("series_id", "node", F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("o"))).groupBy("series_id", "node")
    return counted.agg(F.sum("d").alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def summary(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """Per series: nodes, edges, degree mean, population spread, least, most and density; directed also in, out and irreversibility."""
    d = degrees(nodes, edges)
    k = F.col("out_degree") if directed else F.col("degree")
    n = F.count(F.lit(1)).cast("double")
    m = F.sum("out_degree").cast("double")
    pairs = n * (n - 1) / (1.0 if directed else 2.0)
    aggs = [
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum("out_degree").alias("n_edges"),
        F.avg(k).alias("avg_degree"),
        F.stddev_pop(k).alias("std_degree"),
        F.min(k).alias("min_degree"),
        F.max(k).alias("max_degree"),
        F.when(pairs > 0, m / pairs).otherwise(0.0).alias("density"),
    ]
    if directed:
        both = F.col("in_degree") + F.col("out_degree")
        for way in ("in", "out"):
            c = F.col(f"{way}_degree")
            aggs += [F.avg(c).alias(f"avg_{way}_degree"), F.stddev_pop(c).alias(f"std_{way}_degree"), F.min(c).alias(f"min_{way}_degree"), F.max(c).alias(f"max_{way}_degree")]
        aggs.append(F.avg(F.when(both > 0, F.abs(F.col("in_degree") - F.col("out_degree")) / both).otherwise(0.0)).alias("irreversibility"))
    return d.groupBy("series_id").agg(*aggs)


def weight_stats(weighted: DataFrame) -> DataFrame:
    """Least, most, mean and population spread of the finite weights per series, and the number of infinite ones."""
    ok = F.when(F.abs("weight") < float("inf"), F.col("weight"))
    return weighted.groupBy("series_id").agg(
        F.min(ok).alias("min_weight"), F.max(ok).alias("max_weight"), F.avg(ok).alias("avg_weight"), F.stddev_pop(ok).alias("std_weight"),
        F.sum((F.abs("weight") == float("inf")).cast("long")).alias("inf_weights"),
    )


def triangles(edges: DataFrame) -> DataFrame:
    """``series_id, a < b < c`` of every triangle.

    Each edge points from the end of lower degree to the other, so that a hub closes no more wedges
    than it has better connected neighbours; wedges are then closed by one join.
    """
    e = simple_edges(edges)
    deg = both_ways(e).groupBy("series_id", "u").agg(F.count(F.lit(1)).alias("d"))
    with_d = e.join(deg.select("series_id", F.col("u").alias("src"), F.col("d").alias("ds")), ["series_id", "src"]).join(deg.select("series_id", F.col("u").alias("dst"), F.col("d").alias("dd")), ["series_id", "dst"])
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    arcs = with_d.select("series_id", F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("hi"))
    wedges = arcs.select("series_id", "lo", F.col("hi").alias("p")).join(arcs.select("series_id", "lo", F.col("hi").alias("q")), ["series_id", "lo"]).where("p < q")
    closed = wedges.join(e.select("series_id", F.col("src").alias("p"), F.col("dst").alias("q")), ["series_id", "p", "q"])
    three = F.array_sort(F.array("lo", "p", "q"))
    return closed.select("series_id", three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def node_triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, node, degree, triangles, clustering`` of every node (0 below two neighbours)."""
    e = simple_edges(edges)
    t = triangles(e).select("series_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("series_id", "node").agg(F.count(F.lit(1)).alias("triangles"))
    d = degrees(nodes, e).select("series_id", "node", "degree").join(t, ["series_id", "node"], "left").fillna(0, ["triangles"])
    wedge = F.col("degree") * (F.col("degree") - 1)
    return d.withColumn("clustering", F.when(wedge > 0, 2.0 * F.col("triangles") / wedge).otherwise(0.0))


def clustering_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per series: triangles, wedges, mean clustering (all nodes; nodes of two and more), its spread, transitivity."""
    c = node_triangles(nodes, edges)
    wedge = F.col("degree") * (F.col("degree") - 1) / 2
    t3, w = F.sum("triangles").cast("double"), F.sum(wedge)
    return c.groupBy("series_id").agg(
        (F.sum("triangles") / 3).cast("long").alias("triangles"),
        w.cast("long").alias("wedges"),
        F.avg("clustering").alias("avg_clustering"),
        F.avg(F.when(F.col("degree") >= 2, F.col("clustering"))).alias("avg_clustering_connected"),
        F.stddev_pop("clustering").alias("std_clustering"),
        F.when(w > 0, t3 / w).otherwise(0.0).alias("transitivity"),
    )


def motif_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles, wedges (closed ones included) and other triples per series."""
    c = clustering_stats(nodes, edges).join(nodes.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), "series_id")
    triples = F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6
    return c.select("series_id", "triangles", "wedges", F.greatest(triples - F.col("triangles") - F.col("wedges"), F.lit(0)).cast("long").alias("other"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Pearson correlation of the degrees at both ends of every edge, either way round (null where undefined)."""
    e = both_ways(simple_edges(edges))
    d = e.groupBy("series_id", "u").agg(F.count(F.lit(1)).alias("d"))
    ends = e.join(d.withColumnRenamed("d", "du"), ["series_id", "u"]).join(d.select("series_id", F.col("u").alias("v"), F.col("d").alias("dv")), ["series_id", "v"])
    return ends.groupBy("series_id").agg(F.corr(F.col("du").cast("double"), F.col("dv").cast("double")).alias("assortativity"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, node, component``: the least node of each node's connected component.

    Labels spread along edges and jump to their label's label each round, so that the number of
    rounds grows with the logarithm of a component's width; each round is written to the
    checkpoint folder, the one before deleted, and the loop ends when no label changes.
    """
    e = cut_lineage(both_ways(simple_edges(edges)))
    label, path = written(nodes.select("series_id", "node", F.col("node").alias("c")))
    while True:
        near = e.join(label.select("series_id", F.col("node").alias("v"), F.col("c").alias("cv")), ["series_id", "v"]).groupBy("series_id", F.col("u").alias("node")).agg(F.min("cv").alias("m"))
        pulled = label.join(near, ["series_id", "node"], "left").select("series_id", "node", "c", F.least("c", F.coalesce("m", "c")).alias("k"))
        jump = pulled.select("series_id", F.col("node").alias("k"), F.col("k").alias("kk"))
        moved, new_path = written(pulled.join(jump, ["series_id", "k"], "left").select("series_id", "node", F.least("k", F.coalesce("kk", "k")).alias("c"), F.col("c").alias("old")))
        discard(nodes.sparkSession, path)
        label, path = moved.drop("old"), new_path
        if not moved.where("c <> old").limit(1).count():
            return label.select("series_id", "node", F.col("c").alias("component"))


def giant_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of each series' largest component (ties: the one with the least node)."""
    c = components(nodes, edges)
    size = c.groupBy("series_id", "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.withColumn("r", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("n"), "component"))).where("r = 1")
    return c.join(best.select("series_id", "component"), ["series_id", "component"]).select("series_id", "node")


def _peel(v: list[np.ndarray]) -> np.ndarray:
    """Core numbers of one graph, given the neighbours of each node by position: nodes are peeled in order of degree."""
    n = len(v)
    degree = np.fromiter(map(len, v), np.int64, n)
    ends = np.zeros(int(degree.max(initial=0)) + 2, dtype=np.int64)
    np.add.at(ends, degree + 1, 1)
    first = np.cumsum(ends).tolist()  # where the nodes of each degree start in the order
    order = np.argsort(degree, kind="stable")
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    order, at, core = order.tolist(), at.tolist(), degree.tolist()
    for i in range(n):
        u = order[i]
        for w in v[u].tolist():
            if core[w] > core[u]:  # w goes to the front of its degree and one degree down
                front = first[core[w]]
                x, place = order[front], at[w]
                order[front], order[place], at[w], at[x] = w, x, front, place
                first[core[w]] = front + 1
                core[w] -= 1
    return np.asarray(core, dtype=np.int64)


def core_numbers(nodes: DataFrame, edges: DataFrame, most_local: int = 5_000_000) -> DataFrame:
    """``series_id, node, core``: core numbers.

    Graphs of at most ``most_local`` edges are peeled in one pass each, many to a batch.  Larger ones go by
    repeated local h-index, which converges to the same numbers: a node's number is the greatest k
    such that k neighbours have at least k; each round is one join and one aggregation, written to the
    checkpoint folder, until nothing changes, however many rounds that takes.
    """
    simple = cut_lineage(simple_edges(edges))
    sizes = simple.groupBy("series_id").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > most_local).select("series_id")
    kind = nodes.schema["series_id"].dataType.simpleString()

    def peel(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(rows)]):
            ids = rows["node"].to_numpy()[lo:hi]
            out.append(_peel([np.searchsorted(ids, np.asarray(v)) for v in rows["near"].iloc[lo:hi]]))
        return pd.DataFrame({"series_id": rows["series_id"], "node": rows["node"], "core": np.concatenate(out) if out else []})

    any_large = large.limit(1).count() > 0
    small = simple.join(large, "series_id", "left_anti") if any_large else simple
    near = both_ways(small).groupBy("series_id", F.col("u").alias("node")).agg(F.collect_list("v").alias("near"))
    cores = stream_groups(near, ["series_id"], "node", peel, f"series_id {kind}, node long, core long")
    if any_large:
        cores = cores.unionByName(_core_rounds(simple.join(large, "series_id", "left_semi")))
    return nodes.select("series_id", "node").join(cores, ["series_id", "node"], "left").fillna(0, ["core"])


def _core_rounds(simple: DataFrame) -> DataFrame:
    e = cut_lineage(both_ways(simple))
    core, path = written(e.groupBy("series_id", F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("core")))
    while True:
        seen = e.join(core.select("series_id", F.col("node").alias("v"), F.col("core").alias("cv")), ["series_id", "v"])
        ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("series_id", "u").orderBy(F.desc("cv"))))
        h = ranked.groupBy("series_id", F.col("u").alias("node")).agg(F.max(F.least("r", "cv")).alias("h"))
        new, new_path = written(core.join(h, ["series_id", "node"]).select("series_id", "node", F.least("core", "h").cast("long").alias("core"), F.col("core").alias("old")))
        discard(simple.sparkSession, path)
        core, path = new.drop("old"), new_path
        if not new.where("core <> old").limit(1).count():
            return core


def max_symmetrise(weighted: DataFrame) -> DataFrame:
    """One undirected edge with the greater weight of both directions."""
    return weighted.where("src <> dst").groupBy("series_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def mutual_edges(weighted: DataFrame) -> DataFrame:
    """Undirected edges that exist in both directions, with the smaller weight."""
    g = weighted.where("src <> dst").distinct().groupBy("series_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("weight").alias("weight"), F.count_distinct("src").alias("k"))
    return g.where("k = 2").select("series_id", F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def motifs3(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``series_id, code, n``: weakly connected directed triples by isomorphism class.

    A triple's code is the least of its six adjacency codes; triples come from the wedges of the
    undirected graph, so only connected ones are made.
    """
    e = edges.where("src <> dst").select("series_id", "src", "dst").distinct()
    u = both_ways(simple_edges(e))
    wedge = u.select("series_id", F.col("u").alias("m"), F.col("v").alias("p")).join(u.select("series_id", F.col("u").alias("m"), F.col("v").alias("q")), ["series_id", "m"]).where("p < q")
    three = F.array_sort(F.array("m", "p", "q"))
    trio = wedge.select("series_id", three[0].alias("a"), three[1].alias("b"), three[2].alias("c")).distinct()
    names = ("a", "b", "c")
    slots = [(x, y) for x in range(3) for y in range(3) if x != y]
    flagged = trio
    for i, (x, y) in enumerate(slots):
        has = e.select("series_id", F.col("src").alias(names[x]), F.col("dst").alias(names[y]), F.lit(1).alias(f"f{i}"))
        flagged = flagged.join(has, ["series_id", names[x], names[y]], "left")
    flagged = flagged.fillna(0, [f"f{i}" for i in range(6)])
    codes = []
    for perm in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
        code = F.lit(0)
        for i, (x, y) in enumerate(slots):
            code = code + F.col(f"f{slots.index((perm[x], perm[y]))}") * (1 << i)
        codes.append(code)
    return flagged.withColumn("code", F.least(*codes)).groupBy("series_id", "code").agg(F.count(F.lit(1)).alias("n"))
