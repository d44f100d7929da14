"""Path, community and role measures of one graph per series.

Shortest paths from every node and community moves need a whole graph at hand: each series is one
Arrow group, which bounds these measures to graphs that fit a task (the edge tables stay distributed).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.graph import assortativity, clustering_stats, core_numbers, degrees, node_triangles, simple_edges, summary, triangles
from wavelattice.operators.grouped import stream_groups
from wavelattice.session import cut_lineage, written


def _per_graph(nodes: DataFrame, edges: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(series, nodes, pairs)`` for every series; pairs are positions in the sorted nodes."""
    kind = nodes.schema["series_id"].dataType.simpleString()
    packed = nodes.select("series_id", F.col("node").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(simple_edges(edges).select("series_id", F.col("src").alias("a"), F.col("dst").alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf.loc[pdf["b"].isna(), "a"].to_numpy(np.int64))
        pairs = pdf[pdf["b"].notna()]
        u = np.searchsorted(own, pairs["a"].to_numpy(np.int64))
        v = np.searchsorted(own, pairs["b"].to_numpy(np.int64))
        order = np.lexsort((v, u))
        out = fn(own, u[order], v[order])
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        return out

    return packed.groupBy("series_id").applyInPandas(run, f"series_id {kind}, {schema}")


def _neighbours(n: int, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    a, b = np.r_[u, v], np.r_[v, u]
    order = np.lexsort((b, a))
    return np.split(b[order], np.searchsorted(a[order], np.arange(1, n)))


def _distances(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All pairs' hops by breadth-first search from every node (-1: not reachable)."""
    near = _neighbours(n, u, v)
    out = np.full((n, n), -1, dtype=np.int32)
    for s in range(n):
        row = out[s]
        row[s] = 0
        front, k = np.array([s]), 0
        while len(front):
            k += 1
            step = np.unique(np.concatenate([near[i] for i in front]))
            front = step[row[step] < 0]
            row[front] = k
    return out


def _largest(dist: np.ndarray) -> np.ndarray:
    """Nodes of the largest component, the first among equals."""
    reach = dist >= 0
    return np.flatnonzero(reach[int(np.argmax(reach.sum(1)))])


def path_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each series' largest component: size, mean path, diameter, radius, spread of eccentricity."""

    def fn(own, u, v):
        d = _distances(len(own), u, v)
        at = _largest(d)
        d = d[np.ix_(at, at)]
        n = len(at)
        ecc = d.max(1)
        mean = d.sum() / (n * (n - 1)) if n > 1 else np.nan
        return pd.DataFrame({"n_nodes": [n], "avg_path": [mean], "diameter": [int(ecc.max())], "radius": [int(ecc.min())], "std_eccentricity": [float(ecc.std())]})

    return _per_graph(nodes, edges, fn, "n_nodes long, avg_path double, diameter long, radius long, std_eccentricity double")


def mean_shortest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean over all pairs that reach one another, in every component."""

    def fn(own, u, v):
        d = _distances(len(own), u, v)
        pairs = d > 0
        return pd.DataFrame({"mean_path": [float(d[pairs].mean()) if pairs.any() else np.nan]})

    return _per_graph(nodes, edges, fn, "mean_path double")


def small_world(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Clustering and path of the giant component against a random graph's: C, L, their ratio sigma."""
    e = simple_edges(edges)
    paths = path_lengths(nodes, e)
    c = clustering_stats(nodes, e).join(summary(nodes, e).select("series_id", "density", "avg_degree"), "series_id").join(paths, "series_id")
    c_er = F.col("density")
    l_er = F.when(F.col("avg_degree") > 1, F.log("n_nodes") / F.log("avg_degree"))
    sigma = (F.col("avg_clustering") / c_er) / (F.col("avg_path") / l_er)
    return c.select("series_id", F.col("avg_clustering").alias("c"), F.col("avg_path").alias("l"), c_er.alias("c_random"), l_er.alias("l_random"), sigma.alias("sigma"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, density, degree mean and sample spread, assortativity, clustering and small-world measures."""
    e = simple_edges(edges)
    d = degrees(nodes, e).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.avg("degree").alias("deg_mean"), F.stddev_samp("degree").alias("deg_std"))
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0)
    out = d.withColumn("density", density).join(assortativity(e), "series_id", "left").join(clustering_stats(nodes, e).select("series_id", "avg_clustering", "triangles", "wedges"), "series_id")
    return out.join(small_world(nodes, e).select("series_id", "l", "sigma"), "series_id")


#: Kinds of connected quadruples, fuller ones first.
KINDS4 = ("K4", "diamond", "C4", "paw", "K13", "P4")
#: Wedges held at once where cycles of four are counted.
WEDGES = 4_000_000


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts``' places its number repeated that often, and 0, 1, ... within each."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _parts4(u: np.ndarray, v: np.ndarray, n: int, series: np.ndarray, k: int) -> np.ndarray:
    """Parts of four nodes (K4, diamond, C4, paw, K13, P4), not only full ones, of the ``k`` graphs in the edges u, v of nodes 0..n-1.

    Nodes are in order of degree, every arc leads to the later end; ``series`` is each node's graph.
    """
    degree = np.bincount(np.r_[u, v], minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(degree, kind="stable")] = np.arange(n)
    own = np.empty(n, np.int64)
    own[rank] = series
    d = np.sort(degree, kind="stable").astype(np.int64)
    a, b = np.minimum(rank[u], rank[v]), np.maximum(rank[u], rank[v])
    arc = np.sort(a * n + b)
    a, b = arc // n, arc % n
    out, first = np.bincount(a, minlength=n), np.searchsorted(a, np.arange(n))

    def total(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        sums = np.zeros(k, np.int64)
        np.add.at(sums, own[nodes], x)  # bincount sums doubles
        return sums

    def edge(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(arc, p * n + q), len(arc) - 1)
        return at, arc[at] == p * n + q

    on = np.zeros(len(arc), np.int64)  # triangles of each edge
    tri = np.zeros(n, np.int64)
    k4 = np.zeros(k, np.int64)
    # Arcs are taken in turns, so that few wedges are held; a turn has whole nodes.
    after = first[a] + out[a] - np.arange(len(arc)) - 1  # later arcs of the same start
    for lo, hi in _turns(np.add.reduceat(after, first[out > 0]) if len(arc) else after, out[out > 0]):
        x, place = _spread(after[lo:hi])
        x = x + lo
        y = x + 1 + place
        z, closed = edge(b[x], b[y])
        x, y, z = x[closed], y[closed], z[closed]
        for e in (x, y, z):
            np.add.at(on, e, 1)
        for e in (a[x], b[x], b[y]):
            np.add.at(tri, e, 1)
        # Triangles of one first arc, in order of their last node: two of them whose last nodes are joined make a K4.
        rest = np.cumsum(np.bincount(x - lo, minlength=hi - lo))[x - lo] - np.arange(len(x)) - 1
        step = max(1, WEDGES // int(rest.max(initial=1)))
        for f in range(0, len(x), step):
            t, place = _spread(rest[f : f + step])
            t = t + f
            full = edge(b[y[t]], b[y[t + 1 + place]])[1]
            k4 += total(a[x[t]][full], np.ones(int(full.sum()), np.int64))
    # Cycles of four by their latest node v: pairs of neighbours u of v and w of u, both before v.
    every = np.sort(np.r_[a * n + b, b * n + a])
    near_u, near_w = every // n, every % n
    begin = np.searchsorted(near_u, np.arange(n))
    before = np.lexsort((a, b))  # arcs by their later end
    v_of, u_of = b[before], a[before]
    c4 = np.zeros(k, np.int64)
    ends = np.bincount(v_of, minlength=n)
    for lo, hi in _turns(np.add.reduceat(d[u_of], np.searchsorted(v_of, np.flatnonzero(ends))) if len(arc) else d[:0], ends[ends > 0]):
        e, place = _spread(d[u_of[lo:hi]])
        v, w = v_of[lo:hi][e], near_w[begin[u_of[lo:hi][e]] + place]
        ok = w < v
        pair, c = np.unique(v[ok] * n + w[ok], return_counts=True)
        c4 += total(pair // n, c * (c - 1) // 2)
    node = np.arange(n)
    paths = total(a, (d[a] - 1) * (d[b] - 1)) - total(node, tri)
    return np.stack([k4, total(a, on * (on - 1) // 2), c4, total(node, tri * (d - 2)), total(node, d * (d - 1) * (d - 2) // 6), paths], 1)


def _turns(work: np.ndarray, arcs: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of arcs, whole groups of ``arcs`` each, of about ``WEDGES`` of ``work`` and not empty."""
    turn = np.cumsum(work) // WEDGES
    ends = np.cumsum(arcs)
    last = np.flatnonzero(np.r_[turn[1:] != turn[:-1], True][: len(turn)])
    stops = ends[last].tolist()
    return list(zip([0, *stops[:-1]], stops))


def _full4(parts: list) -> list:
    """Quadruples of each kind from ``_parts4``, columns or arrays: parts of kinds with more edges are taken off."""
    k4, diamond, c4, paw, star, path = parts
    diamond = diamond - 6 * k4
    c4 = c4 - diamond - 3 * k4
    paw = paw - 4 * diamond - 12 * k4
    star = star - paw - 2 * diamond - 4 * k4
    return [k4, diamond, c4, paw, star, path - 2 * paw - 4 * c4 - 6 * diamond - 12 * k4]


def motifs4(edges: DataFrame, most_local: int = 5_000_000) -> DataFrame:
    """``series_id, motif, n``: connected quadruples by kind (K4, diamond, C4, paw, K13, P4).

    No quadruple is made but the K4 and the pairs that close a cycle: parts of four nodes are counted from degrees, triangles of nodes
    and edges, and wedges, then parts of fuller kinds are taken off.  Graphs of at most ``most_local`` edges are counted
    many to a batch; larger ones by joins.
    """
    simple, _ = written(simple_edges(edges))
    large = simple.groupBy("series_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most_local).select("series_id")
    any_large = large.limit(1).count() > 0
    small = simple.join(large, "series_id", "left_anti") if any_large else simple
    kind = edges.schema["series_id"].dataType.simpleString()

    def count(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        sizes = rows["near"].map(len).to_numpy()
        graph = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rows)]))
        u = np.repeat(np.stack([graph, rows["node"].to_numpy()], 1), sizes, 0)
        v = np.concatenate(rows["near"].to_list()) if len(rows) else np.empty(0, np.int64)
        # Nodes are numbered over the whole batch.
        order = np.lexsort((np.r_[u[:, 1], v], np.r_[u[:, 0], u[:, 0]]))
        g, node = np.r_[u[:, 0], u[:, 0]][order], np.r_[u[:, 1], v][order]
        new = np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1])]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        full = np.stack(_full4(list(_parts4(number[: len(v)], number[len(v) :], int(new.sum()), g[new], len(starts)).T)), 1)
        at, what = np.nonzero(full)
        return pd.DataFrame({"series_id": rows["series_id"].to_numpy()[starts[at]], "motif": np.asarray(KINDS4)[what], "n": full[at, what]})

    near = small.groupBy("series_id", F.col("src").alias("node")).agg(F.collect_list("dst").alias("near"))
    out = stream_groups(near, ["series_id"], "node", count, f"series_id {kind}, motif string, n long")
    return out.unionByName(_motifs4_joined(simple.join(large, "series_id", "left_semi"))) if any_large else out


def _motifs4_joined(simple: DataFrame) -> DataFrame:
    """``motifs4`` of graphs too large for a task, the same counts by joins."""
    e, _ = written(simple)
    deg = e.select("series_id", F.explode(F.array("src", "dst")).alias("u")).groupBy("series_id", "u").agg(F.count(F.lit(1)).alias("d"))
    t, _ = written(triangles(e))
    one = lambda x: F.sum(x).cast("long")
    put = lambda df, i, x: df.groupBy("series_id").agg(one(x).alias("x")).select("series_id", F.lit(i).alias("i"), "x")
    sides = F.inline(F.array(*[F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), F.col(r).alias("far")) for p, q, r in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))]))
    with_sides = t.select("series_id", sides)
    on = with_sides.groupBy("series_id", "src", "dst").agg(F.count(F.lit(1)).alias("k"))
    tri = t.select("series_id", F.explode(F.array("a", "b", "c")).alias("u")).groupBy("series_id", "u").agg(F.count(F.lit(1)).alias("t"))
    with_d = e.join(deg.select("series_id", F.col("u").alias("src"), F.col("d").alias("ds")), ["series_id", "src"]).join(deg.select("series_id", F.col("u").alias("dst"), F.col("d").alias("dd")), ["series_id", "dst"])
    base = t.select("series_id", F.col("a").alias("p"), F.col("b").alias("q"), F.col("c").alias("r"))
    top = base.join(base.withColumnRenamed("r", "s"), ["series_id", "p", "q"]).where("r < s").join(e.select("series_id", F.col("src").alias("r"), F.col("dst").alias("s")), ["series_id", "r", "s"])
    # Cycles by their latest node in order of degree; ranks are (degree, node).
    both = with_d.select("series_id", F.inline(F.array(F.struct(F.struct(F.col("ds").alias("d"), F.col("src").alias("n")).alias("u"), F.struct(F.col("dd").alias("d"), F.col("dst").alias("n")).alias("v")), F.struct(F.struct(F.col("dd").alias("d"), F.col("dst").alias("n")).alias("u"), F.struct(F.col("ds").alias("d"), F.col("src").alias("n")).alias("v")))))
    cycle = both.where(F.col("u") < F.col("v")).join(both.select("series_id", "u", F.col("v").alias("w")), ["series_id", "u"]).where(F.col("w") < F.col("v"))
    pairs = cycle.groupBy("series_id", "v", "w").agg(F.count(F.lit(1)).alias("c"))
    rows = [
        put(top, 0, F.lit(1)), put(on, 1, F.expr("k * (k - 1) div 2")), put(pairs, 2, F.expr("c * (c - 1) div 2")), put(tri.join(deg, ["series_id", "u"]), 3, F.expr("t * (d - 2)")),
        put(deg, 4, F.expr("d * (d - 1) * (d - 2) div 6")), put(with_d, 5, F.expr("(ds - 1) * (dd - 1)")), put(tri, 5, -F.col("t")),
    ]
    every = rows[0]
    for x in rows[1:]:
        every = every.unionByName(x)
    parts = every.groupBy("series_id").agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("x"))), F.lit(0)).alias(f"p{i}") for i in range(6)])
    full = _full4([F.col(f"p{i}") for i in range(6)])
    return parts.select("series_id", F.inline(F.array(*[F.struct(F.lit(m).alias("motif"), x.cast("long").alias("n")) for m, x in zip(KINDS4, full)]))).where("n > 0")


def modularity(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman's score of a partition ``series_id, node, community`` (null without edges)."""
    e = simple_edges(edges)
    m = e.groupBy("series_id").agg(F.count(F.lit(1)).cast("double").alias("m"))
    a = labels.select("series_id", F.col("node").alias("src"), F.col("community").alias("ca"))
    b = labels.select("series_id", F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = e.join(a, ["series_id", "src"]).join(b, ["series_id", "dst"]).where("ca = cb").groupBy("series_id", F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    k = degrees(nodes, e).join(labels, ["series_id", "node"]).groupBy("series_id", "community").agg(F.sum("degree").alias("k"))
    per = k.join(m, "series_id").join(inside, ["series_id", "community"], "left").fillna(0, ["l"])
    half = F.col("k") / (2 * F.col("m"))
    return per.groupBy("series_id").agg(F.sum(F.col("l") / F.col("m") - half * half).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """``series_id, node, community``: Louvain local moves and aggregation, in node order, per series."""

    def fn(own, u, v):
        n = len(own)
        label = _louvain(n, u, v)
        first: dict[int, int] = {}
        return pd.DataFrame({"node": own, "community": [first.setdefault(c, len(first)) for c in label]})

    return _per_graph(nodes, edges, fn, "node long, community long")


def _louvain(n: int, u: np.ndarray, v: np.ndarray) -> list[int]:
    """Communities that no single move and no merge of whole communities improves."""
    weights: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b in zip(u.tolist(), v.tolist()):
        weights[a][b] = weights[a].get(b, 0.0) + 1.0
        weights[b][a] = weights[b].get(a, 0.0) + 1.0
    member = list(range(n))
    loops = [0.0] * n
    total = 2.0 * len(u)
    if not total:
        return member
    while True:
        size = len(weights)
        community = list(range(size))
        k = [sum(w.values()) + loops[i] for i, w in enumerate(weights)]
        mass = k[:]
        moved_any = False
        for _ in range(100):
            moved = False
            for i in range(size):
                here = community[i]
                links: dict[int, float] = {}
                for j, w in weights[i].items():
                    links[community[j]] = links.get(community[j], 0.0) + w
                mass[here] -= k[i]
                best, gain = here, links.get(here, 0.0) - mass[here] * k[i] / total
                for c in sorted(links):
                    g = links[c] - mass[c] * k[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                mass[best] += k[i]
                if best != here:
                    community[i] = best
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            return member
        names = {c: x for x, c in enumerate(dict.fromkeys(community))}
        member = [names[community[c]] for c in member]
        merged: list[dict[int, float]] = [{} for _ in names]
        new_loops = [0.0] * len(names)
        for i in range(size):
            a = names[community[i]]
            new_loops[a] += loops[i]
            for j, w in weights[i].items():
                b = names[community[j]]
                if a == b:
                    new_loops[a] += w
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        weights, loops = merged, new_loops


def _between(n: int, near: list[np.ndarray]) -> np.ndarray:
    """Betweenness by accumulation over breadth-first search trees, normalised, undirected."""
    score = np.zeros(n)
    for s in range(n):
        dist, paths = np.full(n, -1), np.zeros(n)
        dist[s], paths[s] = 0, 1.0
        order, front = [], [s]
        while front:
            order.append(front)
            step: list[int] = []
            for i in front:
                for j in near[i].tolist():
                    if dist[j] < 0:
                        dist[j] = dist[i] + 1
                        step.append(j)
                    if dist[j] == dist[i] + 1:
                        paths[j] += paths[i]
            front = step
        share = np.zeros(n)
        for front in reversed(order[1:]):
            for j in front:
                for i in near[j].tolist():
                    if dist[i] == dist[j] - 1:
                        share[i] += paths[i] / paths[j] * (1 + share[j])
                score[j] += share[j]
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def node_features(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, steps: int = 100) -> DataFrame:
    """Per node: degree, clustering, PageRank, eigenvector, core number, betweenness, closeness."""

    def fn(own, u, v):
        n = len(own)
        near = _neighbours(n, u, v)
        a, b = np.r_[u, v], np.r_[v, u]
        deg = np.bincount(a, minlength=n).astype(float)
        rank = np.full(n, 1.0 / n)
        for _ in range(steps):
            give = np.divide(rank, deg, out=np.zeros(n), where=deg > 0)
            new = (1 - damping) / n + damping * (np.bincount(b, weights=give[a], minlength=n) + rank[deg == 0].sum() / n)
            if np.abs(new - rank).sum() < 1e-12:
                rank = new
                break
            rank = new
        eigen = np.full(n, 1.0 / np.sqrt(n))
        for _ in range(500):
            new = eigen + np.bincount(b, weights=eigen[a], minlength=n)
            new /= np.linalg.norm(new)
            if np.abs(new - eigen).sum() < 1e-10:
                eigen = new
                break
            eigen = new
        d = _distances(n, u, v)
        reach, far = (d > 0).sum(1), np.where(d > 0, d, 0).sum(1)
        close = np.divide(reach * reach, far * (n - 1), out=np.zeros(n), where=(far > 0) & (n > 1))
        return pd.DataFrame({"node": own, "pagerank": rank, "eigenvector": eigen, "betweenness": _between(n, near), "closeness": close})

    rest = _per_graph(nodes, edges, fn, "node long, pagerank double, eigenvector double, betweenness double, closeness double")
    local = node_triangles(nodes, edges).select("series_id", "node", "degree", "clustering")
    return local.join(core_numbers(nodes, edges), ["series_id", "node"]).join(rest, ["series_id", "node"])


FEATURES = ("degree", "clustering", "pagerank", "eigenvector", "core", "betweenness", "closeness")


def node_roles(nodes: DataFrame, edges: DataFrame, n_roles: int = 4, seed: int = 42) -> DataFrame:
    """``series_id, node, role``: k-means over the node features, standardised within each series."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    f = node_features(nodes, edges)
    whole = Window.partitionBy("series_id")
    scaled = f.select("series_id", "node", *[((F.col(c) - F.avg(c).over(whole)) / (F.coalesce(F.stddev_samp(c).over(whole), F.lit(0.0)) + 1e-12)).alias(c) for c in FEATURES])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cut_lineage(scaled))
    model = KMeans(k=n_roles, seed=seed, maxIter=20).fit(vectors)
    return model.transform(vectors).select("series_id", "node", F.col("prediction").cast("int").alias("role"))
