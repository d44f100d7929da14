"""Queries of the visibility graphs and of the graph statistics and algorithms (V, A, G, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.operators import graph, graphpaths
from wavelattice.operators.visibility import edge_weights, hvg_edges, nvg_edges
from wavelattice.operators.series import number_points
from wavelattice.plans.common import DEGREES, HVG, ORDERS, POINTS, SUMMARY, nvg, order_days, r, rounded, user_points
from wavelattice.session import read_table

#: Horizon of ``v9_nvg_limited_edges``; the other queries on users' series have none.
LIMIT = 20


def _hvg(spark: SparkSession, d: str, **kw) -> tuple[DataFrame, DataFrame]:
    p = user_points(spark, d)
    return p, hvg_edges(p, **kw)


def _nvg(spark: SparkSession, d: str, **kw) -> tuple[DataFrame, DataFrame]:
    p = user_points(spark, d)
    return p, nvg_edges(p, **kw)


def v1_hvg_stats(spark, d):
    p, e = _hvg(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), e))


def v1_hvg_edges(spark, d):
    return _hvg(spark, d)[1]


def v1_hvg_edges_long(spark, d):
    return hvg_edges(order_days(spark, d), shard_points=300)


def _line(spark, d):
    """All of lineitem as one long series of prices, in order of order and line."""
    return number_points(read_table(spark, d, "lineitem").withColumn("one", F.lit("lineitem")), "one", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_extendedprice")


def v3_hvg_long_stats(spark, d):
    """One series of as many points as lineitem has rows, in shards."""
    p = _line(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), hvg_edges(p)))


def v13_nvg_long_stats(spark, d):
    """The same series within a horizon of 300 points."""
    p = _line(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), nvg_edges(p, 300)))


def v13_nvg_default_stats(spark, d):
    """The same series with the default horizon of series of more than 10,000 points."""
    p = _line(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), nvg_edges(p)))


def v2_hvg_loose_edges(spark, d):
    return _hvg(spark, d, tie_rule="loose")[1]


def v6_hvg_strict_edges(spark, d):
    return _hvg(spark, d, tie_rule="strict")[1]


def v5_hvg_limited_edges(spark, d):
    return _hvg(spark, d, limit=5)[1]


def v7_hvg_directed_degrees(spark, d):
    p, e = _hvg(spark, d)
    return graph.degrees(graph.nodes_of(p), e).select("series_id", "node", "in_degree", "out_degree")


def v8_nvg_edges(spark, d):
    return _nvg(spark, d)[1]


def v8_nvg_edges_long(spark, d):
    return nvg_edges(order_days(spark, d), shard_points=400)


def v9_nvg_limited_edges(spark, d):
    return _nvg(spark, d, limit=LIMIT)[1]


def v10_nvg_strict_edges(spark, d):
    return _nvg(spark, d, strict=True)[1]


def v11_nvg_stats(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), e))


def v12_nvg_capped_edges(spark, d):
    return _nvg(spark, d, max_edges_per_node=3, max_edges=60)[1]


def _weighted(mode: str):
    def query(spark, d):
        p, e = _hvg(spark, d)
        return rounded(edge_weights(p, e, mode))

    return query


def v18_nvg_slopes(spark, d):
    p, e = _nvg(spark, d)
    return rounded(edge_weights(p, e, "slope"))


def a1_degrees(spark, d):
    p, e = _nvg(spark, d)
    return graph.degrees(graph.nodes_of(p), e).select("series_id", "node", "degree")


def a4_directed_stats(spark, d):
    p, e = _hvg(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), e, directed=True))


def a5_weight_stats(spark, d):
    p, e = _hvg(spark, d)
    return rounded(graph.weight_stats(edge_weights(p, e, "min_clearance")))


def a6_triangles(spark, d):
    p, e = _nvg(spark, d)
    return graph.triangles(e).groupBy("series_id").agg(F.count(F.lit(1)).alias("triangles"))


def a9_motif_summary(spark, d):
    p, e = _nvg(spark, d)
    return graph.motif_summary(graph.nodes_of(p), e)


def a12_assortativity(spark, d):
    return rounded(graph.assortativity(_nvg(spark, d)[1]))


def g1_clustering(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graph.clustering_stats(graph.nodes_of(p), e))


def g4_node_triangles(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graph.node_triangles(graph.nodes_of(p), e))


def g5_path_lengths(spark, d):
    p, e = _hvg(spark, d)
    return rounded(graphpaths.path_lengths(graph.nodes_of(p), e))


def a8_small_world(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graphpaths.small_world(graph.nodes_of(p), e))


def a7_graph_summary(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graphpaths.graph_summary(graph.nodes_of(p), e))


def _far_edges(spark, d):
    """HVG edges of at least three steps: a graph of several components."""
    p, e = _hvg(spark, d)
    return p, e.where("dst - src >= 3")


def g7_components(spark, d):
    p, e = _far_edges(spark, d)
    return graph.components(graph.nodes_of(p), e)


def g7_giant_component(spark, d):
    p, e = _far_edges(spark, d)
    return graph.giant_component(graph.nodes_of(p), e)


def g17_core_numbers(spark, d):
    p, e = _nvg(spark, d)
    return graph.core_numbers(graph.nodes_of(p), e)


def g14_motifs3(spark, d):
    p, e = _hvg(spark, d)
    return graph.motifs3(graph.nodes_of(p), e)


def g15_motifs4(spark, d):
    p, e = _hvg(spark, d)
    return graphpaths.motifs4(e)


def g8_communities(spark, d):
    p, e = _nvg(spark, d)
    return graphpaths.communities(graph.nodes_of(p), e)


def g8_modularity(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graphpaths.modularity(graph.nodes_of(p), e, _labels(p)))


def _labels(p: DataFrame) -> DataFrame:
    """A fixed partition for the score: stretches of ten points."""
    return p.select("series_id", F.col("t").alias("node"), F.floor(F.col("t") / 10).cast("long").alias("community"))


def g11_node_features(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graphpaths.node_features(graph.nodes_of(p), e))


def g12_node_roles(spark, d):
    p, e = _nvg(spark, d)
    return graphpaths.node_roles(graph.nodes_of(p), e)


def g11_pagerank(spark, d):
    p, e = _nvg(spark, d)
    return rounded(graphpaths.node_features(graph.nodes_of(p), e).select("series_id", "node", "pagerank", "closeness"))


def u3_mutual_edges(spark, d):
    """Nearest three values of each point that choose each other."""
    from wavelattice.operators.recurrence import knn_arcs

    return rounded(graph.mutual_edges(knn_arcs(user_points(spark, d), 3).withColumnRenamed("dist", "weight")))


WEIGHT_KEYS = {
    "v14_weight_absdiff": ("absdiff", "abs(b.x - a.x)"),
    "v15_weight_time_gap": ("time_gap", "cast(e.dst - e.src as double)"),
    "v16_weight_slope": ("slope", "(b.x - a.x) / cast(e.dst - e.src as double)"),
    "v19_weight_inv_dist": ("inv_dist", "1.0 / (cast(e.dst - e.src as double) + 1e-12)"),
    "v19_weight_distance": ("distance", "sqrt(cast(e.dst - e.src as double) * (e.dst - e.src) + (b.x - a.x) * (b.x - a.x))"),
    "v19_weight_product": ("product", "a.x * b.x"),
    "v19_weight_mean": ("mean", "(a.x + b.x) / 2"),
}

QUERIES = {
    f.__name__: f
    for f in (
        v1_hvg_stats, v1_hvg_edges, v1_hvg_edges_long, v2_hvg_loose_edges, v6_hvg_strict_edges, v5_hvg_limited_edges, v7_hvg_directed_degrees,
        v3_hvg_long_stats, v13_nvg_long_stats, v13_nvg_default_stats, v8_nvg_edges, v8_nvg_edges_long, v9_nvg_limited_edges, v10_nvg_strict_edges, v11_nvg_stats, v12_nvg_capped_edges, v18_nvg_slopes,
        a1_degrees, a4_directed_stats, a5_weight_stats, a6_triangles, a7_graph_summary, a8_small_world, a9_motif_summary, a12_assortativity,
        g1_clustering, g4_node_triangles, g5_path_lengths, g7_components, g7_giant_component, g8_communities, g8_modularity,
        g11_node_features, g11_pagerank, g12_node_roles, g14_motifs3, g15_motifs4, g17_core_numbers, u3_mutual_edges,
    )
} | {k: _weighted(mode) for k, (mode, _) in WEIGHT_KEYS.items()} | {"v17_weight_min_clearance": _weighted("min_clearance")}

_E_HVG = f"with {POINTS}, {HVG}"
_E_NVG = f"with {POINTS}, {nvg()}"
_BETWEEN = "(select max(m.x) from pts m where m.series_id = a.series_id and m.t > a.t and m.t < b.t)"


def _pairwise(op: str) -> str:
    """Everything between against the smaller end, by a window of running maxima."""
    return f"""with {POINTS}, pr as (select a.series_id, a.t as src, b.t as dst, a.x as xa, b.x as xb,
      max(b.x) over (partition by a.series_id, a.t order by b.t rows between unbounded preceding and 1 preceding) as m
      from pts a join pts b on a.series_id = b.series_id and b.t > a.t)
      select series_id, src, dst from pr where m is null or m {op} least(xa, xb)"""


_TRI = """s as (select distinct series_id, least(src, dst) as src, greatest(src, dst) as dst from e where src <> dst),
tri as (select x.series_id, x.src as a, x.dst as b, y.dst as c from s x join s y on y.series_id = x.series_id and y.src = x.dst join s z on z.series_id = x.series_id and z.src = x.src and z.dst = y.dst),
tn as (select series_id, v, count(*) as k from (select series_id, a as v from tri union all select series_id, b from tri union all select series_id, c from tri) group by 1, 2),
nt as (select g.series_id, g.node, g.degree, coalesce(tn.k, 0) as triangles, case when g.degree > 1 then 2.0 * coalesce(tn.k, 0) / (g.degree * (g.degree - 1)) else 0.0 end as clustering
  from deg g left join tn on tn.series_id = g.series_id and tn.v = g.node)"""

_COMPONENTS = """far as (select * from e where dst - src >= 3),
w as (select series_id, src as u, dst as v from far union all select series_id, dst, src from far),
reach(series_id, node, c) as (select series_id, t, t from pts union select r.series_id, w.v, r.c from reach r join w on w.series_id = r.series_id and w.u = r.node),
comp as (select series_id, node, min(c) as component from reach group by 1, 2)"""

ORACLES = {
    "v1_hvg_stats": f"{_E_HVG}, {DEGREES} {SUMMARY}",
    "v1_hvg_edges": f"{_E_HVG} select * from e",
    "v1_hvg_edges_long": f"with {ORDERS}, {HVG} select * from e",
    "v13_nvg_long_stats": f"""with pts as (select 'lineitem' as series_id, cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as t, l_extendedprice as x from lineitem where l_extendedprice is not null),
      {nvg(300)}, {DEGREES} {SUMMARY}""",
    "v2_hvg_loose_edges": _pairwise("<="),
    "v6_hvg_strict_edges": _pairwise("<"),
    "v5_hvg_limited_edges": f"{_E_HVG} select * from e where dst - src <= 5",
    "v7_hvg_directed_degrees": f"{_E_HVG}, {DEGREES} select series_id, node, in_degree, out_degree from deg",
    "v8_nvg_edges": f"{_E_NVG} select * from e",
    "v8_nvg_edges_long": f"with {ORDERS}, {nvg()} select * from e",
    "v9_nvg_limited_edges": f"with {POINTS}, {nvg(LIMIT)} select * from e",
    "v10_nvg_strict_edges": f"with {POINTS}, {nvg(strict=True)} select * from e",
    "v11_nvg_stats": f"{_E_NVG}, {DEGREES} {SUMMARY}",
    "v12_nvg_capped_edges": f"""{_E_NVG}, f as (select *, row_number() over (partition by series_id, src order by dst) as k from e)
      select series_id, src, dst from (select *, row_number() over (partition by series_id order by src, dst) as i from f where k <= 3) where i <= 60""",
    "v17_weight_min_clearance": f"""{_E_HVG} select e.series_id, e.src, e.dst, case when e.dst - e.src = 1 then 'infinity'::double else {r('least(a.x, b.x) - ' + _BETWEEN)} end as weight
      from e join pts a on a.series_id = e.series_id and a.t = e.src join pts b on b.series_id = e.series_id and b.t = e.dst""",
    "v18_nvg_slopes": f"""{_E_NVG} select e.series_id, e.src, e.dst, {r('(b.x - a.x) / cast(e.dst - e.src as double)')} as weight
      from e join pts a on a.series_id = e.series_id and a.t = e.src join pts b on b.series_id = e.series_id and b.t = e.dst""",
    "a1_degrees": f"{_E_NVG}, {DEGREES} select series_id, node, degree from deg",
    "a4_directed_stats": f"""{_E_HVG}, {DEGREES} select series_id, count(*) as n_nodes, cast(sum(out_degree) as bigint) as n_edges,
      {r('avg(out_degree)')} as avg_degree, {r('stddev_pop(out_degree)')} as std_degree, min(out_degree) as min_degree, max(out_degree) as max_degree,
      {r('case when count(*) > 1 then cast(sum(out_degree) as double) / (cast(count(*) as double) * (count(*) - 1)) else 0.0 end')} as density,
      {r('avg(in_degree)')} as avg_in_degree, {r('stddev_pop(in_degree)')} as std_in_degree, min(in_degree) as min_in_degree, max(in_degree) as max_in_degree,
      {r('avg(out_degree)')} as avg_out_degree, {r('stddev_pop(out_degree)')} as std_out_degree, min(out_degree) as min_out_degree, max(out_degree) as max_out_degree,
      {r('avg(case when in_degree + out_degree > 0 then abs(in_degree - out_degree) / cast(in_degree + out_degree as double) else 0.0 end)')} as irreversibility
      from deg group by series_id""",
    "a5_weight_stats": f"""{_E_HVG}, w as (select e.series_id, least(a.x, b.x) - {_BETWEEN} as weight
      from e join pts a on a.series_id = e.series_id and a.t = e.src join pts b on b.series_id = e.series_id and b.t = e.dst)
      select series_id, {r('min(weight)')} as min_weight, {r('max(weight)')} as max_weight, {r('avg(weight)')} as avg_weight, {r('stddev_pop(weight)')} as std_weight, count(*) - count(weight) as inf_weights from w group by 1""",
    "a6_triangles": f"{_E_NVG}, {DEGREES}, {_TRI} select series_id, count(*) as triangles from tri group by 1",
    "a9_motif_summary": f"""{_E_NVG}, {DEGREES}, {_TRI}, k as (select series_id, count(*) as n, cast(sum(triangles) / 3 as bigint) as t, cast(sum(degree * (degree - 1) / 2) as bigint) as w from nt group by 1)
      select series_id, t as triangles, w as wedges, cast(greatest(n * (n - 1) * (n - 2) / 6 - t - w, 0) as bigint) as other from k""",
    "a12_assortativity": f"""{_E_NVG}, {DEGREES}, b as (select series_id, src as u, dst as v from e union all select series_id, dst, src from e)
      select b.series_id, {r('corr(x.degree, y.degree)')} as assortativity from b join deg x on x.series_id = b.series_id and x.node = b.u join deg y on y.series_id = b.series_id and y.node = b.v group by 1""",
    "g1_clustering": f"""{_E_NVG}, {DEGREES}, {_TRI} select series_id, cast(sum(triangles) / 3 as bigint) as triangles, cast(sum(degree * (degree - 1) / 2) as bigint) as wedges,
      {r('avg(clustering)')} as avg_clustering, {r('avg(case when degree >= 2 then clustering end)')} as avg_clustering_connected, {r('stddev_pop(clustering)')} as std_clustering,
      {r('case when sum(degree * (degree - 1)) > 0 then 2.0 * sum(triangles) / sum(degree * (degree - 1)) else 0.0 end')} as transitivity from nt group by 1""",
    "g4_node_triangles": f"{_E_NVG}, {DEGREES}, {_TRI} select series_id, node, degree, triangles, {r('clustering')} as clustering from nt",
    "g5_path_lengths": f"""with recursive {POINTS}, {HVG}, w as (select series_id, src as u, dst as v from e union all select series_id, dst, src from e),
      walk(series_id, a, node, k) as (select series_id, t, t, 0 from pts union select q.series_id, q.a, w.v, q.k + 1 from walk q join w on w.series_id = q.series_id and w.u = q.node where q.k < 16),
      dist as (select series_id, a, node, min(k) as k from walk group by 1, 2, 3), ecc as (select series_id, a, max(k) as ecc from dist group by 1, 2)
      select x.series_id, x.n_nodes, x.avg_path, y.diameter, y.radius, y.std_eccentricity from
      (select series_id, cast(count(distinct a) as bigint) as n_nodes, {r('avg(case when a <> node then k end)')} as avg_path from dist group by 1) x join
      (select series_id, cast(max(ecc) as bigint) as diameter, cast(min(ecc) as bigint) as radius, {r('stddev_pop(ecc)')} as std_eccentricity from ecc group by 1) y on x.series_id = y.series_id""",
    "g17_core_numbers": f"""with recursive {POINTS}, {nvg()}, {DEGREES}, w as (select series_id, src as u, dst as v from e union all select series_id, dst, src from e),
      step(k, series_id, node, core, moved) as (select 0, series_id, node, degree, true from deg union all
        select k + 1, series_id, node, coalesce(h, 0), bool_or(coalesce(h, 0) < core) over () from
          (select p.k, p.series_id, p.node, p.core, max(least(q.core, q.r)) as h from step p left join
            (select w.series_id, w.u, s.core, row_number() over (partition by w.series_id, w.u order by s.core desc) as r from w join step s on s.series_id = w.series_id and s.node = w.v) q
            on q.series_id = p.series_id and q.u = p.node where p.moved group by all))
      select series_id, node, core from step where k = (select max(k) from step)""",
    "g7_components": f"with recursive {POINTS}, {HVG}, {_COMPONENTS} select * from comp",
    "g7_giant_component": f"""with recursive {POINTS}, {HVG}, {_COMPONENTS}, z as (select series_id, component, count(*) as n from comp group by 1, 2),
      b as (select * from z qualify row_number() over (partition by series_id order by n desc, component) = 1)
      select c.series_id, c.node from comp c join b on b.series_id = c.series_id and b.component = c.component""",
    "g8_modularity": f"""{_E_NVG}, {DEGREES}, m as (select series_id, cast(count(*) as double) as m from e group by 1),
      l as (select series_id, src // 10 as c, count(*) as l from e where src // 10 = dst // 10 group by 1, 2), k as (select series_id, node // 10 as c, sum(degree) as k from deg group by 1, 2)
      select k.series_id, {r('sum(coalesce(l.l, 0) / m.m - (k.k / (2 * m.m)) * (k.k / (2 * m.m)))')} as modularity from k join m on m.series_id = k.series_id left join l on l.series_id = k.series_id and l.c = k.c group by 1""",
    "u3_mutual_edges": f"""with {POINTS}, near as materialized (select a.series_id, a.t as src, b.t as dst, abs(a.x - b.x) as w from pts a join pts b on a.series_id = b.series_id and a.t <> b.t
      qualify row_number() over (partition by a.series_id, a.t order by abs(a.x - b.x), b.t) <= 3)
      select p.series_id, p.src, p.dst, {r('p.w')} as weight from near p join near q on q.series_id = p.series_id and q.src = p.dst and q.dst = p.src where p.src < p.dst""",
} | {
    k: f"""{_E_HVG} select e.series_id, e.src, e.dst, {r(sql)} as weight from e join pts a on a.series_id = e.series_id and a.t = e.src join pts b on b.series_id = e.series_id and b.t = e.dst"""
    for k, (_, sql) in WEIGHT_KEYS.items()
}
