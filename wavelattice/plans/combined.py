"""Queries of measures put together, weights, layouts, windows and streams (A13, B6, B7, D17, F9, G9, G10, G13, G16, J16, ST3, X3, Z6, Z8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelattice.operators import combined, events, graph, multivariate, transition, windows
from wavelattice.operators.visibility import hvg_edges, nvg_edges
from wavelattice.plans.common import DEGREES, HVG, POINTS, nvg, r, rounded, user_points
from wavelattice.plans.dynamics import ORACLES as DYNAMICS
from wavelattice.plans.models import _drained, _stream
from wavelattice.plans.pipeline import GraphBuilder
from wavelattice.plans.relations import ORACLES as RELATIONS
from wavelattice.plans.relations import _flat, _sides
from wavelattice.plans.visibility import _TRI
from wavelattice.plans.visibility import ORACLES as VISIBILITY
from wavelattice.session import read_table
from wavelattice.sources.readers import named_distances
from wavelattice.streaming.windows import count_windows


def _hvg(spark, d):
    p = user_points(spark, d)
    return p, hvg_edges(p)


def a13_window_aggregate(spark, d):
    stats = windows.windowed_graph_stats(user_points(spark, d), 24, 12, hvg_edges)
    return rounded(windows.window_aggregate(stats, "mean"))


def b6_network_metrics(spark, d):
    return rounded(GraphBuilder("nvg").network_metrics(user_points(spark, d), ("clustering",)))


def b7_test_significance(spark, d):
    return GraphBuilder("nvg").test_significance(user_points(spark, d), ("n_edges", "max_degree"), count=5)


def d17_spike_distances(spark, d):
    """Van Rossum distances of all users' events above 50."""
    e = user_points(spark, d).where("value > 50").select("series_id", F.col("t").alias("event_t"))
    return events.spike_distances(e, 2.0, decimals=6)


def f9_transition_map(spark, d):
    net = transition.transition_network(user_points(spark, d), "ordinal", 3)
    flat = lambda c: F.array_join(F.flatten(c).cast("array<string>"), "").alias(c)
    m = transition.transition_map(net.select("series_id", flat("src"), flat("dst"), "weight"))
    pairs = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return m.select("series_id", F.array_join(pairs, ",").alias("counts"))


def g9_label_propagation(spark, d):
    p, e = _hvg(spark, d)
    return combined.label_propagation(graph.nodes_of(p), e)


def g10_network_metrics(spark, d):
    p, e = _hvg(spark, d)
    return rounded(combined.network_metrics(graph.nodes_of(p), e), 6)


def g13_extended_features(spark, d):
    p = user_points(spark, d)
    return rounded(combined.extended_features(graph.nodes_of(p), nvg_edges(p)))


def g16_motif_counts(spark, d):
    p, e = _hvg(spark, d)
    return combined.motif_counts(graph.nodes_of(p), e, "undirected-4")


def j16_named_distances(spark, d):
    """Distances of nations' customers (difference of mean balances), numbered, with the nations' names."""
    mean = read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias("b"))
    pairs = mean.select(F.col("c_nationkey").alias("i"), F.col("b").alias("bi")).join(mean.select(F.col("c_nationkey").alias("j"), F.col("b").alias("bj")), F.col("i") < F.col("j"))
    named = named_distances(pairs.select("i", "j", F.abs(F.col("bi") - F.col("bj")).alias("distance")), read_table(spark, d, "nation"), "n_nationkey", "n_name")
    return rounded(named, 4)


def st3_count_windows(spark, d):
    return rounded(_drained(spark, count_windows(_stream(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 24, 12), "st3"), 6)


def _cross(mode: str):
    def query(spark, d):
        x1, x2 = _sides(spark, d)
        return rounded(_flat(multivariate.cross_weights(x1, x2, multivariate.cross_visibility(x1, x2), mode)))

    return query


def z6_scaled_layout(spark, d):
    return rounded(combined.scaled_layout(*_hvg(spark, d)))


def z8_circular_layout(spark, d):
    p, e = _hvg(spark, d)
    return rounded(combined.circular_layout(graph.nodes_of(p), e), 6)


QUERIES = {
    f.__name__: f
    for f in (
        a13_window_aggregate, b6_network_metrics, b7_test_significance, d17_spike_distances, f9_transition_map, g9_label_propagation, g10_network_metrics,
        g13_extended_features, g16_motif_counts, j16_named_distances, st3_count_windows, z6_scaled_layout, z8_circular_layout,
    )
} | {f"x3_cross_{mode}": _cross(mode) for mode in ("absdiff", "time_gap", "slope")}

_AT = RELATIONS["x2_cross_hvg"].index("select m1.a")
_CROSS = f"{RELATIONS['x2_cross_hvg'][:_AT].rstrip()}, e as ({RELATIONS['x2_cross_hvg'][_AT:]}), ev as (select e.a, e.b, e.src, e.dst, e.dst - sz.n1 as j, p.x as va, q.x as vb from e join sz on sz.a = e.a and sz.b = e.b join x1 p on p.a = e.a and p.b = e.b and p.t = e.src join x2 q on q.a = e.a and q.b = e.b and q.t = e.dst - sz.n1)"
_CORES = VISIBILITY["g17_core_numbers"]

ORACLES = {
    "a13_window_aggregate": f"select series_id, window_id, avg_degree as value from ({DYNAMICS['w5_window_hvg']})",
    "b6_network_metrics": f"select g.*, n.n_nodes from ({VISIBILITY['g1_clustering']}) g join (with {POINTS} select series_id, count(*) as n_nodes from pts group by 1) n using (series_id)",
    "d17_spike_distances": f"""with {POINTS}, ev as (select series_id, t from pts where x > 50), s as (select a.series_id as i, b.series_id as j, sum(exp(-abs(a.t - b.t) / 2.0)) as s from ev a join ev b on abs(a.t - b.t) <= 80 group by 1, 2),
      ids as (select distinct series_id from ev) select a.series_id as i, b.series_id as j, {r('sqrt(greatest(x.s + y.s - 2 * coalesce(z.s, 0), 0))', 6)} as dist
      from ids a join ids b on a.series_id < b.series_id join s x on x.i = a.series_id and x.j = a.series_id join s y on y.i = b.series_id and y.j = b.series_id left join s z on z.i = a.series_id and z.j = b.series_id""",
    "f9_transition_map": f"select series_id, string_agg(src || '>' || dst || '=' || weight, ',' order by src || '>' || dst || '=' || weight) as counts from ({DYNAMICS['t7_transitions']}) group by 1",
    "g13_extended_features": f"""select t.*, c.core from (with {POINTS}, {nvg()}, {DEGREES}, {_TRI} select series_id, node, degree, triangles, cast(degree * (degree - 1) / 2 as bigint) as wedges, degree + triangles as ego_edges,
      {r('case when degree > 0 then 2.0 * (degree + triangles) / (degree * (degree + 1)) else 0.0 end')} as ego_density from nt) t join ({_CORES}) c using (series_id, node)""",
    "j16_named_distances": f"""with m as (select c_nationkey as k, round(avg(c_acctbal), 6) as b from customer group by 1)
      select x.n_name as name_i, y.n_name as name_j, {r('abs(p.b - q.b)', 4)} as distance from m p join m q on p.k < q.k join nation x on x.n_nationkey = p.k join nation y on y.n_nationkey = q.k""",
    "q13_link_significance": f"""select i, j, dist, p, dist <= 0.8 and p < 0.05 as significant from ({RELATIONS['d1_correlation']}) cross join (select avg(case when dist > 0.8 then 1.0 else 0.0 end) as p from ({RELATIONS['d1_correlation']}))""",
    "st3_count_windows": f"""with {POINTS}, n as (select series_id, count(*) as n from pts group by 1) select w.series_id, w.w as window_id, {r('avg(p.x)', 6)} as mean, {r('min(p.x)', 6)} as low, {r('max(p.x)', 6)} as high
      from (select series_id, unnest(range(0, (n - 24) // 12 + 1)) as w from n where n >= 24) w join pts p on p.series_id = w.series_id and p.t between w.w * 12 and w.w * 12 + 23 group by 1, 2""",
    "x3_cross_absdiff": f"{_CROSS} select a, b, src, dst, {r('abs(vb - va)')} as weight from ev",
    "x3_cross_time_gap": f"{_CROSS} select a, b, src, dst, cast(abs(j - src) as double) as weight from ev",
    "x3_cross_slope": f"{_CROSS} select a, b, src, dst, case when j - src + 1 <> 0 then {r('(vb - va) / (j - src + 1)')} end as weight from ev",
    "z6_scaled_layout": f"""with {POINTS}, {HVG}, m as (select series_id, min(x) as lo, max(x) as hi from pts group by 1), y as (select p.series_id, p.t, case when hi > lo then (x - lo) / (hi - lo) else 0.5 end as y from pts p join m using (series_id))
      select e.series_id, e.src, e.dst, {r('a.y')} as y_src, {r('b.y')} as y_dst from e join y a on a.series_id = e.series_id and a.t = e.src join y b on b.series_id = e.series_id and b.t = e.dst""",
    "z8_circular_layout": f"""with {POINTS}, {HVG}, {DEGREES} select series_id, node, {r('cos(2 * pi() * (row_number() over w - 1) / count(*) over (partition by series_id))', 6)} as x,
      {r('sin(2 * pi() * (row_number() over w - 1) / count(*) over (partition by series_id))', 6)} as y, cast(degree as double) as colour from deg window w as (partition by series_id order by node)""",
}
