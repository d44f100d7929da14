"""Further queries: symmetrised edges, ordinal partitions, window labels, describe, plots' data, variants of distances and tests."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import functions as F

from wavelattice.operators import distances as dist
from wavelattice.operators import events, graph, graphpaths, recurrence, significance, transition, windows
from wavelattice.operators.series import finite
from wavelattice.operators.visibility import hvg_edges, nvg_edges
from wavelattice.plans.common import DEGREES, HVG, PANEL, POINTS, nvg, r, rounded, type_days, user_points
from wavelattice.plans.relations import _flat, _pairs_xy, _sides
from wavelattice.session import read_table
from wavelattice.sources.readers import from_pandas


def t10_pattern_motifs(spark, d):
    """Three-node motifs of the ordinal transition graph of each user."""
    net = transition.transition_network(user_points(spark, d), "ordinal", 3)
    number = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, x: a * 10 + x)
    e = net.select("series_id", number("src").alias("src"), number("dst").alias("dst"))
    nodes = graph.both_ways(e).select("series_id", F.col("u").alias("node")).distinct()
    return graph.motifs3(nodes, e)


def t12_ordinal_partition(spark, d):
    """Nodes of the ordinal partition graph with their visits and first visit."""
    s = transition.ordinal_symbols(user_points(spark, d), 3)
    n = s.groupBy("series_id", "symbol").agg(F.count(F.lit(1)).alias("visits"), F.min("t").alias("first_t"))
    return n.select("series_id", F.array_join(F.col("symbol").cast("array<string>"), "").alias("pattern"), "visits", "first_t")


def w3_labelled_windows(spark, d):
    """Windows with the place of their first point."""
    w = windows.sliding_windows(user_points(spark, d), 30, 15)
    return rounded(w.groupBy("series_id", "window_id").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.avg("value").alias("mean")))


def a20_describe(spark, d):
    """Statistics over series of their number of edges."""
    p = user_points(spark, d)
    s = graph.summary(graph.nodes_of(p), hvg_edges(p))
    q = F.percentile("avg_degree", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = s.agg(F.count(F.lit(1)).alias("n"), F.avg("avg_degree").alias("mean"), F.stddev_samp("avg_degree").alias("std"), F.min("avg_degree").alias("min"), F.max("avg_degree").alias("max"), q.alias("q"))
    return rounded(a.select("n", "mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")), 7)


def u2_max_symmetrised(spark, d):
    """Nearest-neighbour arcs as undirected edges with the greater distance."""
    return rounded(graph.max_symmetrise(recurrence.knn_arcs(user_points(spark, d), 2).withColumnRenamed("dist", "weight")))


def k7_random_sample(spark, d):
    """A seeded sample of a hundred points, without replacement (a sampling operator)."""
    return user_points(spark, d).orderBy(F.xxhash64("series_id", "t", F.lit(42)), "series_id", "t").limit(100)


def g6_mean_shortest_path(spark, d):
    p = user_points(spark, d)
    return rounded(graphpaths.mean_shortest_path(graph.nodes_of(p), hvg_edges(p)))


def r14_recurrence_cells(spark, d):
    """Cells of the recurrence matrix, both ways round and without the diagonal."""
    e = recurrence.epsilon_edges(user_points(spark, d), 1.0)
    return graph.both_ways(e).select("series_id", F.col("u").alias("i"), F.col("v").alias("j"))


def z1_series_with_events(spark, d):
    """Every point with a mark where it is an event."""
    p = user_points(spark, d)
    e = events.detect_events(p).select("series_id", F.col("event_t").alias("t"), F.lit(True).alias("e"))
    return p.join(e, ["series_id", "t"], "left").select("series_id", "t", "value", F.coalesce("e", F.lit(False)).alias("is_event"))


def z2_degree_profile(spark, d):
    """Degree of every point beside its series' mean."""
    from pyspark.sql import Window

    p = user_points(spark, d)
    g = graph.degrees(graph.nodes_of(p), nvg_edges(p))
    return rounded(g.select("series_id", "node", "degree", F.avg("degree").over(Window.partitionBy("series_id")).alias("mean_degree")))


def d14_nmi_32(spark, d):
    return rounded(dist.pair_distances(type_days(spark, d), partial(dist.mutual_information, bins=32)))


def d15_voi_32(spark, d):
    return rounded(dist.pair_distances(type_days(spark, d), partial(dist.variation_of_information, bins=32)))


def d1_correlation_users(spark, d):
    """Correlation distances of all users' daily means over the days that both have: many blocks' worth of pairs."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)).alias("t")
    usable = F.col("user_id").isNotNull() & F.col("ts").isNotNull() & finite(F.col("value"))
    days = read_table(spark, d, "events").where(usable).groupBy(F.col("user_id").alias("series_id"), day).agg(F.round(F.avg("value"), 6).alias("value"))
    return dist.pair_distances(dist.aligned(days), "overlap_correlation", block=64, decimals=6)


def e2_event_sync_fixed(spark, d):
    x1, x2 = _sides(spark, d)
    ev = lambda x: x.where("value > 50").select("series_id", F.col("t").alias("event_t"))
    return _flat(events.sync_greedy(ev(x1), ev(x2), adaptive=False, tau=1.0, normalise="min"))


def e5_random_events(spark, d):
    return events.random_events(spark, 50, 1000)


def q1_t_pvalues(spark, d):
    """Correlations of neighbouring users with their two-sided p under the t distribution."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([significance.t_pvalue(a, int(b)) if a == a else 1.0 for a, b in zip(rs, ns)])

    c = significance.correlation_significance(_pairs_xy(spark, d))
    return _flat(c).select("a", "b", "r", "n", p("r", "n").alias("p"))


def q3_ccf_permutation(spark, d):
    return _flat(significance.permutation_pvalues(_pairs_xy(spark, d), 29, max_lag=3))


def q11_metrics_significance(spark, d):
    """Three metrics against one set of surrogates."""
    metric = lambda p: graph.summary(graph.nodes_of(p), nvg_edges(p)).select("series_id", "n_edges", "avg_degree", "max_degree")
    return significance.metric_significance(user_points(spark, d), metric, ["n_edges", "avg_degree", "max_degree"], "block_bootstrap", 5)


def s9_pandas_adapter(spark, d):
    """A small pandas table as series."""
    pdf = pd.DataFrame({"g": ["b", "a", "a", "b"], "at": [1, 2, 1, 0], "v": [1.0, float("nan"), 3.0, 4.0]})
    return from_pandas(spark, pdf, "v", "g", "at")


QUERIES = {
    f.__name__: f
    for f in (
        t10_pattern_motifs, t12_ordinal_partition, w3_labelled_windows, a20_describe, u2_max_symmetrised, k7_random_sample, g6_mean_shortest_path, r14_recurrence_cells,
        z1_series_with_events, z2_degree_profile, d14_nmi_32, d15_voi_32, d1_correlation_users, e2_event_sync_fixed, e5_random_events, q1_t_pvalues, q3_ccf_permutation, q11_metrics_significance, s9_pandas_adapter,
    )
}

_P = f"with {POINTS}"
_ORD = """o as (select series_id, t, x as a, lead(x, 1) over w as b, lead(x, 2) over w as c from pts window w as (partition by series_id order by t)),
ord as (select series_id, t, case when a <= b and b <= c then '012' when a <= c and c < b then '021' when b < a and a <= c then '102' when b <= c and c < a then '120'
  when c < a and a <= b then '201' else '210' end as symbol from o where c is not null)"""


def _codes(bins: int) -> str:
    inner = " + ".join(f"(case when l.lo + {k} * (l.hi - l.lo) / {bins} <= p.x then 1 else 0 end)" for k in range(1, bins))
    return f"""with {PANEL}, lm as (select series_id, min(x) as lo, max(x) as hi from pts group by 1), cd as (select p.series_id, p.t, ({inner}) as c from pts p join lm l using (series_id)),
      jc as (select a.series_id as i, b.series_id as j, a.c as ca, b.c as cb, count(*) as n from cd a join cd b on a.t = b.t and a.series_id < b.series_id group by 1, 2, 3, 4),
      jp as (select i, j, ca, cb, n / cast(sum(n) over (partition by i, j) as double) as p from jc), hj as (select i, j, -sum(p * ln(p)) as h from jp group by 1, 2),
      hx as (select i, j, -sum(p * ln(p)) as h from (select i, j, ca, sum(p) as p from jp group by 1, 2, 3) group by 1, 2), hy as (select i, j, -sum(p * ln(p)) as h from (select i, j, cb, sum(p) as p from jp group by 1, 2, 3) group by 1, 2),
      hh as (select hj.i, hj.j, hj.h as hj, hx.h as hx, hy.h as hy from hj join hx using (i, j) join hy using (i, j))"""


ORACLES = {
    "t12_ordinal_partition": f"{_P}, {_ORD} select series_id, symbol as pattern, count(*) as visits, min(t) as first_t from ord group by 1, 2",
    "w3_labelled_windows": f"""{_P}, n as (select series_id, count(*) as n from pts group by 1), w as (select p.series_id, w.w as window_id, p.t, p.x from pts p join n using (series_id) join (select unnest(range(0, 10000)) as w) w
      on w.w * 15 <= p.t and p.t < w.w * 15 + 30 and w.w * 15 + 30 <= n.n) select series_id, window_id, min(t) as start, max(t) as "end", {r('avg(x)')} as mean from w group by 1, 2""",
    "a20_describe": f"""{_P}, {HVG}, {DEGREES}, s as (select series_id, avg(degree) as v from deg group by 1)
      select count(*) as n, {r('avg(v)', 7)} as mean, {r('stddev_samp(v)', 7)} as std, {r('min(v)', 7)} as min, {r('max(v)', 7)} as max, {r('quantile_cont(v, 0.25)', 7)} as q25, {r('quantile_cont(v, 0.5)', 7)} as q50, {r('quantile_cont(v, 0.75)', 7)} as q75 from s""",
    "u2_max_symmetrised": f"""{_P}, k as (select a.series_id, a.t as a, b.t as b, abs(a.x - b.x) as w from pts a join pts b on a.series_id = b.series_id and a.t <> b.t qualify row_number() over (partition by a.series_id, a.t order by abs(a.x - b.x), b.t) <= 2)
      select series_id, least(a, b) as src, greatest(a, b) as dst, {r('max(w)')} as weight from k group by 1, 2, 3""",
    "g6_mean_shortest_path": f"""with recursive {POINTS}, {HVG}, w as (select series_id, src as u, dst as v from e union all select series_id, dst, src from e),
      walk(series_id, a, node, k) as (select series_id, t, t, 0 from pts union select q.series_id, q.a, w.v, q.k + 1 from walk q join w on w.series_id = q.series_id and w.u = q.node where q.k < 16),
      far as (select series_id, a, node, min(k) as k from walk group by 1, 2, 3) select series_id, {r('avg(k)')} as mean_path from far where a <> node group by 1""",
    "r14_recurrence_cells": f"{_P} select a.series_id, a.t as i, b.t as j from pts a join pts b on a.series_id = b.series_id and a.t <> b.t and abs(a.x - b.x) <= 1.0",
    "z1_series_with_events": f"{_P}, l as (select series_id, quantile_cont(x, 0.5) + stddev_pop(x) as l from pts group by 1) select p.series_id, p.t, p.x as value, p.x > l.l as is_event from pts p join l using (series_id)",
    "z2_degree_profile": f"{_P}, {nvg()}, {DEGREES} select series_id, node, degree, {r('avg(degree) over (partition by series_id)')} as mean_degree from deg",
    "d14_nmi_32": f"{_codes(32)} select i, j, {r('1 - 2 * (hx + hy - hj) / (hx + hy)')} as dist from hh",
    "d15_voi_32": f"{_codes(32)} select i, j, {r('2 * hj - hx - hy')} as dist from hh",
    "d1_correlation_users": f"""with l as (select user_id as series_id, date_trunc('day', ts) as t, round(avg(value), 6) as x from events
      where user_id is not null and ts is not null and value is not null and not isnan(value) and abs(value) < 'infinity'::double group by 1, 2)
      select a.series_id as i, b.series_id as j, {r('1 - abs(corr(a.x, b.x))', 6)} as dist from l a join l b on a.t = b.t and a.series_id < b.series_id group by 1, 2""",
    "s9_pandas_adapter": "select * from (values ('a', cast(0 as bigint), 3.0::double), ('b', cast(0 as bigint), 4.0::double), ('b', cast(1 as bigint), 1.0::double)) v(series_id, t, value)",
}
