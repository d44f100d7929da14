"""Queries of distances, networks of series, joint and cross graphs, events, significance, space (D, N, X, E, Q, SP, Z)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from wavelattice.operators import distances as dist
from wavelattice.operators import events, graph, multivariate, significance, spatial, windows
from wavelattice.operators.visibility import hvg_edges, nvg_edges
from wavelattice.plans.common import DEGREES, HVG, PANEL, POINTS, nvg, r, rounded, type_days, user_points
from wavelattice.session import read_table


def _distance(name: str, **options):
    def query(spark, d):
        fn = partial(dist.REGISTRY[name], **options) if options else name
        return rounded(dist.pair_distances(type_days(spark, d), fn))

    return query


def s21_partial_rows(spark, d):
    return rounded(dist.pair_distances(type_days(spark, d), "correlation", only=["click", "view"]))


def d19_percentile(spark, d):
    return rounded(dist.distance_percentile(dist.pair_distances(type_days(spark, d)), 40.0))


def d20_minmax(spark, d):
    return rounded(dist.normalise_distances(dist.pair_distances(type_days(spark, d)), 5))


def n1_knn_network(spark, d):
    return rounded(dist.knn_network(dist.pair_distances(type_days(spark, d)), 2))


def n1_knn_mutual(spark, d):
    return rounded(dist.knn_network(dist.pair_distances(type_days(spark, d)), 2, mutual=True))


def n11_knn_directed(spark, d):
    return rounded(dist.knn_network(dist.pair_distances(type_days(spark, d)), 2, directed=True))


def n2_epsilon_network(spark, d):
    return rounded(dist.epsilon_network(dist.pair_distances(type_days(spark, d)), percentile=50.0))


def n6_epsilon_closed(spark, d):
    return rounded(dist.epsilon_network(dist.pair_distances(type_days(spark, d)), epsilon=0.9, closed=True))


def n3_weighted_network(spark, d):
    return rounded(dist.weighted_network(dist.pair_distances(type_days(spark, d)), 0.95, lambda c: 1.0 / (1.0 + c)))


def n10_density_network(spark, d):
    return rounded(dist.density_network(dist.pair_distances(type_days(spark, d)), 0.3))


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def n4_nearest_vectors(spark, d):
    return rounded(dist.nearest_vectors(_vectors(spark, d), 5), 6)


def n5_nearest_within(spark, d):
    return rounded(dist.nearest_within(_vectors(spark, d), 10, 1.2), 6)


def sp1_radius_weights(spark, d):
    flat = _vectors(spark, d).select("id", F.slice("vec", 1, 2).alias("vec"))
    return spatial.radius_weights(flat, 0.2)


def sp2_knn_weights(spark, d):
    flat = _vectors(spark, d).select("id", F.slice("vec", 1, 2).alias("vec"))
    return spatial.knn_weights(flat, 3)


def sp3_moran(spark, d):
    v = _vectors(spark, d)
    return rounded(significance.moran(v.select(F.col("id").alias("node"), F.col("vec")[2].alias("value")), spatial.radius_weights(v.select("id", F.slice("vec", 1, 2).alias("vec")), 0.2)), 6)


def _next_user_pairs(points):
    """Each user with the next id."""
    ids = points.select("series_id").distinct()
    return ids.join(ids.select((F.col("series_id") - 1).alias("series_id")), "series_id").select(F.col("series_id").alias("a"), (F.col("series_id") + 1).alias("b"))


def _sides(spark, d):
    p = user_points(spark, d)
    return multivariate.pair_points(p, _next_user_pairs(p))


def _flat(df):
    return df.select(F.col("series_id.a").alias("a"), F.col("series_id.b").alias("b"), *[c for c in df.columns if c != "series_id"])


def x1_joint_recurrence(spark, d):
    x1, x2 = _sides(spark, d)
    return rounded(_flat(multivariate.joint_recurrence(x1, x2, 10.0)))


def x2_cross_hvg(spark, d):
    return _flat(multivariate.cross_visibility(*_sides(spark, d)))


def x2_cross_nvg(spark, d):
    return _flat(multivariate.cross_visibility(*_sides(spark, d), method="nvg"))


def x4_coupling(spark, d):
    return rounded(_flat(multivariate.coupling_strength(*_sides(spark, d), 10.0)))


def x5_compare_networks(spark, d):
    p = user_points(spark, d)
    n = graph.nodes_of(p)
    return rounded(multivariate.compare_networks(n, hvg_edges(p), n, nvg_edges(p)))


FEATURES = ["n_edges", "avg_degree", "std_degree", "density"]


def a18_features(spark, d):
    p = user_points(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), hvg_edges(p)).select("series_id", *FEATURES))


def a16_compare_features(spark, d):
    return rounded(multivariate.compare_features(a18_features(spark, d), FEATURES), 6)


def x6_cluster_series(spark, d):
    return multivariate.cluster_features(a18_features(spark, d), FEATURES, 3)


def a14_raw_stats(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    p = user_points(spark, d).groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("q"), F.count(F.lit(1)).alias("n"))
    return rounded(p.select("series_id", "mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "n"))


def e1_threshold_events(spark, d):
    return events.detect_events(user_points(spark, d), min_separation=2)


def e1_peak_events(spark, d):
    return events.detect_events(user_points(spark, d), "peaks", 40.0)


def e6_event_sync(spark, d):
    x1, x2 = _sides(spark, d)
    ev = lambda x: x.where("value > 50").select("series_id", F.col("t").alias("event_t"))
    return rounded(_flat(events.sync_all_pairs(ev(x1), ev(x2), 3.0)))


def e3_event_sync_greedy(spark, d):
    x1, x2 = _sides(spark, d)
    ev = lambda x: x.where("value > 50").select("series_id", F.col("t").alias("event_t"))
    return _flat(events.sync_greedy(ev(x1), ev(x2)))


def _pairs_xy(spark, d):
    x1, x2 = _sides(spark, d)
    return x1.withColumnRenamed("value", "x").join(x2.withColumnRenamed("value", "y"), ["series_id", "t"])


def q5_correlation_significance(spark, d):
    return rounded(_flat(significance.correlation_significance(_pairs_xy(spark, d))), 6)


def q6_ccf_significance(spark, d):
    return rounded(_flat(significance.cross_correlation_significance(*_sides(spark, d), max_lag=3)), 6)


def q7_false_discovery(spark, d):
    c = significance.correlation_significance(_pairs_xy(spark, d))
    z = F.abs(F.atanh(F.col("r")) * F.sqrt(F.col("n") - 3.0))
    tests = _flat(c).select("a", "b", F.round(F.exp(-z * z / 2), 9).alias("p"))  # an upper bound of the tail
    return significance.false_discovery(tests, "p", 0.6)


def q2_permutation_pvalues(spark, d):
    return _flat(significance.permutation_pvalues(_pairs_xy(spark, d), 49))


def q8_surrogates(spark, d):
    s = significance.surrogates(user_points(spark, d), "iaaft", 3)
    return s.select("series_id.series_id", "series_id.k", "t", "value")


def _metric(p):
    return graph.summary(graph.nodes_of(p), hvg_edges(p)).select("series_id", "n_edges", "std_degree")


def q10_metric_significance(spark, d):
    return significance.metric_significance(user_points(spark, d), _metric, ["n_edges", "std_degree"], "shuffle", 10)


def q12_zscores(spark, d):
    p = user_points(spark, d)
    first = p.where("t = 0").select("series_id", F.col("value").alias("v"))
    return rounded(significance.zscores(first, p.where("t > 0").select("series_id", F.col("value").alias("v"))))


def q13_link_significance(spark, d):
    return rounded(significance.link_significance(rounded(dist.pair_distances(type_days(spark, d))), 0.8))


def q14_motif_zscores(spark, d):
    p = user_points(spark, d)
    return significance.motif_zscores(graph.nodes_of(p), nvg_edges(p), 5)


def q16_partial_correlation(spark, d):
    return rounded(significance.partial_correlations(type_days(spark, d)), 6)


def z3_degree_ccdf(spark, d):
    """Share of nodes with a greater degree, per distinct degree."""
    from pyspark.sql import Window

    p = user_points(spark, d)
    c = graph.degrees(graph.nodes_of(p), hvg_edges(p)).groupBy("series_id", "degree").agg(F.count(F.lit(1)).alias("n"))
    by, whole = Window.partitionBy("series_id").orderBy("degree"), Window.partitionBy("series_id")
    return rounded(c.select("series_id", "degree", (1 - F.sum("n").over(by) / F.sum("n").over(whole)).alias("ccdf")))


def z5_window_features(spark, d):
    """Window features as z-scores over the windows of their series."""
    from pyspark.sql import Window

    w = windows.windowed_graph_stats(user_points(spark, d), 24, 12, hvg_edges)
    whole = Window.partitionBy("series_id")
    sd = F.stddev_pop("avg_degree").over(whole)
    return rounded(w.select("series_id", "window_id", F.when(sd > 1e-12, (F.col("avg_degree") - F.avg("avg_degree").over(whole)) / sd).otherwise(0.0).alias("z_avg_degree")), 6)


def z4_method_comparison(spark, d):
    """Graph sizes of both visibility graphs side by side."""
    p = user_points(spark, d)
    n = graph.nodes_of(p)
    out = None
    for name, e in (("hvg", hvg_edges(p)), ("nvg", nvg_edges(p))):
        s = graph.summary(n, e).select("series_id", F.lit(name).alias("method"), "n_edges", "avg_degree", "density")
        out = s if out is None else out.unionByName(s)
    return rounded(out)


QUERIES = {
    f.__name__: f
    for f in (
        s21_partial_rows, d19_percentile, d20_minmax, n1_knn_network, n1_knn_mutual, n11_knn_directed, n2_epsilon_network, n6_epsilon_closed, n3_weighted_network,
        n10_density_network, n4_nearest_vectors, n5_nearest_within, sp1_radius_weights, sp2_knn_weights, sp3_moran, x1_joint_recurrence, x2_cross_hvg, x2_cross_nvg, x4_coupling,
        x5_compare_networks, a18_features, a16_compare_features, x6_cluster_series, a14_raw_stats, e1_threshold_events, e1_peak_events, e6_event_sync, e3_event_sync_greedy,
        q2_permutation_pvalues, q5_correlation_significance, q6_ccf_significance, q7_false_discovery, q8_surrogates, q10_metric_significance, q12_zscores, q13_link_significance,
        q14_motif_zscores, q16_partial_correlation, z3_degree_ccdf, z4_method_comparison, z5_window_features,
    )
} | {
    "d1_correlation": _distance("correlation"), "d2_ccf": _distance("ccf"), "d3_dtw": _distance("dtw"), "d4_nmi": _distance("nmi"), "d5_voi": _distance("voi"),
    "d6_event_sync": _distance("es"), "d7_mic": _distance("mic"), "d8_van_rossum": _distance("vr"), "d10_metric_pearson": _distance("metric_correlation"),
    "d10_metric_spearman": _distance("metric_correlation", method="spearman"), "d11_metric_ccf": _distance("metric_ccf", max_lag=3), "d13_dtw_plain": _distance("dtw", normalise=False),
    "d18_euclidean": _distance("euclidean"), "d21_dtw_squared": _distance("dtw", window=5, squared=True),
}

_P = "with " + PANEL
_C = f"{_P}, dd as (select a.series_id as i, b.series_id as j, 1 - abs(corr(a.x, b.x)) as dist from pts a join pts b on a.t = b.t and a.series_id < b.series_id group by 1, 2)"
_BOTH = "bb as (select i, j, dist from dd union all select j, i, dist from dd), kk as (select * from bb qualify row_number() over (partition by i order by dist, j) <= 2)"
_CODES = """lm as (select series_id, min(x) as lo, max(x) as hi from pts group by 1),
cd as (select p.series_id, p.t, (""" + " + ".join(f"(case when l.lo + {k} * (l.hi - l.lo) / 10 <= p.x then 1 else 0 end)" for k in range(1, 10)) + """) as c from pts p join lm l using (series_id)),
jc as (select a.series_id as i, b.series_id as j, a.c as ca, b.c as cb, count(*) as n from cd a join cd b on a.t = b.t and a.series_id < b.series_id group by 1, 2, 3, 4),
jp as (select i, j, ca, cb, n / cast(sum(n) over (partition by i, j) as double) as p from jc),
hj as (select i, j, -sum(p * ln(p)) as h from jp group by 1, 2), hx as (select i, j, -sum(p * ln(p)) as h from (select i, j, ca, sum(p) as p from jp group by 1, 2, 3) group by 1, 2),
hy as (select i, j, -sum(p * ln(p)) as h from (select i, j, cb, sum(p) as p from jp group by 1, 2, 3) group by 1, 2),
hh as (select hj.i, hj.j, hj.h as hj, hx.h as hx, hy.h as hy from hj join hx using (i, j) join hy using (i, j))"""
_SIDES = f"""with {POINTS}, pairs as (select a.series_id as a, b.series_id as b from (select distinct series_id from pts) a join (select distinct series_id from pts) b on b.series_id = a.series_id + 1),
x1 as (select a, b, t, x from pairs join pts on pts.series_id = pairs.a), x2 as (select a, b, t, x from pairs join pts on pts.series_id = pairs.b),
sz as (select a, b, count(*) as n1 from x1 group by 1, 2)"""
_VEC = "vv as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"
_LINKS = "ww as (select p.id as i, q.id as j from vv p join vv q on p.id <> q.id and sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 0.2)"
_ZQ = "1.959963984540054"
_XY = _SIDES + ", xy as (select x1.a, x1.b, x1.t, x1.x as x, x2.x as y from x1 join x2 on x1.a = x2.a and x1.b = x2.b and x1.t = x2.t)"
_CI = f"""least(greatest(q, -1 + 1e-12), 1 - 1e-12)"""
_HD = f"with {POINTS}, {HVG}, {DEGREES}"

ORACLES = {
    "d1_correlation": f"{_C} select i, j, {r('dist')} as dist from dd",
    "s21_partial_rows": f"{_C} select i, j, {r('dist')} as dist from dd where i in ('click', 'view')",
    "d19_percentile": f"{_C} select {r('quantile_cont(dist, 0.4)')} as value from dd",
    "d20_minmax": f"{_C} select i, j, {r('dist / (select max(dist) from dd)')} as dist from dd",
    "d2_ccf": f"""{_P}, z as (select series_id, t, (x - avg(x) over (partition by series_id)) / (stddev_pop(x) over (partition by series_id) + 1e-10) as z, count(*) over (partition by series_id) as n from pts),
      c as (select a.series_id as i, b.series_id as j, b.t - a.t as lag, sum(a.z * b.z) / max(a.n) as c from z a join z b on a.series_id < b.series_id group by 1, 2, 3) select i, j, {r('1 - max(abs(c))')} as dist from c group by 1, 2""",
    "d4_nmi": f"{_P}, {_CODES} select i, j, {r('1 - 2 * (hx + hy - hj) / (hx + hy)')} as dist from hh",
    "d5_voi": f"{_P}, {_CODES} select i, j, {r('2 * hj - hx - hy')} as dist from hh",
    "d6_event_sync": f"""{_P}, md as (select series_id, quantile_cont(x, 0.5) as m from pts group by 1), pr as (select a.series_id as i, b.series_id as j, a.m from md a join md b on a.series_id < b.series_id),
      ex as (select pr.i, pr.j, p.t from pr join pts p on p.series_id = pr.i and p.x > pr.m), ey as (select pr.i, pr.j, p.t from pr join pts p on p.series_id = pr.j and p.x > pr.m),
      nx as (select i, j, count(*) as n from ex group by 1, 2), ny as (select i, j, count(*) as n from ey group by 1, 2),
      c as (select i, j, count(*) as c from ex where exists (select 1 from ey where ey.i = ex.i and ey.j = ex.j and abs(ey.t - ex.t) <= 1) group by 1, 2)
      select pr.i, pr.j, {r('case when nx.n is null or ny.n is null then 1.0 else 1 - 2 * coalesce(c.c, 0) / cast(nx.n + ny.n as double) end')} as dist from pr left join nx using (i, j) left join ny using (i, j) left join c using (i, j)""",
    "d8_van_rossum": f"""{_P}, md as (select series_id, quantile_cont(x, 0.5) as m from pts group by 1), sp as (select p.series_id, p.t from pts p join md using (series_id) where p.x > md.m),
      f as (select p.series_id, p.t, coalesce(sum(exp(-abs(p.t - sp.t))), 0) as f from pts p left join sp on sp.series_id = p.series_id group by 1, 2)
      select a.series_id as i, b.series_id as j, {r('sqrt(sum((a.f - b.f) * (a.f - b.f))) / sqrt(sum(a.f * a.f) + sum(b.f * b.f))')} as dist from f a join f b on a.t = b.t and a.series_id < b.series_id group by 1, 2""",
    "d10_metric_pearson": f"{_P} select a.series_id as i, b.series_id as j, {r('sqrt(2 * (1 - corr(a.x, b.x)))')} as dist from pts a join pts b on a.t = b.t and a.series_id < b.series_id group by 1, 2",
    "d10_metric_spearman": f"""{_P}, k as (select series_id, t, rank() over (partition by series_id order by x) + (count(*) over (partition by series_id, x) - 1) / 2.0 as k from pts)
      select a.series_id as i, b.series_id as j, {r('sqrt(2 * (1 - corr(a.k, b.k)))')} as dist from k a join k b on a.t = b.t and a.series_id < b.series_id group by 1, 2""",
    "d11_metric_ccf": f"""{_P}, c as (select a.series_id as i, b.series_id as j, b.t - a.t as lag, abs(corr(a.x, b.x)) as c from pts a join pts b on a.series_id < b.series_id and abs(b.t - a.t) <= 3 group by 1, 2, 3)
      select i, j, {r('sqrt(2 * (1 - max(c)))')} as dist from c group by 1, 2""",
    "d18_euclidean": f"{_P} select a.series_id as i, b.series_id as j, {r('sqrt(sum((a.x - b.x) * (a.x - b.x)))')} as dist from pts a join pts b on a.t = b.t and a.series_id < b.series_id group by 1, 2",
    "n1_knn_network": f"{_C}, {_BOTH} select least(i, j) as i, greatest(i, j) as j, {r('min(dist)')} as dist from kk group by least(i, j), greatest(i, j)",
    "n1_knn_mutual": f"{_C}, {_BOTH} select least(i, j) as i, greatest(i, j) as j, {r('min(dist)')} as dist from kk group by least(i, j), greatest(i, j) having count(*) = 2",
    "n11_knn_directed": f"{_C}, {_BOTH} select i, j, {r('dist')} as dist from kk",
    "n2_epsilon_network": f"{_C} select i, j, {r('dist')} as dist from dd where dist < (select quantile_cont(dist, 0.5) from dd)",
    "n6_epsilon_closed": f"{_C} select i, j, {r('dist')} as dist from dd where dist <= 0.9",
    "n3_weighted_network": f"{_C} select i, j, {r('dist')} as dist, {r('1.0 / (1.0 + dist)')} as weight from dd where dist > 0 and dist <= 0.95",
    "n10_density_network": f"{_C} select i, j, {r('dist')} as dist from dd where dist <= (select quantile_cont(dist, 0.3) from dd)",
    "n4_nearest_vectors": f"""select p.vec_id as i, q.vec_id as j, {r('list_distance(cast(p.embedding as double[]), cast(q.embedding as double[]))', 6)} as dist from embeddings p join embeddings q on p.vec_id <> q.vec_id
      qualify row_number() over (partition by p.vec_id order by list_distance(cast(p.embedding as double[]), cast(q.embedding as double[])), q.vec_id) <= 5""",
    "n5_nearest_within": f"""select i, j, {r('d', 6)} as dist from (select p.vec_id as i, q.vec_id as j, list_distance(cast(p.embedding as double[]), cast(q.embedding as double[])) as d from embeddings p join embeddings q on p.vec_id <> q.vec_id
      qualify row_number() over (partition by p.vec_id order by list_distance(cast(p.embedding as double[]), cast(q.embedding as double[])), q.vec_id) <= 10) where d < 1.2""",
    "sp1_radius_weights": f"with {_VEC}, {_LINKS} select i, j, 1.0::double as weight from ww",
    "sp2_knn_weights": f"""with {_VEC}, k as (select p.id as i, q.id as j from vv p join vv q on p.id <> q.id qualify row_number() over (partition by p.id order by sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.id) <= 3)
      select i, j, 1.0::double as weight from k union select j, i, 1.0::double from k""",
    "sp3_moran": f"""with {_VEC}, {_LINKS}, m as (select avg(z) as mu, count(*) as n from vv), zz as (select id, z - mu as z from vv, m), c as (select count(*) as s0, sum(a.z * b.z) as wz from ww join zz a on a.id = ww.i join zz b on b.id = ww.j), v as (select sum(z * z) as v from zz)
      select {r('m.n / cast(c.s0 as double) * c.wz / v.v', 6)} as moran_i from m, c, v""",
    "x1_joint_recurrence": f"""{_SIDES}, r1 as (select p.a, p.b, p.t as src, q.t as dst, abs(p.x - q.x) as d from x1 p join x1 q on p.a = q.a and p.b = q.b and p.t < q.t and abs(p.x - q.x) <= 10),
      r2 as (select p.a, p.b, p.t as src, q.t as dst, abs(p.x - q.x) as d from x2 p join x2 q on p.a = q.a and p.b = q.b and p.t < q.t and abs(p.x - q.x) <= 10)
      select r1.a, r1.b, r1.src, r1.dst, {r('(r1.d + r2.d) / 2')} as weight from r1 join r2 on r1.a = r2.a and r1.b = r2.b and r1.src = r2.src and r1.dst = r2.dst""",
    "x2_cross_hvg": f"""{_SIDES}, m1 as (select *, max(x) over (partition by a, b order by t rows between 1 following and unbounded following) as m from x1), m2 as (select *, max(x) over (partition by a, b order by t rows between unbounded preceding and 1 preceding) as m from x2)
      select m1.a, m1.b, m1.t as src, m2.t + sz.n1 as dst from m1 join m2 on m1.a = m2.a and m1.b = m2.b join sz on sz.a = m1.a and sz.b = m1.b where (m1.m is null or m1.m < least(m1.x, m2.x)) and (m2.m is null or m2.m < least(m1.x, m2.x))""",
    "x2_cross_nvg": f"""{_SIDES}, ln as (select a, b, t, x, 1 as s from x1 union all select x2.a, x2.b, x2.t + sz.n1, x2.x, 2 from x2 join sz on sz.a = x2.a and sz.b = x2.b),
      sl as (select p.a, p.b, p.t as src, q.t as dst, q.s, (q.x - p.x) / cast(q.t - p.t as double) as k from ln p join ln q on p.a = q.a and p.b = q.b and q.t > p.t where p.s = 1)
      select a, b, src, dst from (select *, max(k) over (partition by a, b, src order by dst rows between unbounded preceding and 1 preceding) as m from sl) where s = 2 and (m is null or k >= m)""",
    "x4_coupling": f"""{_SIDES}, e1 as (select p.a, p.b, p.t as src, q.t as dst from x1 p join x1 q on p.a = q.a and p.b = q.b and p.t < q.t and abs(p.x - q.x) <= 10), e2 as (select p.a, p.b, p.t as src, q.t as dst from x2 p join x2 q on p.a = q.a and p.b = q.b and p.t < q.t and abs(p.x - q.x) <= 10),
      c1 as (select a, b, 2.0 * count(*) as c from e1 group by 1, 2), c2 as (select a, b, 2.0 * count(*) as c from e2 group by 1, 2), c12 as (select e1.a, e1.b, 2.0 * count(*) as c from e1 join e2 on e1.a = e2.a and e1.b = e2.b and e1.src = e2.src and e1.dst = e2.dst group by 1, 2),
      k as (select sz.a, sz.b, cast(n1 * n1 as double) as n, cast(coalesce(c1.c, 0) as double) as c1, cast(coalesce(c2.c, 0) as double) as c2, cast(coalesce(c12.c, 0) as double) as c12 from sz left join c1 using (a, b) left join c2 using (a, b) left join c12 using (a, b))
      select a, b, {r('c12 / n')} as joint_rate, {r('case when c1 * c2 > 0 then (c12 / n) / ((c1 / n) * (c2 / n)) else 0.0 end')} as coupling,
      {r('case when c1 * (n - c1) * c2 * (n - c2) > 0 then (n * c12 - c1 * c2) / sqrt(c1 * (n - c1) * c2 * (n - c2)) else 0.0 end')} as synchronisation, {r('abs(c1 / n - c2 / n)')} as asymmetry from k""",
    "x5_compare_networks": f"""with {POINTS}, {HVG.replace(chr(10) + 'e as (', chr(10) + 'eh as (')}, {nvg()}, dh as (select p.series_id, p.t, count(k.v) as d from pts p left join (select series_id, src as v from eh union all select series_id, dst from eh) k on k.series_id = p.series_id and k.v = p.t group by 1, 2),
      dn as (select p.series_id, p.t, count(k.v) as d from pts p left join (select series_id, src as v from e union all select series_id, dst from e) k on k.series_id = p.series_id and k.v = p.t group by 1, 2),
      c as (select dh.series_id, coalesce(corr(dh.d, dn.d), 0) as c, count(*) as n from dh join dn on dh.series_id = dn.series_id and dh.t = dn.t group by 1),
      f as (select coalesce(eh.series_id, e.series_id) as series_id, count(case when eh.src is not null and e.src is not null then 1 end) as k, count(*) as u, count(eh.src) as m1, count(e.src) as m2 from eh full join e on eh.series_id = e.series_id and eh.src = e.src and eh.dst = e.dst group by 1)
      select c.series_id, {r('c.c')} as degree_correlation, {r('f.k / cast(f.u as double)')} as edge_overlap, {r('1 - abs(f.m1 - f.m2) / (c.n * (c.n - 1) / 2.0)')} as density_similarity,
      {r('(c.c + f.k / cast(f.u as double) + 1 - abs(f.m1 - f.m2) / (c.n * (c.n - 1) / 2.0)) / 3')} as structural_similarity from c join f using (series_id)""",
    "a18_features": f"""{_HD} select series_id, cast(sum(out_degree) as bigint) as n_edges, {r('avg(degree)')} as avg_degree, {r('stddev_pop(degree)')} as std_degree, {r('sum(out_degree) / (cast(count(*) as double) * (count(*) - 1) / 2.0)')} as density from deg group by 1""",
    "a16_compare_features": f"""{_HD}, s as (select series_id, cast(sum(out_degree) as double) as n_edges, {r('avg(degree)')} as avg_degree, {r('stddev_pop(degree)')} as std_degree, {r('sum(out_degree) / (cast(count(*) as double) * (count(*) - 1) / 2.0)')} as density from deg group by 1),
      l as (select 'n_edges' as feature, n_edges as v from s union all select 'avg_degree', avg_degree from s union all select 'std_degree', std_degree from s union all select 'density', density from s)
      select feature, {r('avg(v)', 6)} as mean, {r('stddev_samp(v)', 6)} as std, {r('min(v)', 6)} as min, {r('max(v)', 6)} as max, {r('max(v) - min(v)', 6)} as range, {r('stddev_samp(v) / avg(v)', 6)} as cv from l group by 1""",
    "a14_raw_stats": f"""with {POINTS} select series_id, {r('avg(x)')} as mean, {r('stddev_pop(x)')} as std, min(x) as min, max(x) as max, {r('quantile_cont(x, 0.25)')} as q25, {r('quantile_cont(x, 0.5)')} as median, {r('quantile_cont(x, 0.75)')} as q75, count(*) as n from pts group by 1""",
    "e1_threshold_events": f"""with {POINTS}, l as (select series_id, quantile_cont(x, 0.5) + stddev_pop(x) as l from pts group by 1), w as (select p.series_id, p.t, p.t - lag(p.t) over (partition by p.series_id order by p.t) as g from pts p join l using (series_id) where p.x > l.l)
      select series_id, t as event_t from w where g is null or g >= 2""",
    "e1_peak_events": f"""with {POINTS}, c as (select *, case when lag(x) over w is null or lag(x) over w <> x then 1 else 0 end as c from pts window w as (partition by series_id order by t)), g as (select *, sum(c) over (partition by series_id order by t) as g from c),
      f as (select series_id, g, min(t) as a, max(t) as b, any_value(x) as x from g group by 1, 2), n as (select *, lag(x) over (partition by series_id order by a) as l, lead(x) over (partition by series_id order by a) as rr from f)
      select series_id, (a + b) // 2 as event_t from n where x > l and x > rr and x >= 40""",
    "e6_event_sync": f"""{_SIDES}, g1 as (select a, b, t, t - lag(t) over (partition by a, b order by t) as k from x1 where x > 50), g2 as (select a, b, t, t - lag(t) over (partition by a, b order by t) as k from x2 where x > 50),
      c as (select g1.a, g1.b, sum(case when g1.t > g2.t then 1.0 when g1.t = g2.t then 0.5 else 0 end) as c12, sum(case when g1.t < g2.t then 1.0 when g1.t = g2.t then 0.5 else 0 end) as c21
        from g1 join g2 on g1.a = g2.a and g1.b = g2.b and abs(g1.t - g2.t) <= least(coalesce(g1.k, 6), coalesce(g2.k, 6), 6) / 2.0 group by 1, 2),
      n as (select * from (select a, b, count(*) as n1 from g1 group by 1, 2) join (select a, b, count(*) as n2 from g2 group by 1, 2) using (a, b))
      select a, b, {r('coalesce(c12, 0) / cast(n1 as double)')} as q12, {r('coalesce(c21, 0) / cast(n2 as double)')} as q21, {r('(coalesce(c12, 0) / cast(n1 as double) + coalesce(c21, 0) / cast(n2 as double)) / 2')} as q from n left join c using (a, b)""",
    "q5_correlation_significance": f"""{_XY}, c as (select a, b, corr(x, y) as q, count(*) as n from xy group by 1, 2), i as (select *, tanh(atanh({_CI}) - {_ZQ} / sqrt(n - 3)) as l, tanh(atanh({_CI}) + {_ZQ} / sqrt(n - 3)) as h from c)
      select a, b, {r('q', 6)} as r, n, {r('l', 6)} as lo, {r('h', 6)} as hi, l > 0 or h < 0 as significant from i""",
    "q6_ccf_significance": f"""{_SIDES}, c as (select x1.a, x1.b, x2.t - x1.t as lag, corr(x1.x, x2.x) as q, count(*) as n from x1 join x2 on x1.a = x2.a and x1.b = x2.b and abs(x2.t - x1.t) <= 3 group by 1, 2, 3),
      m as (select * from c where n >= 4 qualify row_number() over (partition by a, b order by round(q, 12) desc, lag) = 1), i as (select *, tanh(atanh({_CI}) - {_ZQ} / sqrt(n - 3)) as l, tanh(atanh({_CI}) + {_ZQ} / sqrt(n - 3)) as h from m)
      select a, b, lag, {r('q', 6)} as r, n, {r('l', 6)} as lo, {r('h', 6)} as hi, l > 0 or h < 0 as significant from i""",
    "q7_false_discovery": f"""{_XY}, c as (select a, b, corr(x, y) as q, count(*) as n from xy group by 1, 2), p as (select a, b, round(exp(-power(atanh(q) * sqrt(n - 3.0), 2) / 2), 9) as p from c),
      k as (select *, count(*) over (order by p range between unbounded preceding and current row) as k, count(*) over () as m from p) select a, b, p, p <= coalesce((select max(p) from k where p <= 0.6 * k / m), -1) as reject from p""",
    "q12_zscores": f"""with {POINTS}, n as (select series_id, avg(x) as m, stddev_samp(x) as s from pts where t > 0 group by 1) select p.series_id, {r('(p.x - n.m) / greatest(n.s, 1e-12)')} as z, {r('n.m')} as null_mean, {r('n.s')} as null_std from pts p join n using (series_id) where p.t = 0""",
    "z3_degree_ccdf": f"{_HD}, c as (select series_id, degree, count(*) as n from deg group by 1, 2) select series_id, degree, {r('1 - sum(n) over (partition by series_id order by degree) / cast(sum(n) over (partition by series_id) as double)')} as ccdf from c",
    "z4_method_comparison": f"""with {POINTS}, {HVG.replace(chr(10) + 'e as (', chr(10) + 'eh as (')}, {nvg()}, m as (select 'hvg' as method, * from eh union all select 'nvg', * from e), n as (select series_id, count(*) as n from pts group by 1)
      select m.series_id, m.method, count(*) as n_edges, {r('2.0 * count(*) / any_value(n.n)')} as avg_degree, {r('count(*) / (any_value(n.n) * (any_value(n.n) - 1) / 2.0)')} as density from m join n using (series_id) group by 1, 2""",
}
