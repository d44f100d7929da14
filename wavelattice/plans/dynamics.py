"""Queries of scans, windows, transitions and recurrence (S, P, W, T, R, Q15, Q17, Q18, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelattice.operators import graph, recurrence, series, transition, windows
from wavelattice.operators.visibility import hvg_edges, nvg_edges
from wavelattice.plans.common import HVG, ORDERS, PANEL, POINTS, nvg, order_days, r, rounded, type_days, user_points
from wavelattice.session import read_table


def s1_load_series(spark, d):
    """Scan, range filter, hourly buckets and cleaning of events by type."""
    out = series.load_series(read_table(spark, d, "events"), "ts", "value", "event_type", "2024-01-05", "2024-01-20", "1h", "mean")
    return rounded(out.select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "value"))


def s6_dedupe(spark, d):
    out = series.load_series(read_table(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", agg="max")
    return out.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


def _bucket(agg: str):
    def query(spark, d):
        out = series.load_series(read_table(spark, d, "events"), "ts", "value", "user_id", freq="1d", agg=agg)
        return rounded(out.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"), 6)

    return query


def s3_timezone(spark, d):
    out = series.load_series(read_table(spark, d, "events"), "ts", "value", "event_type", tz="Asia/Kolkata", freq="1d", agg="sum")
    return rounded(out.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"), 4)


def s20_json_series(spark, d):
    """Embedded JSON series, those of at least four numeric points that vary, with size and mean."""
    from wavelattice.sources.readers import json_series

    p = json_series(read_table(spark, d, "elec"), "record", least=4)
    return rounded(p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("value").alias("mean")), 6)


def p1_series_warnings(spark, d):
    return series.series_warnings(user_points(spark, d))


def p4_long_series(spark, d):
    return series.keep_long(user_points(spark, d), 65, varying=True)


def k5_top_series(spark, d):
    return series.top_series(user_points(spark, d), 10, 20)


def w1_sliding_windows(spark, d):
    return windows.sliding_windows(user_points(spark, d), 20, 7).select("series_id", "window_id", "pos", "value")


def w4_window_stats(spark, d):
    return rounded(windows.window_stats(windows.sliding_windows(user_points(spark, d), 20, 10)))


def w5_window_hvg(spark, d):
    return rounded(windows.windowed_graph_stats(user_points(spark, d), 24, 12, hvg_edges))


def w5_window_nvg(spark, d):
    return rounded(windows.windowed_graph_stats(user_points(spark, d), 24, 12, lambda p: nvg_edges(p, limit=24)))


def w8_coarse_grain(spark, d):
    out = None
    for m in windows.COARSE:
        c = windows.coarse_grain(user_points(spark, d), 5, m).withColumn("method", F.lit(m))
        out = c if out is None else out.unionByName(c)
    return rounded(out)


def w9_multiscale(spark, d):
    return rounded(windows.multiscale(user_points(spark, d), (1, 2, 4, 8), hvg_edges))


def w15_autocorrelation(spark, d):
    return rounded(windows.lag_autocorrelation(user_points(spark, d)))


def w16_neighbour_gap(spark, d):
    p = user_points(spark, d).where("value > 60").select("series_id", F.col("t").alias("event_t"))
    return windows.neighbour_gap(p)


def t3_equal_width(spark, d):
    return transition.value_symbols(user_points(spark, d), 6).select("series_id", "t", F.col("symbol").cast("long").alias("symbol"))


def t3_equal_freq(spark, d):
    return transition.value_symbols(user_points(spark, d), 4, "equal_freq").select("series_id", "t", F.col("symbol").cast("long").alias("symbol"))


def t3_kmeans(spark, d):
    return transition.value_symbols(user_points(spark, d), 4, "kmeans")


def t4_ordinal_symbols(spark, d):
    s = transition.ordinal_symbols(user_points(spark, d), 3, 2)
    return s.select("series_id", "t", F.array_join(F.col("symbol").cast("array<string>"), "").alias("symbol"))


def t5_lehmer_codes(spark, d):
    return transition.lehmer_codes(user_points(spark, d), 3)


def t7_transitions(spark, d):
    net = transition.transition_network(user_points(spark, d), "ordinal", 3)
    flat = lambda c: F.array_join(F.flatten(c).cast("array<string>"), "").alias(c)
    return net.select("series_id", flat("src"), flat("dst"), "weight")


def t7_bin_transitions(spark, d):
    net = transition.transition_network(user_points(spark, d), "equal_width", bins=4, memory=2)
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), "").alias(c)
    return net.select("series_id", flat("src"), flat("dst"), "weight")


def t8_entropy_rate(spark, d):
    return rounded(transition.entropy_rate(transition.transition_network(user_points(spark, d), "ordinal", 3)))


def t9_pattern_distribution(spark, d):
    p = transition.pattern_distribution(transition.ordinal_symbols(user_points(spark, d), 3))
    return rounded(p.withColumn("symbol", F.array_join(F.col("symbol").cast("array<string>"), "")))


def t11_transition_stats(spark, d):
    return rounded(transition.transition_stats(transition.transition_network(user_points(spark, d), "ordinal", 3)))


def t13_permutation_entropy(spark, d):
    return rounded(transition.permutation_entropy(user_points(spark, d), 3, 2))


def t14_optimal_lag(spark, d):
    return transition.optimal_lag(user_points(spark, d), 10)


def t15_optimal_dimension(spark, d):
    return transition.optimal_dimension(user_points(spark, d), 1, 2, 4).select("series_id", "dimension")


def r1_embedding(spark, d):
    e = recurrence.embed(user_points(spark, d), 3, 2)
    return e.select("series_id", "t", *[F.col("vec")[i].alias(f"v{i}") for i in range(3)])


def r4_knn_edges(spark, d):
    return rounded(recurrence.undirected(recurrence.knn_arcs(user_points(spark, d), 3)))


def r4_knn_embedded(spark, d):
    return rounded(recurrence.knn_arcs(recurrence.embed(user_points(spark, d), 2, 1), 3), 6)


def r6_knn_manhattan(spark, d):
    return rounded(recurrence.knn_arcs(recurrence.embed(user_points(spark, d), 2, 1), 2, "manhattan", theiler=2), 6)


def r7_epsilon_edges(spark, d):
    return rounded(recurrence.epsilon_edges(user_points(spark, d), 1.5))


def r12_epsilon_chebyshev(spark, d):
    return rounded(recurrence.epsilon_edges(recurrence.embed(user_points(spark, d), 2, 1), 6.0, "chebyshev", theiler=1))


def r9_epsilon_positive(spark, d):
    return rounded(recurrence.epsilon_edges(user_points(spark, d), 0.5, positive=True))


def r11_fraction_edges(spark, d):
    return rounded(recurrence.fraction_edges(recurrence.embed(user_points(spark, d), 2, 1), 0.1, "manhattan", theiler=1), 6)


def r2_recurrence_stats(spark, d):
    p = user_points(spark, d)
    return rounded(graph.summary(graph.nodes_of(p), recurrence.undirected(recurrence.knn_arcs(p, 5))))


def q15_rqa(spark, d):
    p = user_points(spark, d)
    sizes = p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(recurrence.rqa(recurrence.matrix_cells(recurrence.epsilon_edges(p, 8.0), sizes), sizes))


def q17_false_neighbours(spark, d):
    return rounded(recurrence.false_neighbours(user_points(spark, d), 2))


def q18_cao(spark, d):
    return rounded(recurrence.cao(user_points(spark, d), 2))


BUCKETS = {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "median": "quantile_cont(value, 0.5)", "first": "arg_min(value, ts)", "last": "arg_max(value, ts)"}

QUERIES = {
    f.__name__: f
    for f in (
        s1_load_series, s3_timezone, s6_dedupe, s20_json_series, p1_series_warnings, p4_long_series, k5_top_series,
        w1_sliding_windows, w4_window_stats, w5_window_hvg, w5_window_nvg, w8_coarse_grain, w9_multiscale, w15_autocorrelation, w16_neighbour_gap,
        t3_equal_width, t3_equal_freq, t3_kmeans, t4_ordinal_symbols, t5_lehmer_codes, t7_transitions, t7_bin_transitions, t8_entropy_rate, t9_pattern_distribution,
        t11_transition_stats, t13_permutation_entropy, t14_optimal_lag, t15_optimal_dimension,
        r1_embedding, r2_recurrence_stats, r4_knn_edges, r4_knn_embedded, r6_knn_manhattan, r7_epsilon_edges, r9_epsilon_positive, r11_fraction_edges, r12_epsilon_chebyshev,
        q15_rqa, q17_false_neighbours, q18_cao,
    )
} | {f"s7_bucket_{k}": _bucket(k) for k in BUCKETS}
# The problem queries own the prefix p1_, p4_: the input checks are registered under their section's letter.
QUERIES["chk_series_warnings"] = QUERIES.pop("p1_series_warnings")
QUERIES["chk_long_series"] = QUERIES.pop("p4_long_series")

_W = "with " + POINTS


def _windows(width: int, by: int) -> str:
    return f"""n as (select series_id, count(*) as n from pts group by 1),
    win as (select p.series_id, w.w as window_id, p.t - w.w * {by} as pos, p.x from pts p join n using (series_id) join (select unnest(range(0, 100000)) as w) w
      on w.w * {by} <= p.t and p.t < w.w * {by} + {width} and w.w * {by} + {width} <= n.n)"""


def _window_graph(edges: str) -> str:
    return f"""with {POINTS.replace('pts as', 'raw as')}, {_windows(24, 12).replace('pts', 'raw')},
      pts as (select series_id * 1000 + window_id as series_id, pos as t, x from win), {edges},
      deg as (select p.series_id, p.t, count(k.v) as degree from pts p left join (select series_id, src as v from e union all select series_id, dst from e) k on k.series_id = p.series_id and k.v = p.t group by 1, 2)
      select series_id // 1000 as series_id, series_id % 1000 as window_id, count(*) as n_nodes, cast(sum(degree) / 2 as bigint) as n_edges, {r('avg(degree)')} as avg_degree, {r('stddev_pop(degree)')} as std_degree from deg group by series_id"""


def _lead(k: int, of: str = "x") -> str:
    return f"lead({of}, {k}) over (partition by series_id order by t)"


_ORD3 = f"""o as (select series_id, t, x as a, {_lead(1)} as b, {_lead(2)} as c from pts),
ord as (select series_id, t, case when a <= b and b <= c then '012' when a <= c and c < b then '021' when b < a and a <= c then '102' when b <= c and c < a then '120'
  when c < a and a <= b then '201' else '210' end as symbol from o where c is not null)"""
_NET3 = f"{_ORD3}, st as (select series_id, symbol as src, {_lead(1, 'symbol')} as dst from ord), net as (select series_id, src, dst, count(*) as weight from st where dst is not null group by 1, 2, 3)"
_EMB2 = f"emb as (select * from (select series_id, t, x as a, {_lead(1)} as b from pts) where b is not null)"


def _coarse(name: str, sql: str) -> str:
    return f"""select series_id, t // 5 as t, {r(sql)} as value, '{name}' as method from pts join n using (series_id) where n.n > 5 and t < (n.n // 5) * 5 group by series_id, t // 5"""


def _scale(s: int) -> str:
    return f"select series_id * 100 + {s} as series_id, t // {s} as t, avg(x) as x from raw join n using (series_id) where n.n > {s if s > 1 else 0} and t < (n.n // {s}) * {s} group by series_id, t // {s}"


ORACLES = {
    "s1_load_series": f"""select event_type as series_id, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as bucket, {r('avg(value)')} as value from events
      where ts >= '2024-01-05' and ts <= '2024-01-20' and value is not null and event_type is not null group by 1, 2""",
    "s3_timezone": f"""select event_type as series_id, strftime(date_trunc('day', ts - interval 330 minute), '%Y-%m-%d') as day, {r('sum(value)', 4)} as value from events where value is not null and event_type is not null group by 1, 2""",
    "s6_dedupe": "select o_orderpriority as series_id, strftime(o_orderdate, '%Y-%m-%d') as day, max(o_totalprice) as value from orders where o_orderpriority is not null group by o_orderpriority, o_orderdate",
    "chk_series_warnings": f"{_W} select series_id, count(*) as n_points, min(x) = max(x) as is_constant, count(*) < 3 as is_short, count(*) > 100000 as is_long, max(abs(x)) > 1e10 as is_extreme from pts group by 1",
    "chk_long_series": f"{_W} select series_id, t, x as value from pts where series_id in (select series_id from pts group by 1 having count(*) >= 65 and stddev_pop(x) > 0)",
    "k5_top_series": f"{_W} select series_id, count(*) as n_points from pts group by 1 having count(*) >= 20 order by 2 desc, 1 limit 10",
    "w1_sliding_windows": f"{_W}, {_windows(20, 7)} select series_id, window_id, pos, x as value from win",
    "w4_window_stats": f"""{_W}, {_windows(20, 10)}, m as (select *, avg(x) over (partition by series_id, window_id) as mu from win)
      select series_id, window_id, {r('avg(x)')} as mean, {r('stddev_pop(x)')} as std, min(x) as min, max(x) as max, {r('quantile_cont(x, 0.5)')} as median,
      {r('avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5)')} as skew, {r('avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3')} as kurtosis, {r('regr_slope(x, pos)')} as trend from m group by 1, 2""",
    "w5_window_hvg": _window_graph(HVG),
    "w5_window_nvg": _window_graph(nvg(24)),
    "w8_coarse_grain": f"{_W}, n as (select series_id, count(*) as n from pts group by 1) " + " union all ".join(_coarse(k, v) for k, v in (("mean", "avg(x)"), ("median", "quantile_cont(x, 0.5)"), ("max", "max(x)"), ("min", "min(x)"), ("std", "stddev_samp(x)"))),
    "w9_multiscale": f"""with {POINTS.replace('pts as', 'raw as')}, n as (select series_id, count(*) as n from raw group by 1), al as ({' union all '.join(_scale(s) for s in (1, 2, 4, 8))}),
      pts as (select * from al where series_id in (select series_id from al group by 1 having count(*) >= 10)), {HVG},
      deg as (select p.series_id, p.t, count(k.v) as degree from pts p left join (select series_id, src as v from e union all select series_id, dst from e) k on k.series_id = p.series_id and k.v = p.t group by 1, 2),
      st as (select series_id, count(*) as n_nodes, cast(sum(degree) / 2 as bigint) as n_edges, {r('avg(degree)')} as avg_degree, {r('stddev_pop(degree)')} as std_degree, {r('(sum(degree) / 2.0) / (cast(count(*) as double) * (count(*) - 1) / 2.0)')} as density from deg group by 1)
      select n.series_id, cast(s.s as bigint) as scale, st.n_nodes, st.n_edges, st.avg_degree, st.std_degree, st.density from n cross join (values (1), (2), (4), (8)) s(s) left join st on st.series_id = n.series_id * 100 + s.s""",
    "w15_autocorrelation": f"{_W}, l as (select series_id, x, lag(x) over (partition by series_id order by t) as b from pts) select series_id, {r('coalesce(corr(b, x), 0)')} as autocorrelation from l where b is not null group by 1",
    "w16_neighbour_gap": f"""{_W}, ev as (select series_id, t from pts where x > 60) select series_id, t as event_t,
      cast(coalesce(least(t - lag(t) over (partition by series_id order by t), lead(t) over (partition by series_id order by t) - t), 1) as double) as gap from ev""",
    "t3_equal_width": f"""{_W}, l as (select series_id, min(x) as lo, max(x) as hi from pts group by 1)
      select p.series_id, p.t, cast({' + '.join(f'(case when l.lo + {k} * (l.hi - l.lo) / 6 <= p.x then 1 else 0 end)' for k in range(1, 6))} as bigint) as symbol from pts p join l using (series_id)""",
    "t3_equal_freq": f"""{_W}, l as (select series_id, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c from pts group by 1)
      select p.series_id, p.t, cast((case when a <= x then 1 else 0 end) + (case when b <= x then 1 else 0 end) + (case when c <= x then 1 else 0 end) as bigint) as symbol from pts p join l using (series_id)""",
    "t4_ordinal_symbols": f"{_W}, {_ORD3.replace(_lead(1), 'LEAD2').replace(_lead(2), 'LEAD4').replace('LEAD2', _lead(2)).replace('LEAD4', _lead(4))} select series_id, t, symbol from ord",
    "t5_lehmer_codes": f"{_W}, {_ORD3} select series_id, t, cast(case symbol when '012' then 0 when '021' then 1 when '102' then 2 when '120' then 3 when '201' then 4 else 5 end as bigint) as code from ord",
    "t7_transitions": f"{_W}, {_NET3} select * from net",
    "t7_bin_transitions": f"""{_W}, l as (select series_id, min(x) as lo, max(x) as hi from pts group by 1),
      s as (select p.series_id, p.t, cast({' + '.join(f'(case when l.lo + {k} * (l.hi - l.lo) / 4 <= p.x then 1 else 0 end)' for k in range(1, 4))} as varchar) as s from pts p join l using (series_id)),
      q as (select series_id, s as a, {_lead(1, 's')} as b, {_lead(2, 's')} as c from s) select series_id, a || b as src, b || c as dst, count(*) as weight from q where c is not null group by 1, 2, 3""",
    "t8_entropy_rate": f"""{_W}, {_NET3}, p as (select *, weight / cast(sum(weight) over (partition by series_id, src) as double) as p from net), h as (select series_id, src, -sum(p * log2(p)) as h from p group by 1, 2),
      i as (select series_id, dst, sum(weight) as w from net group by 1, 2), s as (select *, w / cast(sum(w) over (partition by series_id) as double) as pi from i)
      select s.series_id, {r('sum(pi * coalesce(h, 0))')} as entropy_rate from s left join h on h.series_id = s.series_id and h.src = s.dst group by 1""",
    "t9_pattern_distribution": f"{_W}, {_ORD3}, c as (select series_id, symbol, count(*) as n from ord group by 1, 2) select series_id, symbol, n, {r('n / cast(sum(n) over (partition by series_id) as double)')} as share from c",
    "t11_transition_stats": f"""{_W}, {_NET3}, k as (select series_id, src as node, 1 as o from net union all select series_id, dst, 0 from net), g as (select series_id, node, sum(o) as o from k group by 1, 2)
      select series_id, count(*) as n_nodes, cast(sum(o) as bigint) as n_edges, {r('case when count(*) > 1 then cast(sum(o) as double) / (count(*) * (count(*) - 1)) else 0.0 end')} as density, {r('avg(o)')} as avg_out_degree, {r('stddev_pop(o)')} as std_out_degree from g group by 1""",
    "t13_permutation_entropy": f"""with {POINTS.replace('pts as', 'raw as')}, pts as (select series_id, t // 2 as t, x from raw where t % 2 = 0), {_ORD3},
      c as (select series_id, symbol, count(*) as n from ord group by 1, 2), p as (select series_id, n / cast(sum(n) over (partition by series_id) as double) as p from c)
      select series_id, {r('-sum(p * ln(p)) / ln(6)')} as permutation_entropy from p group by 1""",
    "t14_optimal_lag": f"""{_W}, c as (select series_id, t, x - avg(x) over (partition by series_id) as x, count(*) over (partition by series_id) as n from pts), v as (select series_id, sum(x * x) as v from c group by 1),
      a as (select a.series_id, b.t - a.t as lag, round(sum(a.x * b.x) / any_value(v.v), 10) as r from c a join c b on a.series_id = b.series_id and b.t between a.t + 1 and a.t + greatest(1, least(10, a.n // 4)) join v on v.series_id = a.series_id group by 1, 2)
      select series_id, cast(coalesce(min(case when r <= 0 then lag end), arg_min(lag, (r, lag))) as bigint) as lag from a group by 1""",
    "r1_embedding": f"{_W} select * from (select series_id, t, x as v0, {_lead(2)} as v1, {_lead(4)} as v2 from pts) where v2 is not null",
    "r2_recurrence_stats": f"""{_W}, k as (select a.series_id, a.t as a, b.t as b from pts a join pts b on a.series_id = b.series_id and a.t <> b.t qualify row_number() over (partition by a.series_id, a.t order by abs(a.x - b.x), b.t) <= 5),
      e as (select distinct series_id, least(a, b) as src, greatest(a, b) as dst from k), deg as (select p.series_id, p.t as node, count(k.v) as degree, count(case when k.w = 0 then 1 end) as out_degree
      from pts p left join (select series_id, src as v, 0 as w from e union all select series_id, dst, 1 from e) k on k.series_id = p.series_id and k.v = p.t group by 1, 2)
      select series_id, count(*) as n_nodes, cast(sum(out_degree) as bigint) as n_edges, {r('avg(degree)')} as avg_degree, {r('stddev_pop(degree)')} as std_degree, min(degree) as min_degree, max(degree) as max_degree,
      {r('cast(sum(out_degree) as double) / (cast(count(*) as double) * (count(*) - 1) / 2.0)')} as density from deg group by series_id""",
    "r4_knn_edges": f"""{_W}, k as (select a.series_id, a.t as a, b.t as b, abs(a.x - b.x) as w from pts a join pts b on a.series_id = b.series_id and a.t <> b.t qualify row_number() over (partition by a.series_id, a.t order by abs(a.x - b.x), b.t) <= 3)
      select series_id, least(a, b) as src, greatest(a, b) as dst, {r('min(w)')} as dist from k group by 1, 2, 3""",
    "r4_knn_embedded": f"""{_W}, {_EMB2} select p.series_id, p.t as src, q.t as dst, {r('sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))', 6)} as dist from emb p join emb q on p.series_id = q.series_id and p.t <> q.t
      qualify row_number() over (partition by p.series_id, p.t order by sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), q.t) <= 3""",
    "r6_knn_manhattan": f"""{_W}, {_EMB2} select p.series_id, p.t as src, q.t as dst, {r('abs(p.a - q.a) + abs(p.b - q.b)', 6)} as dist from emb p join emb q on p.series_id = q.series_id and abs(p.t - q.t) > 2
      qualify row_number() over (partition by p.series_id, p.t order by abs(p.a - q.a) + abs(p.b - q.b), q.t) <= 2""",
    "r7_epsilon_edges": f"{_W} select a.series_id, a.t as src, b.t as dst, {r('abs(a.x - b.x)')} as dist from pts a join pts b on a.series_id = b.series_id and a.t < b.t and abs(a.x - b.x) <= 1.5",
    "r9_epsilon_positive": f"{_W} select a.series_id, a.t as src, b.t as dst, {r('abs(a.x - b.x)')} as dist from pts a join pts b on a.series_id = b.series_id and a.t < b.t and abs(a.x - b.x) <= 0.5 and a.x <> b.x",
    "r12_epsilon_chebyshev": f"{_W}, {_EMB2} select p.series_id, p.t as src, q.t as dst, {r('greatest(abs(p.a - q.a), abs(p.b - q.b))')} as dist from emb p join emb q on p.series_id = q.series_id and q.t > p.t + 1 and greatest(abs(p.a - q.a), abs(p.b - q.b)) <= 6.0",
    "r11_fraction_edges": f"""{_W}, {_EMB2}, pr as (select p.series_id, p.t as src, q.t as dst, abs(p.a - q.a) + abs(p.b - q.b) as dist from emb p join emb q on p.series_id = q.series_id and q.t > p.t),
      f as (select series_id, max(dist) * 0.1 as eps from pr group by 1) select pr.series_id, src, dst, {r('dist', 6)} as dist, {r('1.0 / (1.0 + dist)', 6)} as weight from pr join f using (series_id) where dist <= eps and dst - src > 1""",
    "q15_rqa": f"""{_W}, n as (select series_id, count(*) as n from pts group by 1), c as (select a.series_id, a.t as i, b.t as j from pts a join pts b on a.series_id = b.series_id and abs(a.x - b.x) <= 8.0),
      dg as (select series_id, j - i as line, i - row_number() over (partition by series_id, j - i order by i) as g from c), dl as (select series_id, line, g, count(*) as len from dg group by 1, 2, 3 having count(*) >= 2),
      vt as (select series_id, j as line, i - row_number() over (partition by series_id, j order by i) as g from c), vl as (select series_id, line, g, count(*) as len from vt group by 1, 2, 3 having count(*) >= 2),
      h as (select series_id, len, count(*) as k from dl group by 1, 2), hp as (select series_id, k / cast(sum(k) over (partition by series_id) as double) as p from h), en as (select series_id, -sum(p * ln(p)) as entr from hp group by 1),
      ds as (select series_id, sum(len) as s, avg(len) as a, max(len) as m from dl group by 1), vs as (select series_id, sum(len) as s, avg(len) as a from vl group by 1), k as (select series_id, count(*) as k from c group by 1)
      select n.series_id, {r('k.k / cast(n.n * n.n as double)')} as rr, {r('ds.s / cast(k.k as double)')} as det, {r('ds.a')} as l_mean, cast(ds.m as bigint) as l_max, {r('en.entr')} as entr, {r('coalesce(vs.s, 0) / cast(k.k as double)')} as lam, {r('coalesce(vs.a, 0)')} as tt
      from n join k using (series_id) join ds using (series_id) join en using (series_id) left join vs using (series_id)""",
} | {
    f"s7_bucket_{k}": f"""select cast(user_id as varchar) as series_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, {r(sql, 6)} as value from events
      where user_id is not null and ts is not null and value is not null and not isnan(value) group by 1, 2"""
    for k, sql in BUCKETS.items()
}
