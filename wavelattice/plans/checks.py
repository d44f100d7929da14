"""SQL of queries that take several steps: long horizontal visibility, summaries, motifs, embeddings, JSON series, windows."""

from __future__ import annotations

from itertools import permutations

from wavelattice.plans.common import DEGREES, HVG, POINTS, SUMMARY, nvg, r
from wavelattice.plans.dynamics import ORACLES as DYNAMICS
from wavelattice.plans.visibility import _TRI
from wavelattice.plans.visibility import ORACLES as VISIBILITY

_NEAR = 64
_LINE = "pts as (select 'lineitem' as series_id, cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as t, l_extendedprice as x from lineitem where l_extendedprice is not null)"
# Most points see a greater one close by; the few that don't are held against all.
_LONG_HVG = f"""nsg1 as (select a.t as src, min(b.t) as dst from pts a join pts b on b.t between a.t + 1 and a.t + {_NEAR} and b.x > a.x group by 1),
nsg2 as (select a.t as src, min(b.t) as dst from (select * from pts where t not in (select src from nsg1)) a join pts b on b.t > a.t + {_NEAR} and b.x > a.x group by 1),
pge1 as (select max(a.t) as src, b.t as dst from pts b join pts a on a.t between b.t - {_NEAR} and b.t - 1 and a.x >= b.x group by b.t),
pge2 as (select max(a.t) as src, b.t as dst from (select * from pts where t not in (select dst from pge1)) b join pts a on a.t < b.t - {_NEAR} and a.x >= b.x group by b.t),
e as (select 'lineitem' as series_id, src, dst from (select * from nsg1 union all select * from nsg2 union all select * from pge1 union all select * from pge2))"""

_PATHS = f"""with recursive {POINTS}, {nvg()}, w as (select series_id, src as u, dst as v from e union all select series_id, dst, src from e),
  walk(series_id, a, node, k) as (select series_id, t, t, 0 from pts union select q.series_id, q.a, w.v, q.k + 1 from walk q join w on w.series_id = q.series_id and w.u = q.node where q.k < 14),
  far as (select series_id, a, node, min(k) as k from walk group by 1, 2, 3) select series_id, avg(k) as l from far where a <> node group by 1"""
_SMALL = f"""select g.series_id, g.c, p.l, g.density as c_random, case when g.k > 1 then ln(g.n) / ln(g.k) end as l_random, (g.c / g.density) / (p.l / case when g.k > 1 then ln(g.n) / ln(g.k) end) as sigma
  from (with {POINTS}, {nvg()}, {DEGREES}, {_TRI} select series_id, avg(clustering) as c, count(*) as n, avg(degree) as k, (sum(degree) / 2.0) / (count(*) * (count(*) - 1) / 2.0) as density from nt group by 1) g
  join ({_PATHS}) p using (series_id)"""


_SLOTS = [(x, y) for x in range(3) for y in range(3) if x != y]


def _triple_code(bits: int) -> int:
    """Least adjacency code over the orders of a triple with the links ``bits`` (one bit a slot)."""
    link = {s: bits >> i & 1 for i, s in enumerate(_SLOTS)}
    return min(sum(link[p[x], p[y]] << i for i, (x, y) in enumerate(_SLOTS)) for p in permutations(range(3)))


_CODES = " ".join(f"when {k} then {_triple_code(k)}" for k in range(64))


def _motifs3() -> str:
    """Classes of the connected directed triples of ``e``."""
    names = "abc"
    joins = " ".join(f"left join s s{i} on s{i}.series_id = t.series_id and s{i}.src = t.{names[x]} and s{i}.dst = t.{names[y]}" for i, (x, y) in enumerate(_SLOTS))
    bits = " + ".join(f"(case when s{i}.src is null then 0 else {1 << i} end)" for i in range(6))
    return f"""{_BOTH}, {_TRIPLES}, f as (select t.series_id, {bits} as bits from tr t {joins})
      select series_id, code, count(*) as n from (select series_id, cast(case bits {_CODES} end as integer) as code from f) group by 1, 2"""


_BOTH = "s as (select distinct series_id, src, dst from e where src <> dst), n2 as (select series_id, src as u, dst as v from s union select series_id, dst, src from s)"
_TRIPLES = """tr as (select distinct p.series_id, least(p.u, p.v, q.v) as a, p.u + p.v + q.v - least(p.u, p.v, q.v) - greatest(p.u, p.v, q.v) as b, greatest(p.u, p.v, q.v) as c
  from n2 p join n2 q on q.series_id = p.series_id and q.u = p.u and p.v < q.v)"""


def _patterns(m: int) -> str:
    """Degree variance of the ordinal partition network of patterns of ``m`` values."""
    x = ", ".join(f"lead(x, {k}) over w as x{k}" for k in range(m))
    ranks = " || ".join("cast(" + " + ".join(f"(case when x{j} < x{i} or (x{j} = x{i} and {j} < {i}) then 1 else 0 end)" for j in range(m) if j != i) + " as varchar)" for i in range(m))
    return f"""select series_id, {m} as m, round(var_pop(d), 9) as v from (select series_id, node, count(*) as d from (
      select series_id, unnest([a, b]) as node from (select distinct series_id, a, b from (select series_id, s as a, lead(s) over (partition by series_id order by t) as b from (
        select series_id, t, {ranks} as s from (select series_id, t, {x} from pts window w as (partition by series_id order by t)) where x{m - 1} is not null)) where b is not null)) group by 1, 2) group by 1"""


def _nearest(distance: str) -> str:
    return f"""with {POINTS}, em as (select series_id, t, x as a, lead(x, 1) over w as b, lead(x, 2) over w as c from pts window w as (partition by series_id order by t)),
      v as (select * from em where c is not null), sd as (select series_id, stddev_pop(x) as sd from pts group by 1),
      nn as (select p.series_id, p.a as pa, p.b as pb, p.c as pc, q.a as qa, q.b as qb, q.c as qc, {distance} as dist from v p join v q on q.series_id = p.series_id and q.t <> p.t
        qualify row_number() over (partition by p.series_id, p.t order by {distance}, q.t) = 1)"""


_GAP = "abs(pc - qc)"
QUERIES: dict = {}
ORACLES = {
    "v3_hvg_long_stats": f"with {_LINE}, {_LONG_HVG}, {DEGREES} {SUMMARY}",
    "a8_small_world": f"select series_id, {r('c')} as c, {r('l')} as l, {r('c_random')} as c_random, {r('l_random')} as l_random, {r('sigma')} as sigma from ({_SMALL})",
    "a7_graph_summary": f"""select d.*, a.assortativity, g.avg_clustering, g.triangles, g.wedges, {r('w.l')} as l, {r('w.sigma')} as sigma from (
      with {POINTS}, {nvg()}, {DEGREES} select series_id, count(*) as n, cast(sum(degree) / 2 as bigint) as m, {r('avg(degree)')} as deg_mean, {r('stddev_samp(degree)')} as deg_std,
        {r('case when count(*) > 1 then (sum(degree) / 2) / (count(*) * (count(*) - 1) / 2) else 0.0 end')} as density from deg group by 1) d
      left join ({VISIBILITY['a12_assortativity']}) a using (series_id) join ({VISIBILITY['g1_clustering']}) g using (series_id) join ({_SMALL}) w using (series_id)""",
    "g14_motifs3": f"with {POINTS}, {HVG}, {_motifs3()}",
    "t10_pattern_motifs": f"with e as (select series_id, cast(src as bigint) as src, cast(dst as bigint) as dst from ({DYNAMICS['t7_transitions']})), {_motifs3()}",
    "z5_window_features": f"""select series_id, window_id, case when stddev_pop(k) over w > 1e-12 then {r('(k - avg(k) over w) / stddev_pop(k) over w', 6)} else 0.0 end as z_avg_degree
      from (select series_id, window_id, 2.0 * n_edges / n_nodes as k from ({DYNAMICS['w5_window_hvg']})) window w as (partition by series_id)""",
    "g15_motifs4": f"""with {POINTS}, {HVG}, {_BOTH}, {_TRIPLES}, gr as (select t.series_id, list_sort([t.a, t.b, t.c, n.v]) as q from (select *, unnest([a, b, c]) as u from tr) t join n2 n on n.series_id = t.series_id and n.u = t.u and n.v not in (t.a, t.b, t.c)),
      fo as (select distinct series_id, q from gr), pr as (select f.series_id, f.q, s.src, s.dst from fo f join s on s.series_id = f.series_id and s.src in (f.q[1], f.q[2], f.q[3]) and s.dst in (f.q[2], f.q[3], f.q[4])),
      dg as (select series_id, q, x, count(*) as k from (select series_id, q, unnest([src, dst]) as x from pr) group by 1, 2, 3), kd as (select series_id, q, sum(k) / 2 as m, max(k) as top from dg group by 1, 2)
      select series_id, case when m = 6 then 'K4' when m = 5 then 'diamond' when m = 4 and top = 2 then 'C4' when m = 4 then 'paw' when top = 3 then 'K13' else 'P4' end as motif, count(*) as n from kd group by 1, 2""",
    "t15_optimal_dimension": f"""with {POINTS}, v as ({' union all '.join(_patterns(m) for m in (2, 3, 4))})
      select series_id, cast(m as bigint) as dimension from v qualify row_number() over (partition by series_id order by v desc, m) = 1""",
    "q17_false_neighbours": f"""{_nearest('sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b))')}
      select series_id, 2 as m, {r(f'avg(case when dist = 0 or {_GAP} / dist > 10 or sqrt(dist * dist + {_GAP} * {_GAP}) / sd > 2 then 1.0 else 0.0 end)')} as share from nn join sd using (series_id) group by 1""",
    "q18_cao": f"""{_nearest('greatest(abs(p.a - q.a), abs(p.b - q.b))')}
      select series_id, 2 as m, {r(f'avg(case when dist > 0 then greatest(dist, {_GAP}) / dist end)')} as e, {r(f'avg({_GAP})')} as e_star from nn group by 1""",
    "s20_json_series": f"""with j as (select cast(record as json) as j from elec where record is not null and json_valid(record)),
      f as (select json_extract_string(j, '$.series_id') as series_id, json_extract(j, '$.data') as d from j where json_type(j) = 'OBJECT'),
      c as (select series_id, try_cast(json_extract_string(unnest(json_extract(d, '$[*]')), '$[1]') as double) as x from f where series_id is not null and json_type(d) = 'ARRAY')
      select series_id, count(*) as n_points, {r('avg(x)', 6)} as mean from c where x is not null and not isnan(x) and abs(x) < 'infinity'::double group by 1 having count(*) >= 4 and stddev_pop(x) > 0""",
    "w6_windowed_pipeline": f"""select series_id || '_w' || window_id as series_id, n_nodes as n_points, n_edges, {r('n_edges / (n_nodes * (n_nodes - 1) / 2.0)')} as density from ({DYNAMICS['w5_window_nvg']})""",
}
