"""Queries of decomposition, embeddings, dynamics, streams, sinks, pipeline and user hooks (M, ST, S14-S19, C, UF, B)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.config import Graphs, Pipeline
from wavelattice.functions.udf import register, series_metrics
from wavelattice.operators import decompose as dec
from wavelattice.operators import distances as dist
from wavelattice.operators.visibility import hvg_edges
from wavelattice.operators.windows import sliding_windows
from wavelattice.plans.common import DEGREES, HVG, PANEL, POINTS, SUMMARY, r, rounded, type_days, user_points
from wavelattice.plans.pipeline import GraphBuilder, run_points
from wavelattice.session import ensure_checkpoint_dir, read_table
from wavelattice.sources.readers import read_distance_shards, read_graph
from wavelattice.sources.sinks import write_distance_shards, write_graph
from wavelattice.streaming.graphs import stream_hvg, stream_transitions
from wavelattice.streaming.windows import run_to_parquet, sessions, tumbling


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def m1_decompose(spark, d):
    return dec.decompose(user_points(spark, d), period=7)


def m2_residual_features(spark, d):
    return dec.residual_features(user_points(spark, d), 20)


def m3_structural_stats(spark, d):
    return dec.structural_stats(dec.decompose(user_points(spark, d), period=7))


def m4_embeddings(spark, d):
    return dec.convolution_embeddings(sliding_windows(user_points(spark, d), 20, 10), (8, 16), 3, (1, 2))


_RING = [[0.0, 0.5, 0.0, 0.0], [0.0, 0.0, 0.5, 0.0], [0.0, 0.0, 0.0, 0.5], [0.5, 0.0, 0.0, 0.0]]


def m5_kuramoto(spark, d):
    return dec.simulate(spark, _RING, "kuramoto", 100, runs=4)


def m6_infer_network(spark, d):
    return rounded(dec.infer_network(dec.simulate(spark, _RING, "linear", 200, runs=4)), 4)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of its files, be the table one file or a folder of parts."""
    schema = read_table(spark, d, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.isDirectory():
        return spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = _folder(spark, name)
    run_to_parquet(stream, out, _folder(spark, f"{name}-state"))
    return spark.read.parquet(out)


def st5_stream_hvg(spark, d):
    return _drained(spark, stream_hvg(_stream(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value"), "st5")


def st6_stream_transitions(spark, d):
    out = _drained(spark, stream_transitions(_stream(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value"), "st6")
    return out.groupBy("series_id", "src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def st2_tumbling(spark, d):
    """The window operator on the table as a batch, where no row is late."""
    w = tumbling(read_table(spark, d, "events"), "ts", "value", "event_type")
    return rounded(w.withColumn("start", F.date_format("start", "yyyy-MM-dd")), 6)


def st4_sessions(spark, d):
    s = sessions(read_table(spark, d, "events"), "ts", "user_id", "6 hours")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def s14_graph_roundtrip(spark, d):
    p = user_points(spark, d)
    folder = _folder(spark, "graph")
    write_graph(p.select("series_id", F.col("t").alias("id")), hvg_edges(p), folder)
    return read_graph(spark, folder)[1].select("series_id", "src", "dst")


def s19_shard_merge(spark, d):
    """Distances written as shards and merged to both triangles."""
    d1 = dist.pair_distances(type_days(spark, d))
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("cart", "click", "purchase", "search", "signup", "view")) for x in (k, i)]), F.col("i"))
    other = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("cart", "click", "purchase", "search", "signup", "view")) for x in (k, i)]), F.col("j"))
    folder = _folder(spark, "shards")
    write_distance_shards(d1.select(F.coalesce(number, F.lit(9)).alias("i"), F.coalesce(other, F.lit(9)).alias("j"), "dist"), folder, 2)
    return rounded(read_distance_shards(spark, folder).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total")), 6)


def c5_pipeline(spark, d):
    """The configured pipeline on users' series: a struct per method, flattened."""
    config = Pipeline.from_dict({"dataset": {"name": "events", "path": "events"}, "output": {"path": "out"}, "graphs": {"hvg": {"enabled": True}, "transition": {"enabled": True, "order": 3}}})
    out = run_points(user_points(spark, d), config)
    return rounded(out.select("series_id", "n_points", "hvg.n_edges", "hvg.avg_degree", F.col("transition.n_nodes").alias("patterns"), F.col("transition.n_edges").alias("steps")))


def w6_windowed_pipeline(spark, d):
    config = Pipeline.from_dict({"dataset": {"name": "events", "path": "events"}, "output": {"path": "out"}, "graphs": {"nvg": {"enabled": True, "limit": 24}}, "windows": {"enabled": True, "size": 24, "step": 12}})
    return rounded(run_points(user_points(spark, d), config).select("series_id", "n_points", "nvg.n_edges", "nvg.density"))


def b1_builder_stats(spark, d):
    return rounded(GraphBuilder("HVG", "stats", Graphs()).fit_transform(user_points(spark, d)))


def uf6_udtf_edges(spark, d):
    register(spark)
    user_points(spark, d).createOrReplaceTempView("uf6_points")
    packed = "select series_id, transform(array_sort(collect_list(struct(t, value))), p -> p.value) as x from uf6_points group by series_id"
    return spark.sql(f"select s.series_id, e.src, e.dst from ({packed}) s, lateral hvg_edges(s.x) e")


def uf1_series_metrics(spark, d):
    """Own functions of a whole series: range and mean absolute step."""
    import numpy as np

    return rounded(series_metrics(user_points(spark, d), {"range": lambda x: x.max() - x.min(), "step": lambda x: np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0}))


QUERIES = {
    f.__name__: f
    for f in (
        m1_decompose, m2_residual_features, m3_structural_stats, m4_embeddings, m5_kuramoto, m6_infer_network, st2_tumbling, st4_sessions, st5_stream_hvg, st6_stream_transitions,
        s14_graph_roundtrip, s19_shard_merge, c5_pipeline, w6_windowed_pipeline, b1_builder_stats, uf1_series_metrics, uf6_udtf_edges,
    )
}

_ORDER3 = """o as (select series_id, t, x as a, lead(x, 1) over w as b, lead(x, 2) over w as c from pts window w as (partition by series_id order by t)),
ord as (select series_id, t, case when a <= b and b <= c then '012' when a <= c and c < b then '021' when b < a and a <= c then '102' when b <= c and c < a then '120'
  when c < a and a <= b then '201' else '210' end as symbol from o where c is not null), st as (select series_id, symbol as src, lead(symbol) over (partition by series_id order by t) as dst from ord),
net as (select series_id, src, dst, count(*) as weight from st where dst is not null group by 1, 2, 3)"""

ORACLES = {
    "st2_tumbling": f"select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as start, count(*) as n, {r('avg(value)', 6)} as mean, {r('sum(value)', 6)} as total from events group by 1, 2",
    "st4_sessions": """with l as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as c from events window w as (partition by user_id order by ts)),
      g as (select *, sum(c) over (partition by user_id order by ts rows unbounded preceding) as g from l) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from g group by user_id, g""",
    "st5_stream_hvg": f"with {POINTS}, {HVG} select * from e",
    "st6_stream_transitions": f"with {POINTS}, {_ORDER3} select * from net",
    "s14_graph_roundtrip": f"with {POINTS}, {HVG} select * from e",
    "c5_pipeline": f"""with {POINTS}, {HVG}, {_ORDER3}, k as (select series_id, src as node, 1 as o from net union all select series_id, dst, 0 from net), g as (select series_id, count(distinct node) as patterns, cast(sum(o) as bigint) as steps from k group by 1),
      n as (select series_id, count(*) as n_points from pts group by 1), m as (select series_id, count(*) as m from e group by 1)
      select n.series_id, n_points, m.m as n_edges, {r('2.0 * m.m / n_points')} as avg_degree, patterns, steps from n join m using (series_id) join g using (series_id)""",
    "b1_builder_stats": f"with {POINTS}, {HVG}, {DEGREES} {SUMMARY}",
    "uf1_series_metrics": f"with {POINTS}, s as (select *, abs(x - lag(x) over (partition by series_id order by t)) as g from pts) select series_id, {r('max(x) - min(x)')} as range, {r('coalesce(avg(g), 0)')} as step from s group by 1",
    "uf6_udtf_edges": f"with {POINTS}, {HVG} select * from e",
}
