import json

import pytest
from pyspark.sql import functions as F

from wavelattice import cli
from wavelattice.config import Pipeline
from wavelattice.functions.udf import register, series_metrics
from wavelattice.operators.visibility import hvg_edges
from wavelattice.plans.pipeline import GraphBuilder, build_edges, errors_of, run
from wavelattice.sources import readers, sinks
from wavelattice.streaming.graphs import stream_hvg, stream_transitions
from wavelattice.streaming.windows import run_to_parquet, to_batches

BASE = {"dataset": {"name": "x", "path": "x"}, "graphs": {}, "output": {"path": "y"}}


def test_config_checks(tmp_path):
    c = Pipeline.from_dict(BASE | {"graphs": {"hvg": {"enabled": True, "limit": None}, "nvg": None}})
    assert c.graphs.hvg.enabled and Pipeline.from_dict(c.to_dict()) == c
    for bad in ({"graphs": {"hvg": {"force_dense": 1}}}, {"graphs": {"recurrence": {"rule": "magic"}}}, {"sampling": {"agg": "mode"}}, {"output": {"path": "y", "format": "xml"}}, {"windows": {"size": 1}}):
        with pytest.raises(ValueError):
            Pipeline.from_dict(BASE | bad)
    with pytest.raises(ValueError):
        Pipeline.from_dict({"dataset": {"name": "x", "path": "x"}})
    (tmp_path / "c.yaml").write_text("dataset: {name: a, path: b, tz: null}\ngraphs: {nvg: {enabled: true}}\noutput: {path: o}\n")
    assert Pipeline.from_yaml(str(tmp_path / "c.yaml")).graphs.nvg.enabled


def test_run(spark, tmp_path):
    rows = [(f"m{k}", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float((i * 7 + k) % 11)) for k in range(3) for i in range(60)] + [("tiny", "2024-01-01 00:00:00", 1.0)]
    spark.createDataFrame(rows, "id string, at string, v double").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    c = Pipeline.from_dict({
        "dataset": {"name": "m", "path": str(tmp_path / "in"), "id_col": "id", "time_col": "at", "value_col": "v"},
        "graphs": {"hvg": {"enabled": True, "directed": True}, "nvg": {"enabled": True, "limit": 10}, "recurrence": {"enabled": True, "k": 2}, "transition": {"enabled": True}},
        "output": {"path": str(tmp_path / "out")},
    })
    out = {r.series_id: r for r in run(spark, c).collect()}
    assert set(out) == {"m0", "m1", "m2", "tiny"} and out["m0"].n_points == 60 and out["m0"].hvg.irreversibility >= 0
    assert out["tiny"].hvg.n_edges == 0 and out["tiny"].transition is None
    assert [r.series_id for r in spark.read.json(str(tmp_path / "out_errors")).collect()] == ["tiny"]
    assert errors_of(spark.read.parquet(str(tmp_path / "out"))).count() == 1


def test_builder(points):
    p = points({"a": [1, 3, 2, 4]})
    b = GraphBuilder("NVG")
    assert b.fit_transform(p).count() == b.set_params(output="degrees").transform(p).agg(F.sum("degree") / 2).first()[0]
    with pytest.raises(ValueError):
        b.set_params(output="picture")
    with pytest.raises(ValueError):
        build_edges(p, "magic", b.config)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,0,1,2\nx,1,2,3\ny,4,,6\n")
    assert {(r.series_id, r.t): r.value for r in readers.read_panel_csv(spark, str(tmp_path / "p.csv")).collect()} == {("x", 0): 1, ("x", 1): 2, ("x", 2): 3, ("y", 0): 4, ("y", 2): 6}
    (tmp_path / "e.csv").write_text("0,1,1.0\n1,2,0.5\n2,0,\n")
    assert {r.weight for r in readers.read_edges_csv(spark, str(tmp_path / "e.csv")).collect()} == {1.0, 0.5}
    (tmp_path / "c.txt").write_text("0 0\n 1  0\n\n0 5\n")
    assert cli.main(["spatial-weights", "radius", str(tmp_path / "c.txt"), str(tmp_path / "w"), "--radius", "1.5"]) == 0
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    assert cli.main(["to-parquet", str(tmp_path / "e.csv"), str(tmp_path / "g"), "--directed"]) == 0
    assert cli.main(["from-parquet", str(tmp_path / "g"), "--graphml", str(tmp_path / "ml")]) == 0
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "ml")).collect())
    assert text.count("<edge ") == 3 and text.count("<node ") == 3
    d = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25)], "i long, j long, dist double")
    sinks.write_distance_shards(d, str(tmp_path / "s"), 2)
    assert readers.read_distance_shards(spark, str(tmp_path / "s")).count() == 4
    nested = spark.createDataFrame([(1, (2, 3))], "a int, b struct<c:int,d:int>")
    for fmt in ("parquet", "json", "csv"):
        sinks.write_results(nested, str(tmp_path / fmt), fmt)
    with pytest.raises(ValueError):
        sinks.write_results(nested, "x", "xml")
    j = spark.createDataFrame([(json.dumps({"series_id": "q", "data": [["1", 1], ["2", "x"], ["3", 4.5], None, 7]}),), ("{",), (None,)], "record string")
    assert [(r.t, r.value) for r in readers.json_series(j, "record", 2).orderBy("t").collect()] == [(0, 1.0), (1, 4.5)]


def test_pandas_adapters(spark):
    import pandas as pd
    import pyarrow as pa

    pdf = pd.DataFrame({"g": ["b", "a", "a"], "at": [1, 2, 1], "v": [1.0, float("nan"), 3.0]})
    want = {("a", 0, 3.0), ("b", 0, 1.0)}
    assert set(map(tuple, readers.from_pandas(spark, pdf, "v", "g", "at").collect())) == want
    assert set(map(tuple, readers.from_arrow(spark, pa.Table.from_pandas(pdf), "v", "g", "at").collect())) == want


def test_streams_equal_batches(spark, points, tmp_path):
    x = [3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]
    for part in range(3):  # three micro-batches in order
        spark.createDataFrame([("a", i, float(x[i])) for i in range(part * 5, part * 5 + 5)], "series_id string, t long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_to_parquet(stream_hvg(stream, "series_id", ["t"], "value"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.src, r.dst) for r in hvg_edges(points({"a": x})).collect())
    seen = []
    to_batches(stream_transitions(stream, "series_id", ["t"], "value"), lambda df, n: seen.append(df.count()), str(tmp_path / "ck2")).awaitTermination()
    assert sum(seen) == len(x) - 3


def test_user_hooks(spark, points):
    register(spark)
    assert spark.sql("select * from hvg_edges(array(2.0D, 1.0D, 2.0D))").count() == 3
    assert series_metrics(points({"a": [1, 5]}), {"top": max}).first().top == 5.0
