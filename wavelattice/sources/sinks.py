"""Sinks: graphs, results, errors, distance shards, GraphML."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, name: str = "graph", directed: bool = False, mode: str = "errorifexists") -> None:
    """``nodes.parquet``, ``edges.parquet`` and a one-row ``meta`` table of counts in ``folder``."""
    nodes.write.mode(mode).parquet(f"{folder}/nodes.parquet")
    edges.write.mode(mode).parquet(f"{folder}/edges.parquet")
    spark = nodes.sparkSession
    counts = (spark.read.parquet(f"{folder}/nodes.parquet").count(), spark.read.parquet(f"{folder}/edges.parquet").count())
    spark.createDataFrame([(name, directed, *counts)], "name string, directed boolean, n_nodes long, n_edges long").coalesce(1).write.mode(mode).json(f"{folder}/meta")


def graphml_lines(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """``part int, line string``: the body of a GraphML document, nodes before edges; ids and weights as text."""
    safe = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    kind = "directed" if directed else "undirected"
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="{kind}">'), (3, "</graph></graphml>")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), safe(F.col("id")), F.lit('"/>')).alias("line"))
    weight = F.coalesce(F.col("weight"), F.lit(1.0)).cast("string") if "weight" in edges.columns else F.lit("1.0")
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), safe(F.col("src")), F.lit('" target="'), safe(F.col("dst")), F.lit('"><data key="w">'), weight, F.lit("</data></edge>")).alias("line"))
    return head.unionByName(n).unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str, directed: bool = False) -> None:
    """GraphML as ordered text parts that concatenate to one document."""
    graphml_lines(nodes, edges, directed).orderBy("part", "line").select("line").write.mode("overwrite").text(folder)


def write_results(df: DataFrame, folder: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Result rows as parquet, json or csv (nested columns as JSON text in csv)."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError("fmt must be parquet, json or csv")
    mode = "overwrite" if overwrite else "errorifexists"
    if fmt == "csv":
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("struct", "array", "map")) else F.col(c) for c, kind in df.dtypes])
        flat.write.mode(mode).option("header", True).csv(folder)
    else:
        getattr(df.write.mode(mode), fmt)(folder)


def write_errors(errors: DataFrame, folder: str) -> None:
    """``series_id, error`` rows as JSON."""
    errors.select("series_id", "error").write.mode("overwrite").json(folder)


def write_distance_shards(d: DataFrame, folder: str, shards: int = 8) -> None:
    """``i, j, distance`` CSV shards, split by hash."""
    d.select("i", "j", F.col("dist").alias("distance")).repartition(shards).write.mode("overwrite").option("header", True).csv(folder)


def manifest_text(**entries) -> str:
    return json.dumps(entries, indent=2, sort_keys=True)
