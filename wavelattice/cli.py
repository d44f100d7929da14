"""Command line: run a pipeline, spatial weights, graphs to and from Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavelattice import __version__
from wavelattice.config import Pipeline
from wavelattice.operators.spatial import knn_weights, radius_weights
from wavelattice.plans.pipeline import run
from wavelattice.sources.readers import read_coordinates, read_edges_csv, read_graph
from wavelattice.sources.sinks import write_graph, write_graphml, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavelattice")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("run", help="run a YAML pipeline")
    c.add_argument("config")
    c = sub.add_parser("spatial-weights", help="weights of a coordinates file")
    c.add_argument("kind", choices=("radius", "knn"))
    c.add_argument("coords")
    c.add_argument("output")
    c.add_argument("--radius", type=float)
    c.add_argument("--k", type=int)
    c = sub.add_parser("to-parquet", help="edge list CSV to a graph folder")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--name", default="graph")
    c.add_argument("--directed", action="store_true")
    c = sub.add_parser("from-parquet", help="graph folder to GraphML")
    c.add_argument("input")
    c.add_argument("--graphml", required=True)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("wavelattice").getOrCreate()
    if a.command == "run":
        run(spark, Pipeline.from_yaml(a.config))
    elif a.command == "spatial-weights":
        coords = read_coordinates(spark, a.coords).select(F.col("t").alias("id"), "vec")
        if (a.radius if a.kind == "radius" else a.k) is None:
            parser().error(f"--{a.kind if a.kind == 'radius' else 'k'} is needed")
        write_results(radius_weights(coords, a.radius) if a.kind == "radius" else knn_weights(coords, a.k), a.output)
    elif a.command == "to-parquet":
        edges = read_edges_csv(spark, a.input)
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.col("id"))
        write_graph(nodes, edges, a.output, a.name, a.directed)
    else:
        nodes, edges = read_graph(spark, a.input)
        write_graphml(nodes, edges, a.graphml)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
