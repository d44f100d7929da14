"""From a configuration to result rows: one row per series (or window) with a struct per method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.config import Graphs, Pipeline
from wavelattice.operators import graph, recurrence, transition
from wavelattice.operators.combined import METRICS, network_metrics
from wavelattice.operators.decompose import decompose
from wavelattice.operators.series import load_series, number_points
from wavelattice.operators.significance import metric_significance
from wavelattice.operators.visibility import hvg_edges, nvg_edges
from wavelattice.operators.windows import sliding_windows
from wavelattice.sources.sinks import write_errors, write_results

METHODS = ("hvg", "nvg", "recurrence", "transition")


def build_edges(points: DataFrame, method: str, config: Graphs) -> DataFrame:
    """``series_id, src, dst`` by method name in any case; unknown names raise."""
    name = method.lower()
    if name == "hvg":
        return hvg_edges(points, config.hvg.tie_rule, config.hvg.limit)
    if name == "nvg":
        c = config.nvg
        return nvg_edges(points, c.limit, max_edges=c.max_edges, max_edges_per_node=c.max_edges_per_node)
    if name == "recurrence":
        c = config.recurrence
        v = recurrence.embed(points, c.m, c.tau) if c.m > 1 else points
        if c.rule == "knn":
            return recurrence.undirected(recurrence.knn_arcs(v, c.k, c.metric, c.theiler))
        return recurrence.epsilon_edges(v, c.epsilon, c.metric, c.theiler)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")


def method_stats(points: DataFrame, method: str, config: Graphs) -> DataFrame:
    """``series_id, <method> struct``: statistics of the chosen graph."""
    if method.lower() == "transition":
        c = config.transition
        s = transition.transition_stats(transition.transition_network(points, c.symbolizer, c.order, c.delay, c.bins, c.memory))
    else:
        directed = getattr(getattr(config, method.lower(), None), "directed", False)
        s = graph.summary(graph.nodes_of(points), build_edges(points, method, config), directed)
    return s.select("series_id", F.struct(*[c for c in s.columns if c != "series_id"]).alias(method.lower()))


def run_points(points: DataFrame, config: Pipeline) -> DataFrame:
    """Result rows of numbered points: ``series_id, n_points`` and a struct per enabled method (null where it has no graph)."""
    if config.windows.enabled:
        w = sliding_windows(points, config.windows.size, config.windows.step)
        vary = w.groupBy("series_id", "window_id").agg(F.stddev_pop("value").alias("sd")).where("sd > 0").select("series_id", "window_id")
        kept = w.join(vary, ["series_id", "window_id"])
        points = kept.select(F.concat_ws("_w", "series_id", "window_id").alias("series_id"), F.col("pos").alias("t"), "value")
    if config.structural.enabled:
        points = decompose(points, config.structural.trend, config.structural.period).select("series_id", "t", F.col("residual").alias("value"))
    out = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_points"))
    for method in METHODS:
        if getattr(config.graphs, method).enabled:
            out = out.join(method_stats(points, method, config.graphs), "series_id", "left")
    return out


def errors_of(results: DataFrame, least: int = 3) -> DataFrame:
    """``series_id, error`` of series that are too short for a graph; they stay in the results."""
    return results.where(F.col("n_points") < least).select("series_id", F.format_string("only %d points", "n_points").alias("error"))


def run(spark: SparkSession, config: Pipeline) -> DataFrame:
    """Loads, builds, writes the results and the error rows, and gives the results back."""
    d = config.dataset
    loaded = load_series(spark.read.parquet(d.path), d.time_col, d.value_col, d.id_col, d.start, d.end, config.sampling.frequency, config.sampling.agg, d.tz)
    results = run_points(number_points(loaded), config)
    write_results(results, config.output.path, config.output.format, config.output.overwrite)
    written = spark.read.parquet(config.output.path) if config.output.format == "parquet" else results
    write_errors(errors_of(written), f"{config.output.path}_errors")
    return written


class GraphBuilder:
    """Estimator-like surface: ``fit(points).transform(points)`` gives edges, degrees or stats; parameters can be read and set."""

    OUTPUTS = ("edges", "degrees", "stats")

    def __init__(self, method: str = "hvg", output: str = "edges", config: Graphs | None = None) -> None:
        self.set_params(method=method, output=output, config=config or Graphs())

    def get_params(self) -> dict:
        return {"method": self.method, "output": self.output, "config": self.config}

    def set_params(self, **params) -> GraphBuilder:
        for k, v in params.items():
            if k not in ("method", "output", "config"):
                raise ValueError(f"unknown parameter {k}")
            setattr(self, k, v)
        if self.output not in self.OUTPUTS:
            raise ValueError(f"output must be one of {self.OUTPUTS}")
        return self

    def fit(self, points: DataFrame) -> GraphBuilder:
        return self

    def transform(self, points: DataFrame) -> DataFrame:
        if self.method.lower() == "transition":
            c = self.config.transition
            net = transition.transition_network(points, c.symbolizer, c.order, c.delay, c.bins, c.memory)
            return transition.transition_stats(net) if self.output == "stats" else net
        edges = build_edges(points, self.method, self.config)
        if self.output == "edges":
            return edges
        nodes = graph.nodes_of(points)
        return graph.degrees(nodes, edges) if self.output == "degrees" else graph.summary(nodes, edges)

    def _graph(self, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        if self.method.lower() == "transition":
            raise ValueError("transition networks have no undirected graph measures")
        return graph.nodes_of(points), build_edges(points, self.method, self.config)

    def network_metrics(self, points: DataFrame, include: Sequence[str] = METRICS) -> DataFrame:
        """Clustering, paths and modularity of each series' graph."""
        return network_metrics(*self._graph(points), include)

    def test_significance(self, points: DataFrame, names: Sequence[str] = ("avg_degree",), method: str = "shuffle", count: int = 20, seed: int = 42) -> DataFrame:
        """Graph statistics of each series against those of its surrogates."""

        def metric(p: DataFrame) -> DataFrame:
            return graph.summary(*self._graph(p)).select("series_id", *names)

        return metric_significance(points, metric, list(names), method, count, seed=seed)

    def fit_transform(self, points: DataFrame) -> DataFrame:
        return self.fit(points).transform(points)
