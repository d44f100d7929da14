"""Spatial weights (SP1, SP2, J15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.operators.recurrence import epsilon_edges, knn_arcs, undirected


def _one(coords: DataFrame) -> DataFrame:
    return coords.select(F.lit(0).alias("series_id"), F.col("id").cast("long").alias("t"), F.col("vec").cast("array<double>").alias("vec"))


def radius_weights(coords: DataFrame, radius: float) -> DataFrame:
    """``i, j, weight`` = 1 in both directions for points ``id, vec`` at most ``radius`` apart."""
    e = epsilon_edges(_one(coords), radius)
    return e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("weight")).unionByName(e.select(F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("weight")))


def knn_weights(coords: DataFrame, k: int) -> DataFrame:
    """The same for the k nearest neighbours, either way round."""
    e = undirected(knn_arcs(_one(coords), k))
    return e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("weight")).unionByName(e.select(F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("weight")))
