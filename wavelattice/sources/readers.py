"""Readers: Parquet series, panel CSV, coordinates text, edge lists, JSON series, other adapters."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.operators.series import as_number, finite, load_series


def read_series(spark: SparkSession, path: str, time_col: str, value_col: str, id_col: str | None = None, **options) -> DataFrame:
    """A Parquet scan of only the columns asked for, through ``load_series``."""
    return load_series(spark.read.parquet(path), time_col, value_col, id_col, **options)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, value_col: str, group_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """``series_id, t, value`` of a pandas table: by group and time (or row order), NaN left out."""
    keyed = pdf.assign(__row=range(len(pdf)))
    small = pd.DataFrame({"series_id": keyed[group_col].astype(str) if group_col else "series", "o": keyed[time_col] if time_col else keyed["__row"], "value": pd.to_numeric(keyed[value_col], errors="coerce")})
    small = small.dropna(subset=["value"]).sort_values(["series_id", "o"], kind="stable")
    small["t"] = small.groupby("series_id").cumcount().astype("int64")
    return spark.createDataFrame(small[["series_id", "t", "value"]], "series_id string, t long, value double")


def from_arrow(spark: SparkSession, table, value_col: str, group_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """The same of an Arrow table, or of anything with ``to_arrow``."""
    return from_pandas(spark, (table.to_arrow() if hasattr(table, "to_arrow") else table).to_pandas(), value_col, group_col, time_col)


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """``series_id, t, value`` of a CSV with one series per row, its name in the first column."""
    wide = spark.read.csv(path, header=True)
    name, *rest = wide.columns
    cells = wide.select(F.col(f"`{name}`").alias("series_id"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in rest])).alias("t", "v"))
    return cells.select("series_id", F.col("t").cast("long").alias("t"), as_number(F.col("v")).alias("value")).where(finite(F.col("value")))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``vec array<double>`` of a text file of blank-separated numbers, with ``t`` the row's place in its file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("t")).where(F.length(F.trim("value")) > 0)
    return lines.select("t", F.split(F.trim("value"), r"\s+").cast("array<double>").alias("vec"))


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, weight`` of a headerless edge list; a missing weight is 1."""
    raw = spark.read.schema("src string, dst string, weight double").csv(path)
    return raw.select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that ``sinks.write_graph`` wrote."""
    edges = spark.read.parquet(f"{folder}/edges.parquet")
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    return spark.read.parquet(f"{folder}/nodes.parquet"), edges


def read_distance_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Both triangles of the distances that shards ``i, j, distance`` hold."""
    d = spark.read.schema("i long, j long, distance double").csv(folder, header=True)
    return d.unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))


def named_distances(d: DataFrame, names: DataFrame, key: str = "k", name: str = "name") -> DataFrame:
    """``name_i, name_j, distance``: distances of numbered series with the series' names (J16); numbers without a name are left out."""
    a = names.select(F.col(key).cast("long").alias("i"), F.col(name).alias("name_i"))
    b = names.select(F.col(key).cast("long").alias("j"), F.col(name).alias("name_j"))
    return d.join(a, "i").join(b, "j").select("name_i", "name_j", "distance")


def json_series(df: DataFrame, record: str, least: int = 50) -> DataFrame:
    """``series_id, t, value`` of records ``{"series_id": ..., "data": [[period, value], ...]}``, one series per record.

    Invalid records, records without id, points without a number and constant or short series are left out;
    a record whose array holds other things than pairs contributes its pairs.
    """
    parsed = df.select(F.try_parse_json(F.col(record)).alias("v")).where(F.col("v").isNotNull())
    fields = parsed.select(F.try_variant_get("v", "$.series_id", "string").alias("series_id"), F.try_variant_get("v", "$.data", "array<variant>").alias("data")).where("series_id is not null and data is not null")
    cells = fields.select("series_id", F.posexplode("data").alias("pos", "o"))
    values = cells.select("series_id", "pos", F.try_variant_get("o", "$[1]", "string").try_cast("double").alias("value")).where(finite(F.col("value")))
    from wavelattice.operators.series import keep_long, number_points

    return keep_long(number_points(values, order=("pos",)), least, varying=True)


def manifest(folder: str) -> dict:
    """The small JSON manifest beside a table."""
    with open(f"{folder}/graph_meta.json", encoding="utf-8") as f:
        return json.load(f)
