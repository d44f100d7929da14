"""User hooks: a table function for visibility edges, metrics of whole series, weights of distances (UF1-UF6)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="src long, dst long")
class HvgEdges:
    """Edges of the horizontal visibility graph of one array: ``select * from hvg_edges(array(...))``."""

    def eval(self, x: list):
        stack: list[int] = []
        for j, v in enumerate(x):
            while stack and x[stack[-1]] < v:
                yield stack.pop(), j
            if stack:
                yield stack[-1], j
            stack.append(j)


def register(spark) -> None:
    """Makes ``hvg_edges`` known to SQL."""
    spark.udtf.register("hvg_edges", HvgEdges)


def series_metrics(points: DataFrame, metrics: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """``series_id`` and one double per metric, each a function of a series' values in order."""
    kind = points.schema["series_id"].dataType.simpleString()
    names = list(metrics)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy()
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1].tolist()} | {n: [float(metrics[n](x))] for n in names})

    return points.select("series_id", "t", "value").groupBy("series_id").applyInPandas(apply, f"series_id {kind}, " + ", ".join(f"`{n}` double" for n in names))


def inverse_weight(d):
    """1 / (1 + d) as a column expression."""
    return 1.0 / (1.0 + F.col(d) if isinstance(d, str) else 1.0 + d)
