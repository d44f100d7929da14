"""Streams of readings: watermarks, tumbling and session windows, sinks (ST1-ST4, ST7)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery


def tumbling(stream: DataFrame, time: str, value: str, by: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``by, start, n, mean, total`` of windows closed on the left; rows later than ``late`` are dropped by the watermark."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total")).select(by, F.col("w.start").alias("start"), "n", "mean", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``by, start, end, n`` of stretches without a pause of ``gap``."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs all available rows through ``write(batch, number)``; a batch number that was written before may be skipped by the sink."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def run_to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes all available rows of an append stream as Parquet and waits for the end."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def count_windows(stream: DataFrame, series: str, order: list[str], value: str, width: int, by: int = 1) -> DataFrame:
    """``series_id, window_id, mean, low, high``: sliding windows of ``width`` values every ``by`` values, as soon as each is full.

    The state of a series is the values that open windows still need and the number of values so far.  Points must
    arrive in order from batch to batch; inside one they are sorted by ``order``.  Nulls and NaN are left out.
    """
    kind = stream.schema[series].dataType.simpleString()

    def step(key, batches, state):
        n, tail = state.get if state.exists else (0, [])
        tail = list(tail)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for v in rows[value].to_numpy():
            if v != v:
                continue
            tail = [*tail, float(v)][-width:]
            n += 1
            if n >= width and (n - width) % by == 0:
                out.append((key[0], (n - width) // by, sum(tail) / width, min(tail), max(tail)))
        state.update((n, tail))
        yield pd.DataFrame(out, columns=["series_id", "window_id", "mean", "low", "high"])

    clean = stream.where(f"{series} is not null and {value} is not null")
    return clean.groupBy(series).applyInPandasWithState(step, f"series_id {kind}, window_id long, mean double, low double, high double", "n long, tail array<double>", "append", GroupStateTimeout.NoTimeout)
