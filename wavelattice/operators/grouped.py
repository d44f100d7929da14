"""Sorted groups streamed through Arrow batches: many small groups per call, long ones carried over."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_groups(df: DataFrame, keys: Sequence[str], order: str, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(rows, starts)`` on runs of whole groups, sorted by keys and ``order``; ``starts`` are the groups' first rows.

    One call takes all groups that end within an Arrow batch, so a group costs no call of its own, as it
    would with ``applyInPandas``; memory is one batch and the group that is not complete yet.
    Groups are told apart by a 64-bit hash of their keys and by ``order`` starting anew.
    """
    placed = df.withColumn("__g", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            g, o = pdf["__g"].to_numpy(), pdf[order].to_numpy()
            new = np.r_[True, (g[1:] != g[:-1]) | (o[1:] <= o[:-1])]
            if last is not None:
                new[0] = g[0] != last[0] or o[0] <= last[1]
            last = (g[-1], o[-1])
            at = np.flatnonzero(new)
            if not len(at):  # still inside one group
                held.append(pdf)
                continue
            done = [*held, pdf.iloc[: at[-1]]]
            held = [pdf.iloc[at[-1] :]]
            rows = pd.concat(done, ignore_index=True) if len(done) > 1 else done[0]
            if len(rows):
                yield fn(rows, _starts(rows, order))
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield fn(rows, _starts(rows, order))

    return placed.mapInPandas(run, schema)


def _starts(rows: pd.DataFrame, order: str) -> np.ndarray:
    g, o = rows["__g"].to_numpy(), rows[order].to_numpy()
    return np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (o[1:] <= o[:-1])])
