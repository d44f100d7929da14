"""Visibility edges and transitions while points arrive (ST5, ST6)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def stream_hvg(stream: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """``series_id, src, dst``: horizontal visibility edges as soon as their right end arrives.

    The state of a series is its monotone stack and its number of points: every point is pushed once
    and popped once.  Points must arrive in order from batch to batch; inside one they are sorted by ``order``.
    """
    kind = stream.schema[series].dataType.simpleString()

    def step(key, batches, state):
        n, places, values = state.get if state.exists else (0, [], [])
        places, values = list(places), list(values)
        rows = pd.concat(list(batches)).sort_values(order)
        src, dst = [], []
        for v in rows[value].to_numpy():
            if v != v:
                continue
            while values and values[-1] < v:
                src.append(places.pop())
                values.pop()
                dst.append(n)
            if places:
                src.append(places[-1])
                dst.append(n)
            places.append(n)
            values.append(float(v))
            n += 1
        state.update((n, places, values))
        yield pd.DataFrame({"series_id": [key[0]] * len(src), "src": src, "dst": dst}).astype({"src": "int64", "dst": "int64"})

    clean = stream.where(f"{series} is not null and {value} is not null")
    return clean.groupBy(series).applyInPandasWithState(step, f"series_id {kind}, src long, dst long", "n long, places array<long>, xs array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_transitions(stream: DataFrame, series: str, order: list[str], value: str, length: int = 3) -> DataFrame:
    """``series_id, src, dst``: one row per step between ordinal patterns of ``length`` values (count them downstream).

    The state is the last ``length`` values.
    """
    kind = stream.schema[series].dataType.simpleString()

    def pattern(x: list[float]) -> str:
        return "".join(str(i) for i in sorted(range(len(x)), key=lambda i: (x[i], i)))

    def step(key, batches, state):
        tail = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        src, dst = [], []
        for v in rows[value].to_numpy():
            if v != v:
                continue
            tail.append(float(v))
            if len(tail) > length:
                src.append(pattern(tail[:-1]))
                dst.append(pattern(tail[1:]))
                tail = tail[1:]
        state.update((tail,))
        yield pd.DataFrame({"series_id": [key[0]] * len(src), "src": src, "dst": dst})

    clean = stream.where(f"{series} is not null and {value} is not null")
    return clean.groupBy(series).applyInPandasWithState(step, f"series_id {kind}, src string, dst string", "tail array<double>", "append", GroupStateTimeout.NoTimeout)
