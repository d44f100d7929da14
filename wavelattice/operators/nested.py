"""Deeply nested JSON records to flat, linked tables by Dewey labels."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id long, dewey array<int>, path string, table_name string, series_id string, pos long, "
    "key string, num double, txt string, name string, units string, freq string, extra string"
)

# The table that a schema path's last member names, and the member's ordinal in the labels, by the table above it.
TABLES = {
    "series": {"data": ("data", 0), "geography": ("geography", 1), "children": ("series", 2)},
    "data": {"revisions": ("revision", 0)},
}
#: Members that have columns of their own.
COLUMNS = {"series": ("series_id", "name", "units", "f"), "data": ("period", "value"), "revision": ("on", "value"), "geography": ("code", "share")}
_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*", re.ASCII)


def _text(x: object) -> str | None:
    """A scalar as text, as JSON writes it; None for null, containers and empty text."""
    if x is None or isinstance(x, (dict, list)):
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    s = str(x)
    return s if s.strip() else None


def _number(x: object) -> float | None:
    """A number, also one written as text; None for anything else, not-a-number and infinity."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str)) or (isinstance(x, str) and not _NUMBER.fullmatch(x)):
        return None
    try:
        v = float(x)
    except (ValueError, OverflowError):
        return None
    return v if math.isfinite(v) else None


def _reject(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


def parse_record(text: str | None) -> tuple[dict, list[tuple[int, str, dict]]]:
    """Members of a record beside its series, and its root series with their places and schema paths; no series for text that is no valid record."""
    if text is None:
        return {}, []
    try:
        top = json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return {}, []
    beside: dict = {}
    if isinstance(top, dict) and isinstance(top.get("series"), list) and "data" not in top:
        tops, path = top["series"], "$.series[]"
        beside = {k: v for k, v in top.items() if k != "series"}
    else:
        tops, path = (top, "$[]") if isinstance(top, list) else ([top], "$")
    fields = {"series_id", "name", "data", "children", "geography", "units"}
    return beside, [(i, path, s) for i, s in enumerate(tops) if isinstance(s, dict) and fields & s.keys()]


def _elements(table: str | None, v: object) -> list | None:
    """The elements that a member holds as a table of its own (also where the array is written as JSON text); None where it holds none."""
    if table == "geography":
        return v if isinstance(v, list) else None if v is None else [v]
    if table is None:
        return v if isinstance(v, list) and any(isinstance(e, (dict, list)) for e in v) else None
    if table == "series" and isinstance(v, dict):
        return [v]
    if isinstance(v, str):
        try:
            v = json.loads(v, parse_constant=_reject)
        except (ValueError, RecursionError):
            return None
    return v if isinstance(v, list) else None


def _json(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def walk_record(text: str | None) -> Iterator[tuple[tuple[int, ...], str, str | None, object, dict]]:
    """Label, schema path, table, value and further members of every node of a record, parents first.

    A node's label is its parent's label, the ordinal of the member that holds it and its place there, so
    cutting the last two numbers gives the parent's.  Members that hold arrays of objects or arrays become nodes, under
    whatever name; known ones are named by ``TABLES``, others have no table.  The walk keeps its
    own stack, so depth is bounded by memory only.
    """
    beside, roots = parse_record(text)
    if beside and roots:
        yield (), "$", None, None, beside
    stack: list[tuple[tuple[int, ...], str, str | None, object]] = [((i,), path, "series", s) for i, path, s in reversed(roots)]
    while stack:
        label, path, table, node = stack.pop()
        if not isinstance(node, dict):
            yield label, path, table, node, {}
            continue
        known, rest, below = TABLES.get(table or "", {}), {}, []
        own = COLUMNS.get(table or "", ())
        others = 3
        for k in sorted(node):
            v = node[k]
            if k in own:
                if isinstance(v, (dict, list)):
                    rest[k] = v
                continue
            name, ordinal = known.get(k, (None, None))
            elements = _elements(name, v)
            if elements is None:
                rest[k] = v
                continue
            if ordinal is None:
                ordinal, others = others, others + 1
            below.append((ordinal, k, name, elements))
        yield label, path, table, node, rest
        for ordinal, k, name, elements in sorted(below, key=lambda m: m[0], reverse=True):
            at = f"{path}.{k}[]"
            stack += [((*label, ordinal, i), at, name, e) for i, e in reversed(list(enumerate(elements))) if e is not None and e != {} and e != [] and e != ""]


def label_nodes(record_id: int, text: str | None) -> Iterator[tuple]:
    """Every node of a record, as a row of ``NODE_SCHEMA``.

    The series that holds a node is found by truncating the node's label.  A node of a known path that is no
    child there (an observation without period, an area without code) keeps its content under no table, as
    do nodes of other paths; members without a column of their own are kept in ``extra``.
    """
    ids: dict[tuple[int, ...], str] = {}
    for label, path, table, node, rest in walk_record(text):
        key = num = txt = name = units = freq = None
        up = label[:-2]
        holder = ids.get(up)
        while holder is None and up:
            up = up[:-2]
            holder = ids.get(up)
        pos = label[-1] if label else 0
        if table == "series" and isinstance(node, dict):
            key, name, units, freq = _text(node.get("series_id")) or "", _text(node.get("name")), _text(node.get("units")), _text(node.get("f"))
            ids[label] = key
        elif table == "data" and isinstance(node, (dict, list)):
            period, value = (node.get("period"), node.get("value")) if isinstance(node, dict) else (node[0], node[1] if len(node) > 1 else None)
            key, num, txt = _text(period), _number(value), _text(value)
            if isinstance(node, list) and (len(node) > 2 or any(isinstance(v, (dict, list)) for v in node)):
                rest = {str(i): v for i, v in enumerate(node) if i > 1 or isinstance(v, (dict, list))}
        elif table == "revision" and isinstance(node, dict):
            key, num, txt, pos = _text(node.get("on")) or "", _number(node.get("value")), _text(node.get("value")), label[-3]
        elif table == "geography":
            key, num = (_text(node.get("code")), _number(node.get("share"))) if isinstance(node, dict) else (_text(node), None)
            if isinstance(node, dict) and num is None and node.get("share") is not None:
                rest = {**rest, "share": node["share"]}
        if key is None and label:
            content = {**{k: node[k] for k in COLUMNS.get(table or "", ()) if k in node}, **rest} if isinstance(node, dict) else node
            table, num, txt, rest = None, None, None, content
        yield (record_id, label, path, table, holder, pos, key, num, txt, name, units, freq, _json(rest) if rest not in ({}, None) else None)


def flatten_records(df: DataFrame, record_id: str, record: str, rows_per_batch: int = 2_000) -> DataFrame:
    """All nodes of all records, labelled; ``parent`` is the label cut by its last two numbers, the flat tables are selections by ``table_name``.

    One pass without any exchange: each record is parsed once in an Arrow batch and walked
    with ordinal path labels; a batch's nodes are emitted in slices of ``rows_per_batch``.
    Null records, invalid JSON and text without a series give no rows.  Repeated record ids
    stay repeated.  Extra input columns are ignored.  A label is unique within its record.
    """
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for rid, text in zip(pdf["record_id"], pdf["record"]):
                for row in label_nodes(rid, text):
                    rows.append(row)
                    if len(rows) >= rows_per_batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    small = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(record).cast("string").alias("record")).where(F.col("record_id").isNotNull() & F.col("record").isNotNull())
    size = F.size("dewey")
    return small.mapInPandas(walk, NODE_SCHEMA).withColumn("parent", F.when(size > 2, F.slice("dewey", F.lit(1), size - 2)))


def series_table(nodes: DataFrame) -> DataFrame:
    """One row per series: label, parent label (null at the top), ids, texts."""
    return nodes.where("table_name = 'series'").select(
        "record_id", "dewey", "parent", F.col("key").alias("series_id"), F.col("series_id").alias("parent_series_id"), "pos", "name", "units", "freq", F.col("extra").alias("extra_json")
    )


def observations_table(nodes: DataFrame) -> DataFrame:
    """One row per observation with a period, linked to its series by ``parent``."""
    return nodes.where("table_name = 'data'").select("record_id", "dewey", "parent", "series_id", "pos", F.col("key").alias("period"), F.col("num").alias("value"), F.col("txt").alias("value_text"), F.col("extra").alias("extra_json"))


def revisions_table(nodes: DataFrame) -> DataFrame:
    """One row per revision, linked to its observation by ``parent``."""
    return nodes.where("table_name = 'revision'").select("record_id", "dewey", "parent", "series_id", "pos", F.col("key").alias("revised_on"), F.col("num").alias("value"), F.col("txt").alias("value_text"), F.col("extra").alias("extra_json"))


def areas_table(nodes: DataFrame) -> DataFrame:
    """One row per area of a series, linked to it by ``parent``."""
    return nodes.where("table_name = 'geography'").select("record_id", "dewey", "parent", "series_id", "pos", F.col("key").alias("code"), F.col("num").alias("share"), F.col("extra").alias("extra_json"))


def further_table(nodes: DataFrame) -> DataFrame:
    """One row per node of no known table, linked to its parent: its schema path and content as JSON."""
    return nodes.where("table_name is null").select("record_id", "dewey", "parent", "series_id", "pos", "path", F.col("extra").alias("content_json"))
