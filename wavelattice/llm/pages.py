"""Scanned pages: reading order of their lines, words broken at line ends, letters for matching."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that break a word at a line's end.
BREAKS = "-‐‑¬=­"
_BROKEN = re.compile(f"[{BREAKS}]\\s*$")
_NOT_LETTERS = re.compile(r"[^a-z0-9]+")
#: A gap this wide inside a line parts two columns that the scanner took for one.
_WIDE = re.compile(r"(?<=\S) {3,}(?=\S)")


def page_columns(df: DataFrame, doc_id: str, text: str, boxes: str | None, keep: Sequence[Column] = ()) -> DataFrame:
    """``doc_id, text, x, y`` (and ``keep``): the page with the left and upper edges of its lines as flat arrays."""
    has = boxes is not None and boxes in df.columns
    x, y = (F.col(f"{boxes}.x0"), F.col(f"{boxes}.y0")) if has else (F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>"))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), x.alias("x"), y.alias("y"), *keep)


def _columns(n: int, x: np.ndarray | None, y: np.ndarray | None, column_gap: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Column number and upper edge of every line, or None where boxes are missing, null or not one per line."""
    if x is None or y is None or len(x) != n or len(y) != n or n < 2:
        return None
    try:
        xs = np.asarray(x, dtype=np.float64)
        ys = np.asarray(y, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    if np.isnan(xs).any() or np.isnan(ys).any():
        return None
    by_x = np.argsort(xs, kind="stable")
    column = np.empty(n, dtype=np.int64)
    column[by_x] = np.concatenate(([0], np.cumsum(np.diff(xs[by_x]) > column_gap)))
    return column, ys


def reading_order(lines: list[str], x: np.ndarray | None, y: np.ndarray | None, column_gap: int = 40) -> list[int]:
    """Indices of the lines column by column, top to bottom.

    Left edges that lie within ``column_gap`` of one another form a column.  Where boxes
    are missing, null or not one per line, the stored order is kept.
    """
    placed = _columns(len(lines), x, y, column_gap)
    return list(range(len(lines))) if placed is None else np.lexsort((placed[1], placed[0])).tolist()


def restored_lines(text: str, x: np.ndarray | None, y: np.ndarray | None, least_wide: int = 3, column_gap: int = 40) -> list[str]:
    """The page's lines in reading order, lines that run across columns parted.

    On a page with at least ``least_wide`` lines that hold a gap of three and more blanks, the parts
    behind a gap belong to the next column that has so many lines of its own, or else to one that follows the rest of the page.
    """
    lines = text.split("\n")
    wide = [i for i, line in enumerate(lines) if "   " in line and _WIDE.search(line)] if "   " in text else []
    if len(wide) < least_wide:
        return [lines[i] for i in reading_order(lines, x, y, column_gap)]
    placed = _columns(len(lines), x, y, column_gap)
    column, top = placed if placed is not None else (np.zeros(len(lines), dtype=np.int64), np.arange(len(lines), dtype=np.float64))
    size = np.bincount(column)
    parts: list[tuple[int, float, int, str]] = []
    across = set(wide)
    for i, line in enumerate(lines):
        own = int(column[i])
        cut = _WIDE.split(line) if i in across else [line]
        right = [c for c in range(own + 1, len(size)) if size[c] >= least_wide]
        for j, part in enumerate(cut):
            at = own if j == 0 else right[j - 1] if j <= len(right) else len(size) + j
            parts.append((at, float(top[i]), i, part))
    parts.sort(key=lambda q: q[:3])
    return [q[3] for q in parts]


def is_broken(line: str) -> bool:
    """Whether the line ends with a sign that breaks a word."""
    return _BROKEN.search(line) is not None


def joined(lines: Sequence[str]) -> str:
    """The lines as running text, words that were broken at line ends whole again."""
    out = []
    for line in lines:
        cut = _BROKEN.sub("", line)
        out.append(cut if cut != line and cut[-1:].isalpha() else line + " ")
    return "".join(out)


def letters(text: str) -> str:
    """Lower-case letters and digits only, accents removed."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
    return _NOT_LETTERS.sub("", low)
