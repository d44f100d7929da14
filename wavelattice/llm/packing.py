"""Documents into containers of fixed capacity: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import base64
import bisect
import importlib.util
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.session import cut_lineage

#: The usual split of text before byte-level merges (a public pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of the ranks file of the public byte-level vocabulary that this box offers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def load_encoding(path: str):
    """The tokenizer whose merge ranks stand in ``path`` (base64 token and rank on each line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens bigint`` of every row, whole texts; a null or empty text has no tokens."""
    path = vocabulary or default_vocabulary()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(path)
        for pdf in batches:
            counts = [len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.asarray(counts, dtype=np.int64)})

    small = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    return small.mapInPandas(scan, "doc_id long, n_tokens long")


def combinations(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` positive bins that fill a window of ``bins``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for b in range(min(most, left), 0, -1):
                if b * (depth - len(head)) >= left:
                    grow((*head, b), left - b, b)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2_000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    gram, right = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0.0)))
    for _ in range(steps):
        gradient = right - gram @ x
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            low = at[s[at] <= 0]
            if not len(low):
                x = s
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(x[low] - s[low] > 0, x[low] / (x[low] - s[low]), 0.0))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0.0
            if not active.any():
                break
    return x


def plan_packing(counts: dict[int, int], capacity: int, bins: int = 128, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Contents (lengths, descending) and number of containers that hold all items of a length histogram.

    Lengths are at most ``capacity``.  Rounded up to ``bins`` steps, the histogram is matched by repeat
    counts of the combinations that fill the window, solved by non-negative least squares and rounded
    down; each repeat takes the greatest real lengths that its steps allow.  What remains, and
    the space left, is packed greedily: longest first, into the fullest container that takes it.
    The plan's size depends on the number of different lengths, not on the number of items.
    """
    left = {k: v for k, v in counts.items() if v > 0 and 0 < k <= capacity}
    if not left:
        return []
    step = -(-capacity // bins)
    window = capacity // step
    kinds = combinations(window, depth)
    matrix = np.zeros((window, len(kinds)))
    for j, kind in enumerate(kinds):
        for b in kind:
            matrix[b - 1, j] += 1
    target = np.zeros(window)
    oversize: dict[int, int] = {}
    for k, v in left.items():
        b = -(-k // step)
        if b <= window:
            target[b - 1] += v
        else:
            oversize[k] = v
    # Short items fill gaps anywhere, so a mismatch among them weighs less.
    weight = np.where(np.arange(1, window + 1) * depth >= window / 2, 1.0, 0.1)
    scale = max(1.0, target.max(initial=1.0))
    repeats = np.floor(nnls(matrix * weight[:, None], target / scale * weight) * scale + 1e-6).astype(np.int64)
    ordered: dict[int, list[int]] = {}
    for k in sorted(left):
        ordered.setdefault(-(-k // step), []).append(k)
    full: dict[tuple[int, ...], int] = {}
    for j in np.argsort(-repeats, kind="stable"):
        need = int(repeats[j])
        while need > 0:
            chosen: list[int] = []
            room = capacity
            for b in kinds[j]:
                # the greatest length of this step that is left once the earlier ones are taken
                pick = next((k for k in reversed(ordered.get(b, [])) if left[k] > chosen.count(k) and k <= room), None)
                if pick is None:
                    break
                chosen.append(pick)
                room -= pick
            if len(chosen) < len(kinds[j]):
                break
            times = min(need, *(left[k] // chosen.count(k) for k in chosen))
            for k in chosen:
                left[k] -= times
                if left[k] == 0:
                    ordered[-(-k // step)] = [q for q in ordered[-(-k // step)] if left[q] > 0]
            key = tuple(sorted(chosen, reverse=True))
            full[key] = full.get(key, 0) + times
            need -= times
    # Residuals and leftover space: best fit on the histogram of spaces.
    spaces: dict[int, dict[tuple[int, ...], int]] = {}
    for key, n in full.items():
        spaces.setdefault(capacity - sum(key), {})[key] = n
    rooms = sorted(spaces)

    def add(room: int, key: tuple[int, ...], n: int) -> None:
        if room not in spaces:
            spaces[room] = {}
            bisect.insort(rooms, room)
        spaces[room][key] = spaces[room].get(key, 0) + n

    for k in sorted((q for q, v in left.items() if v > 0), reverse=True):
        n = left[k]
        while n > 0:
            i = bisect.bisect_left(rooms, k)
            if i == len(rooms):
                per = capacity // k
                whole, rest = divmod(n, per)
                if whole:
                    add(capacity - per * k, (k,) * per, whole)
                if rest:
                    add(capacity - rest * k, (k,) * rest, 1)
                n = 0
                continue
            room = rooms[i]
            key, have = next(iter(spaces[room].items()))
            fit = min(room // k, n)
            times = min(have, n // fit)
            if have == times:
                del spaces[room][key]
            else:
                spaces[room][key] = have - times
            if not spaces[room]:
                del spaces[room]
                rooms.pop(i)
            add(room - fit * k, tuple(sorted((*key, *[k] * fit), reverse=True)), times)
            n -= fit * times
    return sorted(((key, n) for group in spaces.values() for key, n in group.items()), key=lambda t: (-t[1], t[0]))


def _slots(plan: Sequence[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length the stretches of its items' ranks: ``length, first, mult, base``; container = base + (rank - first) // mult."""
    rows, base, seen = [], 0, {}
    for key, n in plan:
        for k in dict.fromkeys(key):
            mult = key.count(k)
            rows.append((k, seen.get(k, 0), mult, base))
            seen[k] = seen.get(k, 0) + mult * n
        base += n
    return pd.DataFrame(rows, columns=["length", "first", "mult", "base"]).sort_values(["length", "first"], ignore_index=True)


def pack_documents(
    documents: DataFrame,
    capacities: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity_id: str = "capacity_id",
    max_tokens: str = "max_tokens",
    vocabulary: str | None = None,
    bins: int = 128,
    depth: int = 3,
    chunks: int = 256,
    most_capacities: int = 100,
) -> DataFrame:
    """``capacity_id, doc_id, piece, n_tokens, container_id`` (bigint): every document in containers of every capacity.

    A document longer than the capacity is split into full pieces and a rest; no other is split.
    Tokens are counted once.  The length histogram, whose size the capacity bounds, goes to
    the driver and is planned there; items learn their rank among those of equal length by counts per
    chunk (a length is spread over ``chunks`` tasks, so no length is too common) and look
    their container up in the plan.  Null and empty texts have 0 tokens, piece 0 and no container
    (null).  A null or non-positive capacity gives no rows; documents under one id that occurs
    twice are packed twice.  At most ``most_capacities`` capacities are taken at once (else an error).
    """
    asked = capacities.select(F.col(capacity_id).cast("long").alias("c"), F.col(max_tokens).cast("long").alias("m")).where("c is not null and m > 0").distinct().limit(most_capacities + 1).collect()
    if len(asked) > most_capacities:
        raise ValueError(f"more than {most_capacities} capacities")
    spark = documents.sparkSession
    schema = "capacity_id long, doc_id long, piece long, n_tokens long, container_id long"
    if not asked:
        return spark.createDataFrame([], schema)
    counted = cut_lineage(token_counts(documents, doc_id, text, vocabulary))
    room = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("c"), F.lit(r[1]).alias("m")) for r in sorted(asked)]))
    sized = counted.select("doc_id", "n_tokens", room.alias("k")).select("doc_id", "n_tokens", "k.c", "k.m")
    pieces = sized.select("doc_id", "n_tokens", "c", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n_tokens") - 1) / F.col("m")), F.lit(0)).cast("long"))).alias("piece"))
    items = pieces.select("c", "doc_id", "piece", F.least(F.col("m"), F.col("n_tokens") - F.col("piece") * F.col("m")).alias("length"))
    empty = items.where("length = 0").select(F.col("c").alias("capacity_id"), "doc_id", "piece", F.col("length").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    full = items.where("length > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)).cast("int"))
    sizes = full.groupBy("c", "length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c", "length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = offsets.groupBy("c", "length").agg(F.sum("n").alias("n")).collect()  # at most sum of capacities rows
    slots = {}
    for c, m in sorted((r[0], r[1]) for r in asked):
        slots[c] = _slots(plan_packing({r[1]: r[2] for r in histogram if r[0] == c}, m, bins, depth))
    packed = {c: {n: s[n].to_numpy(np.int64) for n in s.columns} for c, s in slots.items()}
    rank = F.row_number().over(Window.partitionBy("c", "length", "chunk").orderBy("doc_id", "piece")) - 1
    ranked = full.withColumn("local", rank).join(offsets.select("c", "length", "chunk", "offset"), ["c", "length", "chunk"])
    ranked = ranked.select(F.col("c").alias("capacity_id"), "doc_id", "piece", F.col("length").alias("n_tokens"), (F.col("local") + F.col("offset")).cast("long").alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Places in the plan by binary search over (length, first), one code for both.
        codes = {c: s["length"] * (1 << 44) + s["first"] for c, s in packed.items()}
        for pdf in batches:
            out = np.empty(len(pdf), dtype=np.int64)
            cap, length, r = (pdf[n].to_numpy(np.int64) for n in ("capacity_id", "n_tokens", "rank"))
            for c in np.unique(cap):
                at = np.flatnonzero(cap == c)
                s = packed[int(c)]
                i = np.searchsorted(codes[int(c)], length[at] * (1 << 44) + r[at], side="right") - 1
                out[at] = s["base"][i] + (r[at] - s["first"][i]) // s["mult"][i]
            yield pdf.assign(container_id=out)[["capacity_id", "doc_id", "piece", "n_tokens", "container_id"]]

    return ranked.mapInPandas(place, schema).unionByName(empty)


def fill_report(packed: DataFrame, capacities: DataFrame, capacity_id: str = "capacity_id", max_tokens: str = "max_tokens") -> DataFrame:
    """Per capacity: containers, tokens, the least possible number of containers and the share filled."""
    used = packed.where("container_id is not null").groupBy("capacity_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    caps = capacities.select(F.col(capacity_id).cast("long").alias("capacity_id"), F.col(max_tokens).cast("long").alias("m"))
    return used.join(F.broadcast(caps), "capacity_id").select("capacity_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("m")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("m")), 6).alias("filled"))
