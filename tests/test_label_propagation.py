"""Labels spread within batches as they do by rounds of joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavelattice.operators import combined


@pytest.mark.parametrize("most_rounds", [50, 3])
def test_batches_and_rounds_agree_with_steps(spark, most_rounds):
    """Graphs that settle at different times, rings that never do in few rounds, repeats, loops, nodes without edges and with gaps in their numbers."""
    rng = np.random.default_rng(9)
    edges = [(f"r{g}", int(3 * i), int(3 * j)) for g in range(6) for i, j in rng.integers(0, 30, (20 + 15 * g, 2))]
    edges += [("ring", k, (k + 1) % 40) for k in range(40)] + [("ring", 0, 1)]
    have = sorted({(s, x) for s, *p in edges for x in p} | {("r0", 1), ("alone", 4)})
    nodes = spark.createDataFrame(have, "series_id string, node long")
    df = spark.createDataFrame(edges, "series_id string, src long, dst long")
    turn = {r.node: r.t for r in nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(2)).alias("t")).distinct().collect()}
    near = {k: set() for k in have}
    for s, a, b in edges:
        if a != b:
            near[s, a].add(b)
            near[s, b].add(a)
    want = {k: k[1] for k in have}
    for i in range(most_rounds):
        old = dict(want)
        for (s, x), vs in near.items():
            if vs and turn[x] == i % 2:
                votes = [old[s, v] for v in vs]
                want[s, x] = max(set(votes), key=lambda c: (votes.count(c), c == old[s, x], -c))
    got = [{(r.series_id, r.node): r.community for r in combined.label_propagation(nodes, df, most_rounds, most).collect()} for most in (5_000_000, 0)]
    assert got[0] == got[1] == want


def test_rounds_of_small_graphs_write_no_tables(spark, monkeypatch):
    """Before, every round of every graph was two jobs of the driver and a table."""
    tables = []
    monkeypatch.setattr(combined, "written", lambda df, f=combined.written: tables.append(1) or f(df))
    edges = spark.range(60).select(F.lit("g").alias("series_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert combined.label_propagation(spark.range(61).select(F.lit("g").alias("series_id"), F.col("id").alias("node")), edges).count() == 61
    assert len(tables) == 1
