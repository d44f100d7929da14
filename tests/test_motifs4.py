"""Connected quadruples are counted, not made."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavelattice.operators import graphpaths
from wavelattice.operators.combined import motif_counts

KIND = {(3, (1, 1, 2, 2)): "P4", (3, (1, 1, 1, 3)): "K13", (4, (2, 2, 2, 2)): "C4", (4, (1, 2, 2, 3)): "paw", (5, (2, 2, 3, 3)): "diamond", (6, (3, 3, 3, 3)): "K4"}


def brute(edges):
    """Every quadruple of every graph, by its degrees (which tell the connected ones)."""
    out = {}
    for s in {e[0] for e in edges}:
        have = {frozenset(e[1:]) for e in edges if e[0] == s and e[1] != e[2]}
        for q in combinations(sorted(set().union(*have)), 4):
            in_q = [p for p in combinations(q, 2) if frozenset(p) in have]
            kind = KIND.get((len(in_q), tuple(sorted(sum(x in p for p in in_q) for x in q))))
            if kind:
                out[s, kind] = out.get((s, kind), 0) + 1
    return out


@pytest.mark.parametrize("most_local", [5_000_000, 25, 0])
def test_motifs4_are_those_of_all_quadruples(spark, monkeypatch, most_local):
    rng = np.random.default_rng(5)
    edges = [("K", i, j) for i, j in combinations(range(7), 2)] + [("star", 50, 100 - k) for k in range(9)] + [("ring", k, (k + 1) % 4) for k in range(4)] + [("two", 1, 2)]
    edges += [(f"r{p}", int(i), int(j)) for p in (1, 3, 6) for i, j in rng.integers(0, 14, (p * 12, 2))]  # loops and repeats too
    monkeypatch.setattr(graphpaths, "WEDGES", 20)
    df = spark.createDataFrame(edges, "series_id string, src long, dst long")
    got = {(r.series_id, r.motif): r.n for r in graphpaths.motifs4(df, most_local).collect()}
    assert got == brute(edges)


def test_motif_counts_of_hub(spark):
    """A hub of 20 000 leaves has 1.3e12 quadruples: before, each was made."""
    edges = spark.range(1, 20_001).select(F.lit("hub").alias("series_id"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    nodes = spark.range(20_001).select(F.lit("hub").alias("series_id"), F.col("id").alias("node"))
    assert [tuple(r) for r in motif_counts(nodes, edges, "undirected-4").collect()] == [("hub", "K13", 20_000 * 19_999 * 19_998 // 6)]
    assert motif_counts(nodes, edges.limit(0), "undirected-4").count() == 0
