import math
import random

import numpy as np
import pytest

from wavelattice.llm.digests import certify, error_bound, grouped_percentiles, merge_digests, partial_digests, quantiles, refined

SCHEMA = "k string, day int, v double, part long, weight long, mean double, low double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot", i % 10, rng.lognormvariate(0, 2)) for i in range(20_000)]
    data += [(f"g{i % 40}", i % 10, float(rng.randint(0, 3))) for i in range(4_000)]  # many ties
    data += [("one", 0, 4.5), ("nul", 0, None), ("nan", 0, float("nan")), ("inf", 0, math.inf), (None, 0, 1.0), ("big", 0, 1e300), ("big", 1, -1e300)]
    return spark.createDataFrame([(*r, 1, 1, 1.0, 1.0) for r in data], SCHEMA).repartition(5).cache()


def test_error_bound(rows):
    out = grouped_percentiles(rows, ["k"], "v", (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0), delta=100.0).collect()
    by = {(r.k, r.q): r for r in out}
    assert not {"nul", "nan", "inf", None} & {r.k for r in out}
    for r in out:
        assert r.rank_error <= r.bound == error_bound(100.0), r
        assert r.below <= r.upto <= r.n
    values = np.sort([r.v for r in rows.where("k = 'hot'").collect()])
    assert by["hot", 0.5].below == np.searchsorted(values, by["hot", 0.5].estimate) and by["hot", 0.0].estimate == values[0] and by["hot", 1.0].estimate == values[-1]
    assert by["one", 0.5].estimate == 4.5 and by["g1", 0.5].estimate in (0, 1, 2, 3)


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([(f"k{n}", float(i * i)) for n in range(1, 25) for i in range(n)], "k string, v double").repartition(1)
    for r in grouped_percentiles(df, ["k"], "v", (0.01, 0.25, 0.5, 0.75, 0.99)).collect():
        own = sorted(float(i * i) for i in range(int(r.k[1:])))
        assert r.estimate in own and r.rank_error == 0, r


def test_groups_beyond_the_bound_are_done_again(rows):
    qs = (0.1, 0.5, 0.9)
    coarse = certify(rows, ["k"], "v", quantiles(merge_digests(partial_digests(rows, ["k"], "v", 6.0), ["k0"], "part", 6.0), ["k0"], qs).withColumnRenamed("k0", "k"))
    assert max(r.rank_error for r in coarse.collect()) > 0.01
    fine = refined(rows, ["k"], "v", coarse, qs, 0.01, 6.0).collect()
    assert len(fine) == coarse.count() and max(r.rank_error for r in fine) <= 0.01


def test_deep_tree(rows):
    parts = partial_digests(rows, ["k"], "v", buffer=500)
    whole = merge_digests(parts, ["k0"], "part", fan_in=2, levels=4)
    assert {r[0]: r[1] for r in whole.groupBy("k0").sum("weight").collect()}["hot"] == 20_000


def test_days_combine(rows):
    days = merge_digests(partial_digests(rows, ["k", "day"], "v"), ["k0", "k1"], "part")
    merged = merge_digests(days, ["k0"])
    assert {r.k0: r.n for r in merged.groupBy("k0").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "n").collect()}["hot"] == 20_000
    found = certify(rows, ["k"], "v", quantiles(merged, ["k0"], (0.1, 0.5, 0.9)).withColumnRenamed("k0", "k"))
    assert max(r.rank_error - 1 / r.n for r in found.collect()) < 0.05


def test_salted_path_is_the_same(rows):
    found = quantiles(merge_digests(partial_digests(rows, ["k"], "v"), ["k0"], "part"), ["k0"], (0.5, 0.9)).withColumnRenamed("k0", "k")
    a = certify(rows, ["k"], "v", found)
    b = certify(rows, ["k"], "v", found, broadcast_bytes=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_empty(rows):
    assert grouped_percentiles(rows.limit(0), ["k"], "v").count() == 0
