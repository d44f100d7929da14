import datetime as dt
import random

from pyspark.sql import functions as F

from wavelattice.operators.events import detect_events
from wavelattice.operators.graph import _core_rounds, components, core_numbers, nodes_of, simple_edges
from wavelattice.operators.series import keep_long, number_points
from wavelattice.operators.visibility import hvg_edges, nvg_edges


def brute_cores(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    while near:
        u = min(near, key=lambda i: (len(near[i]), i))
        k = max(k, len(near[u]))
        core[u] = k
        for v in near.pop(u):
            near[v].discard(u)
    return core


def test_core_numbers_of_a_long_ramp(points):
    p = points({"ramp": range(1500), "flat": [1], "zigzag": [0, 3, 1, 2, 0, 5, 4, 4, 2, 6] * 3})
    e = hvg_edges(p)
    got = {(r.series_id, r.node): r.core for r in core_numbers(nodes_of(p), e).collect()}
    assert {got["ramp", i] for i in range(1500)} == {1} and got["flat", 0] == 0
    own = [(r.src, r.dst) for r in e.where("series_id = 'zigzag'").collect()]
    assert {i: got["zigzag", i] for i in range(30)} == brute_cores(30, own)


def test_core_numbers_by_rounds(spark):
    rng = random.Random(4)
    own = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(240)) if a != b} | {(i, i + 1) for i in range(60, 72)}
    e = spark.createDataFrame([("g", a, b) for a, b in own], "series_id string, src long, dst long")
    nodes = spark.createDataFrame([("g", i) for i in range(95)], "series_id string, node long")
    want = brute_cores(95, own)
    assert {r.node: r.core for r in core_numbers(nodes, e).collect()} == want
    assert {r.node: r.core for r in core_numbers(nodes, e, most_local=0).collect()} == want
    assert {r.node: r.core for r in _core_rounds(simple_edges(e)).collect()} == {k: v for k, v in want.items() if v}


def test_components_of_a_long_path(spark):
    order = list(range(90))
    random.Random(2).shuffle(order)
    e = spark.createDataFrame([("g", a, b) for a, b in zip(order, order[1:])], "series_id string, src long, dst long")
    nodes = spark.createDataFrame([("g", i) for i in range(91)], "series_id string, node long")
    got = {r.node: r.component for r in components(nodes, e).collect()}
    assert {got[i] for i in range(90)} == {0} and got[90] == 90


def test_numbering_by_ranges_is_the_same(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(seconds=rng.randrange(5_000)), i, float(i)) for i in range(3_000)]
    rows += [("hot", None, -1, 1.0), ("hot", start, -2, float("nan")), ("cold", start, 1, 2.0), ("cold", start, 0, None), ("same", start, 5, 1.0), ("same", start, 4, 2.0), (None, start, 1, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, k int, value double")
    for order in (("ts", "k"), ("k", "ts")):
        whole = sorted(map(tuple, number_points(df, order=order).collect()))
        assert sorted(map(tuple, number_points(df, order=order, shard_rows=100).collect())) == whole
    text = df.withColumn("name", F.format_string("%05d", "k"))
    assert number_points(text, order=("name",), shard_rows=100).count() == len(whole)
    assert number_points(df.limit(0), shard_rows=1).count() == 0


def test_default_horizon(points):
    x = [((i * 7919) % 101) / 7 for i in range(400)]
    p = points({"long": x, "short": x[:50]})
    got = {(r.series_id, r.src, r.dst) for r in nvg_edges(p, long_series=100, long_limit=30, shard_points=64).collect()}
    want = set()
    for name, v, reach in (("long", x, 30), ("short", x[:50], 50)):
        for i in range(len(v)):
            top = float("-inf")
            for j in range(i + 1, min(len(v), i + reach + 1)):
                s = (v[j] - v[i]) / (j - i)
                if s >= top:
                    want.add((name, i, j))
                top = max(top, s)
    assert got == want


def test_events_and_long_series(points):
    p = points({"a": [0, 0, 9, 0, 0, 0, 8, 0], "b": [1, 1, 1]})
    assert {(r.series_id, r.event_t) for r in detect_events(p).collect()} == {("a", 2), ("a", 6)}
    assert {r.series_id for r in keep_long(p, 3, varying=True).collect()} == {"a"} and keep_long(p, 4).count() == 8
