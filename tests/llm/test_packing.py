import random

import numpy as np
import pytest

from wavelattice.llm.packing import combinations, fill_report, nnls, pack_documents, plan_packing


def test_combinations_and_nnls():
    assert sorted(combinations(4, 3)) == sorted([(4,), (3, 1), (2, 2), (2, 1, 1)])
    rng = np.random.default_rng(2)
    a = rng.random((8, 12))
    x = np.zeros(12)
    x[[1, 5, 7]] = [1.0, 2.0, 0.5]
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


@pytest.mark.parametrize("capacity", [1, 7, 100, 512, 2048])
def test_plans_hold_every_item(capacity):
    rng = random.Random(capacity)
    counts = {}
    for _ in range(3_000):
        k = min(capacity, max(1, int(rng.lognormvariate(4, 1))))
        counts[k] = counts.get(k, 0) + 1
    plan = plan_packing(counts, capacity)
    held = {}
    for key, n in plan:
        assert sum(key) <= capacity and n > 0
        for k in key:
            held[k] = held.get(k, 0) + n
    assert held == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in plan) <= 1.03 * total / capacity + 2 or capacity <= 7
    assert plan_packing({}, capacity) == []


def test_huge_counts_stay_small():
    plan = plan_packing({k: 10**9 + k for k in range(1, 500)}, 512)
    assert len(plan) < 20_000 and sum(n for _, n in plan) >= sum(k * (10**9 + k) for k in range(1, 500)) / 512


def test_documents(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(1, 300), 1, 2) for i in range(300)] + [(1000, None, 1, 2), (1001, "", 1, 2), (1002, "long " * 9_000, 1, 2), (5, "twice", 1, 2), (None, "no id", 1, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, piece int, container_id int")
    caps = spark.createDataFrame([(1, 256), (2, 1024), (3, None), (4, 0)], "capacity_id long, max_tokens long")
    rows = pack_documents(df, caps).collect()
    assert {r.capacity_id for r in rows} == {1, 2}
    load, tokens = {}, {}
    for r in rows:
        if r.container_id is None:
            assert r.n_tokens == 0 and r.doc_id in (1000, 1001)
            continue
        load[r.capacity_id, r.container_id] = load.get((r.capacity_id, r.container_id), 0) + r.n_tokens
        tokens[r.capacity_id] = tokens.get(r.capacity_id, 0) + r.n_tokens
    assert all(v <= (256 if c == 1 else 1024) for (c, _), v in load.items()) and tokens[1] == tokens[2]
    split = [r for r in rows if r.doc_id == 1002 and r.capacity_id == 2]
    assert len(split) == 9 and sum(r.n_tokens == 1024 for r in split) == 8
    assert all(r.piece == 0 for r in rows if r.capacity_id == 2 and r.doc_id < 300)
    filled = {r.capacity_id: r for r in fill_report(pack_documents(df, caps), caps).collect()}
    assert filled[1].containers <= filled[1].least_containers * 1.03 + 1
    assert pack_documents(df.limit(0), caps).count() == 0 and pack_documents(df, caps.limit(0)).count() == 0
