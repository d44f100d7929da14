"""Registered queries read the whole of the users' series."""

import datetime as dt

import numpy as np
import pytest
from wavelattice.operators import distances
from wavelattice.plans import registry


@pytest.fixture
def folder(spark, tmp_path):
    """Two users' events: a convex curve, in which every point sees every other, and its reverse in part."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "u1", start + dt.timedelta(days=i), "a", float((i - 30) ** 2)) for i in range(60)]
    rows += [(100 + i, "u2", start + dt.timedelta(days=i), "b", float(i if i < 45 else -50 * i)) for i in range(60)]
    rows += [(200 + i, "u3", start + dt.timedelta(days=i), "b", float(i * i)) for i in range(30, 38)]
    spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_natural_visibility_has_no_horizon(spark, folder):
    q = lambda name: [r for r in registry.QUERIES[name](spark, folder).collect() if r.series_id == "u1"]
    assert {(r.src, r.dst) for r in q("v8_nvg_edges")} == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    assert {r.mean_degree for r in q("z2_degree_profile")} == {59.0}
    assert {r.n_edges for r in q("z4_method_comparison") if r.method == "nvg"} == {1770}
    assert max(r.dst - r.src for r in q("v9_nvg_limited_edges")) == 20


def test_correlations_of_whole_series(spark, folder):
    """All users, short ones too, over all days that both have."""
    got = {(r.i, r.j): r.dist for r in registry.QUERIES["d1_correlation_users"](spark, folder).collect()}
    rows = spark.read.parquet(folder + "/events.parquet").toPandas()
    wide = rows.pivot(index="ts", columns="user_id", values="value")
    assert set(got) == {("u1", "u2"), ("u1", "u3"), ("u2", "u3")}
    for (i, j), v in got.items():
        both = wide[[i, j]].dropna()
        assert v == pytest.approx(1 - abs(np.corrcoef(both[i], both[j])[0, 1]), abs=2e-6)


def test_pairs_leave_in_batches_of_few_blocks(spark, monkeypatch):
    """Blocks don't grow in number with the series, pairs leave a task in bounded batches, and users who share no day make no pair (as in SQL)."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 12))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[88, 6:], x[89, :6], x[87] = np.nan, np.nan, 2.5
    panel = spark.createDataFrame([(k, t, float(v)) for k, row in enumerate(x) for t, v in enumerate(row)], "series_id long, t long, value double")
    monkeypatch.setattr(distances, "TILE_PAIRS", 7)
    out = distances.pair_distances(panel, "overlap_correlation", block=2, decimals=6)
    got = {(r.i, r.j): r.dist for r in out.collect()}
    assert out.select("i", "j").count() == len(got) and (88, 89) not in got
    sent = distances.pair_tiles(distances.pack(panel), lambda left, right: lambda lo, hi: np.full((hi - lo, len(right)), float(len(left) + len(right))), least=2)
    assert sent.count() == 90 * 89 // 2 and sent.agg({"dist": "max"}).first()[0] >= 10  # 45 blocks of two would have at most a few
    for i in range(90):
        for j in range(i + 1, 90):
            both = ~(np.isnan(x[i]) | np.isnan(x[j]))
            want = 1 - abs(np.corrcoef(x[i][both], x[j][both])[0, 1]) if both.sum() > 1 and x[i][both].std() > 0 and x[j][both].std() > 0 else None
            assert ((i, j) in got) == (both.sum() > 0)
            if both.sum():
                assert got[i, j] is None if want is None else got[i, j] == pytest.approx(want, abs=2e-6)
