import datetime as dt

import pytest

from wavelattice.operators.grid import regular_grid
from wavelattice.operators.rolling import rolling_totals

SCHEMA = "rid long, m string, ts timestamp, v double, arrived timestamp, src string, us long, step int"


def T(s):
    return dt.datetime.fromisoformat(s)


ROWS = [
    (1, "a", T("2020-01-01 00:10:00"), 1.0, T("2020-01-01 00:11:00")),
    (2, "a", T("2020-01-01 00:40:00"), 3.0, T("2020-01-01 00:41:00")),
    (3, "a", T("2020-01-01 00:40:00"), 5.0, T("2020-01-02 00:00:00")),  # the same reading, corrected
    (4, "a", T("2020-01-01 03:00:00"), 8.0, T("2020-01-01 03:01:00")),
    (5, "a", T("2020-01-20 00:00:00"), 2.0, None),  # beyond an empty shard
    (6, "a", T("2020-01-01 01:30:00"), float("nan"), T("2020-01-01 01:31:00")),
    (7, "a", T("2020-01-01 02:30:00"), None, T("2020-01-01 02:31:00")),
    (8, "a", None, 4.0, None),
    (9, None, T("2020-01-01 02:30:00"), 4.0, None),
    (10, "dead", T("2020-01-01 02:30:00"), None, None),
    (11, "once", T("2020-01-05 12:00:00"), 7.0, None),
    (11, "once", T("2020-01-05 12:00:00"), 7.0, None),  # a repeated row
]


@pytest.fixture
def readings(spark):
    return spark.createDataFrame([(*r, "clash", 0, 0) for r in ROWS], SCHEMA)


def test_grid(readings):
    out = {(r.source, r.step_start): r for r in regular_grid(readings, "m", "ts", "v", ["arrived", "rid"]).collect()}
    base = int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert out["a", base].value == 3.0 and out["a", base].n_readings == 2 and out["a", base].status == "observed"
    assert out["a", base + 3600].status == "filled" and out["a", base + 3600].value == pytest.approx(3 + 5 / 3)
    assert out["a", base + 4 * 3600].status == "missing" and out["a", base + 4 * 3600].value is None
    assert sum(k[0] == "a" for k in out) == 19 * 24 + 1
    assert sum(k[0] == "once" for k in out) == 1 and not any(k[0] in (None, "dead") for k in out)


def test_grid_shards_do_not_matter(readings):
    a = regular_grid(readings, "m", "ts", "v", ["arrived", "rid"], shard_steps=2)
    b = regular_grid(readings, "m", "ts", "v", ["arrived", "rid"], shard_steps=10_000)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_rolling(readings):
    out = {(r.source, r.day, r.window_days): r for r in rolling_totals(readings, "m", "ts", "v", ["arrived", "rid"]).collect()}
    day = (dt.date(2020, 1, 1) - dt.date(1970, 1, 1)).days
    assert out["a", day, 7].total == 14.0 and out["a", day, 7].n_readings == 3 and out["a", day, 7].mean_per_day == 2.0
    assert out["a", day + 7, 7].n_readings == 0 and out["a", day + 7, 30].n_readings == 3
    assert out["a", day + 19, 30].total == 16.0 and out["once", day + 4, 7].n_readings == 1
    assert len([k for k in out if k[0] == "a"]) == 40


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert regular_grid(none, "m", "ts", "v").count() == 0
    assert rolling_totals(none, "m", "ts", "v").count() == 0
