import datetime as dt
import math
import random

from wavelattice.operators.anomalies import implausible_readings

SCHEMA = "id long, m string, ts timestamp, v double, shard int, y double"


def make(spark, series):
    rows, i = [], 0
    for m, vs in series.items():
        for k, v in enumerate(vs):
            i += 1
            rows.append((i, m, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=30 * k), v, 1, 1.0))
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r for r in rows}


def found(df, **kw):
    return {r.reading_id: set(r.why) for r in implausible_readings(df, "id", "m", "ts", "v", **kw).collect()}


def test_kinds(spark):
    rng = random.Random(5)
    day = [1 + math.sin(2 * math.pi * k / 48) ** 2 for k in range(48)]
    normal = [day[k % 48] * rng.uniform(0.8, 1.25) for k in range(1500)]
    spiky, stuck, peaks, dirty = normal[:], normal[:], normal[:], normal[:]
    spiky[700], spiky[900] = 40.0, 0.004
    stuck[400:440] = [1.234] * 40  # crosses a shard's border at 336
    stuck[320:350] = [1.5] * 30
    for k in range(20, 1500, 60):
        peaks[k] = 12.0 * rng.uniform(0.7, 1.4)
    dirty[10], dirty[11], dirty[12] = -0.5, 65535.0, float("inf")
    dirty[13], dirty[14] = None, float("nan")
    idle = [0.0] * 1500
    df, rows = make(spark, {"spiky": spiky, "stuck": stuck, "peaks": peaks, "dirty": dirty, "idle": idle, "const": [2.0] * 300, "short": [1.0, 900.0, 1.1]})
    got = {}
    for i, why in found(df).items():
        got.setdefault(rows[i][1], {})[round(rows[i][3], 4)] = why
    assert got["spiky"] == {40.0: {"spike"}, 0.004: {"spike"}}
    assert set(got["stuck"]) == {1.234, 1.5}
    assert set(got["dirty"]) == {-0.5, 65535.0, float("inf")}
    assert not {"peaks", "idle", "const", "short"} & set(got)
    assert sum(1 for i in found(df) if rows[i][1] == "stuck") == 70


def test_second_deliveries_and_shards(spark):
    rng = random.Random(1)
    v = [rng.uniform(1, 2) for _ in range(600)]
    v[300] = 70.0
    df, _ = make(spark, {"a": v})
    twice = df.unionByName(df.where("v > 60").selectExpr("id + 10000 id", "m", "ts", "v", "shard", "y"))
    assert set(found(twice)) == {301, 10301}
    assert set(found(twice, shard_hours=24)) == set(found(twice, shard_hours=100_000)) == set(found(twice, broadcast_bytes=-1))


def test_spikes_of_a_dense_meter(spark):
    """Scattered spikes on every day are spikes at any density; peaks at one hour of every day are normal."""
    rng = random.Random(7)
    a_day, days = 3000, 12
    start, step = dt.datetime(2020, 1, 1), dt.timedelta(days=1) / a_day
    values = [rng.uniform(1, 2) for _ in range(a_day * days)]
    spiky, daily = values[:], values[:]
    spikes = {a_day * d + k for d in range(days) for k in rng.sample(range(a_day), 4)}
    for k in spikes:
        spiky[k] = rng.uniform(50, 90)
    for d in range(days):
        for k in range(2260, 2270):  # about 18:05
            daily[a_day * d + k] = rng.uniform(15, 25)
    rows = [(i + len(values) * j, m, start + step * i, v, 1, 1.0) for j, (m, vs) in enumerate({"spiky": spiky, "daily": daily}.items()) for i, v in enumerate(vs)]
    assert set(found(spark.createDataFrame(rows, SCHEMA))) == spikes


def test_spikes_above_recurring_peaks(spark):
    """A meter whose peaks recur keeps the spikes that lie far above them."""
    rng = random.Random(11)
    values = [rng.uniform(1, 2) for _ in range(1500)]
    for k in range(20, 1500, 60):
        values[k] = rng.uniform(9, 15)
    values[333], values[777], values[1111] = 300.0, 400.0, 0.004
    df, rows = make(spark, {"both": values})
    assert {rows[i][3] for i in found(df)} == {300.0, 400.0, 0.004}


def test_all_but_one_reading_wide(spark):
    """Two of three readings far from the third leave the outlier test no degree of freedom; that is no error."""
    rows = [(i, "three", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m), v, 1, 1.0) for i, (m, v) in enumerate([(0, 1.0), (1, 100.0), (120, 10.0)])]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {}


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
