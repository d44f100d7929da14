import datetime as dt

from wavelattice.llm.queries import p1_meter_day_percentiles


def test_days_are_certified(spark, tmp_path):
    rows = [(m, dt.datetime(2024, 1, 1 + k // 40, k % 24), float((k * 37) % 101)) for m in ("a", "b") for k in range(80)] + [(None, dt.datetime(2024, 1, 1), 1.0), ("a", None, 1.0), ("a", dt.datetime(2024, 1, 1), None)]
    spark.createDataFrame(rows, "meter_id string, timestamp timestamp, consumption_kwh double").write.parquet(str(tmp_path / "spain_smart_meter_data.parquet"))
    got = p1_meter_day_percentiles(spark, str(tmp_path)).collect()
    assert len(got) == 2 * 2 * 7
    for r in got:
        own = [v for m, t, v in rows if m == r.meter_id and t and t.date() == r.day and v is not None]
        assert (r.n, r.below, r.upto) == (len(own), sum(v < r.estimate for v in own), sum(v <= r.estimate for v in own))
        assert abs(r.rank_error - max(r.below / r.n - r.q, r.q - r.upto / r.n, 0)) < 1e-12
