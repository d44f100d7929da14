import datetime as dt

import pytest
from pyspark.sql import functions as F

from wavelattice.operators.timestamps import estimate_zones, normalise_times, read_times

UTC = dt.timezone.utc


def us(*a, micro=0):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


# Raw time, declared zone, month first, instant in UTC.
CASES = [
    ("18 avr. 2020 21h20", "Africa/Casablanca", False, us(2020, 4, 18, 20, 20)),
    ("24 may. 2020, 4:20:37", "Europe/Madrid", False, us(2020, 5, 24, 2, 20, 37)),
    ("07-Aug-2021 20:20", "Asia/Kolkata", False, us(2021, 8, 7, 14, 50)),
    ("Thu, 18 Feb 2021 21:10:25 +0000", "Asia/Kolkata", False, us(2021, 2, 18, 21, 10, 25)),
    ("Mon, 07 Oct 2019 09:40:45 GMT", "Asia/Kolkata", False, us(2019, 10, 7, 9, 40, 45)),
    ("Apr 9, 2020 17:30:00", "America/New_York", True, us(2020, 4, 9, 21, 30)),
    ("4/9/2020 3:30:00 PM", "America/New_York", True, us(2020, 4, 9, 19, 30)),
    ("4/9/2020 12:30:00 AM", "America/New_York", True, us(2020, 4, 9, 4, 30)),
    ("04/03/2021 15:20", "UTC", False, us(2021, 3, 4, 15, 20)),
    ("29/10/19 06:30:33", "UTC", False, us(2019, 10, 29, 6, 30, 33)),
    ("24.5.2020 08:30:10", "UTC", False, us(2020, 5, 24, 8, 30, 10)),
    ("2019-10-29 06:40:13,822", "UTC", False, us(2019, 10, 29, 6, 40, 13, micro=822_000)),
    ("2019-10-29 16:10:39.289413+00:00", "Europe/Madrid", False, us(2019, 10, 29, 16, 10, 39, micro=289_413)),
    ("2021-10-31T04:30:00+01:00[Europe/Madrid]", "UTC", False, us(2021, 10, 31, 3, 30)),
    ("2021-10-31 00:30:00 CEST", "UTC", False, us(2021, 10, 30, 22, 30)),
    ("2020-04-10 05:50:00 -0400", "UTC", False, us(2020, 4, 10, 9, 50)),
    ("20211028T0340", "UTC", False, us(2021, 10, 28, 3, 40)),
    ("20211027185026", "UTC", False, us(2021, 10, 27, 18, 50, 26)),
    ("1635439248", "Asia/Kolkata", False, 1635439248_000_000),
    ("1574398248381", "UTC", False, 1574398248_381_000),
    ("1576874400000000", "UTC", False, 1576874400_000_000),
    ("2021-10-27", "America/New_York", False, us(2021, 10, 27, 4)),
    ("07/08/2021 24:00", "UTC", False, us(2021, 8, 8)),
    ('\t" 2020-01-02 03:04  "', "UTC", False, us(2020, 1, 2, 3, 4)),
    ("2021-10-31 02:30:00", "Europe/Madrid", False, us(2021, 10, 31, 0, 30)),  # occurs twice: the first
    ("2021-03-28 02:30:00", "Europe/Madrid", False, us(2021, 3, 28, 1, 30)),  # skipped: the offset before
]
NO_TIMES = ["pending", "--", "n/a", "", "   ", None, "0000-00-00 00:00:00", "31/11/2020 12:10", "2020-13-05 08:20", "2020-02-30 10:00:00", "2020-01-01 25:00", "2020-01-01 10:61", "12", "x" * 5000]


def test_layouts(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)] + [(1000 + i, t, "UTC", False, None) for i, t in enumerate(NO_TIMES)]
    df = spark.createDataFrame(rows, "row_id long, raw string, zone string, mf boolean, wanted long").withColumn("__t", F.lit("clash"))
    got = {r.row_id: r.utc_us for r in normalise_times(df, "row_id", F.col("raw"), F.col("zone"), F.col("mf")).collect()}
    for i, c in enumerate(CASES):
        assert got.get(i) == c[3], c
    assert len(got) == len(CASES)


def test_zone_estimates(spark):
    rows = []
    for k in range(400):
        at = dt.datetime(2021, 3, 1, tzinfo=UTC) + dt.timedelta(minutes=10 * k)
        local = at + dt.timedelta(hours=5, minutes=30)
        rows.append(("x", k, at.strftime("%Y-%m-%dT%H:%M:%SZ") if k % 5 == 0 else local.strftime("%Y-%m-%d %H:%M:%S")))
    df = spark.createDataFrame([*rows, (None, 1, "2020-01-01 00:00")], "feed string, o long, raw string")
    e = estimate_zones(read_times(df, F.col("raw"), F.lit(False)), "feed", "o")
    (row,) = e.collect()
    assert (row.feed, row.zone, row.n_violations) == ("x", "Asia/Kolkata", 0)
    us_ = normalise_times(df.withColumn("d", F.lit(None).cast("string")), "o", F.col("raw"), F.col("d"), F.lit(False), e, "feed")
    assert us_.where("o = 7").first().utc_us == us(2021, 3, 1, 1, 10)


def test_declared_zones(spark):
    rows = []
    for k in range(400):
        at = dt.datetime(2021, 3, 1, tzinfo=UTC) + dt.timedelta(minutes=10 * k)
        local = at + dt.timedelta(hours=1)
        for feed in ("right", "wrong"):
            rows.append((feed, k, "Africa/Algiers" if feed == "right" else "Asia/Tokyo", at.strftime("%Y-%m-%dT%H:%M:%SZ") if k % 100 == 50 else local.strftime("%Y-%m-%d %H:%M:%S")))
    df = spark.createDataFrame(rows, "feed string, o long, tz string, raw string")
    read = read_times(df, F.col("raw"), F.lit(False))
    got = {r.feed: r for r in estimate_zones(read, "feed", "o", (), "tz", block=7).collect()}  # marks are blocks apart
    assert (got["right"].used, got["right"].zone, got["right"].declared_violations) == ("Africa/Algiers", "Africa/Algiers", 0)
    assert got["wrong"].used == got["wrong"].zone != "Asia/Tokyo" and got["wrong"].n_compared == 396
    whole = {r.feed: r for r in estimate_zones(read, "feed", "o", (), "tz").collect()}
    assert got == whole


def test_empty(spark):
    none = spark.createDataFrame([], "row_id long, raw string")
    assert normalise_times(none, "row_id", F.col("raw"), F.lit("UTC"), F.lit(False)).count() == 0


@pytest.mark.parametrize("hour", [0, 1, 2, 3])
def test_matches_zone_database(spark, hour):
    from zoneinfo import ZoneInfo

    df = spark.createDataFrame([(1, f"2020-10-25 0{hour}:15:00")], "row_id long, raw string")
    wanted = int(dt.datetime(2020, 10, 25, hour, 15, tzinfo=ZoneInfo("Europe/Madrid")).timestamp()) * 1_000_000
    assert normalise_times(df, "row_id", F.col("raw"), F.lit("Europe/Madrid"), F.lit(False)).first().utc_us == wanted
