"""Written times of mixed layout, precision and zone to instants in UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.functions.timeparse import epoch_micros, parts, split_time, tidy

#: Offset histories tried for feeds that state no zone.
CANDIDATE_ZONES = (
    "UTC", "Europe/London", "Europe/Madrid", "Atlantic/Canary", "Europe/Athens", "Africa/Casablanca", "Africa/Algiers",
    "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Asia/Kolkata", "Asia/Tokyo", "Australia/Sydney",
)


def _instant(p: str, zone: Column) -> Column:
    """Epoch microseconds of the parts ``p``, in their own zone or else ``zone``; null where they denote no time.

    A local time that occurs twice is its first occurrence, and a skipped one is read with
    the offset that held before the skip: both are the rules of ``try_make_timestamp``.
    24:00:00 is the end of its day.
    """
    g = lambda k: F.col(f"{p}.{k}")
    end = (g("h") == 24) & (g("mi") == 0) & (g("s") == 0)
    own = F.coalesce(F.when(g("offset_min").isNotNull(), F.lit("UTC")), g("zone"), zone)
    hour, minute, second = F.when(end, 23).otherwise(g("h")), F.when(end, 59).otherwise(g("mi")), F.when(end, F.lit(59).cast("decimal(16,6)")).otherwise(g("s"))
    made = F.unix_micros(F.try_make_timestamp(g("y"), g("mo"), g("d"), hour, minute, second, own))
    us = made + F.when(end, 1_000_000).otherwise(0) - F.coalesce(g("offset_min"), F.lit(0)).cast("long") * 60_000_000
    return F.when((hour <= 23) & (second < 60), us)


def read_times(df: DataFrame, text: Column, month_first: Column) -> DataFrame:
    """Adds ``__epoch`` (instant of a bare epoch number), ``__p`` (written parts, see ``parts``) and ``__marked``.

    ``__marked`` is the instant where the value itself tells its zone: an epoch, a written
    offset or abbreviation, or a bracketed zone name.  Null where it doesn't or is no time.
    The one-element explodes keep the optimizer from copying the long parse into each use.
    """
    cut = df.withColumn("__t", tidy(text)).withColumn("__cut", F.explode(F.array(split_time(F.col("__t"), month_first))))
    read = cut.withColumn("__p", F.explode(F.array(parts(F.col("__cut"))))).withColumn("__epoch", epoch_micros(F.col("__t"))).drop("__cut")
    return read.withColumn("__marked", F.coalesce("__epoch", _instant("__p", F.lit(None).cast("string"))))


def estimate_zones(
    df: DataFrame,
    feed: str,
    order: str,
    stream: Sequence[str] = (),
    declared: str | None = None,
    candidates: Sequence[str] = CANDIDATE_ZONES,
    slack_us: int = 3_600_000_000 // 2,
    tolerance: float = 0.25,
    block: int = 100_000,
) -> DataFrame:
    """The offset history of each feed that its sequence order supports best, and the one to be used.

    ``df`` comes from ``read_times`` and has ``feed``, ``order`` (arrival order) and
    ``stream`` columns.  Every row without zone information is read in each candidate
    zone, the ``declared`` one of its feed among them, and held against the nearest zone-marked rows before and
    after it in its stream: it violates the order when it lies more than ``slack_us`` before the earlier or after
    the later.  The candidate with least violations is the estimate, ties go to the declared zone and then by place in
    ``candidates``.  A declaration stands (``used``) unless more than ``tolerance`` of the compared rows contradict it
    and the estimate halves that.  Streams are cut into blocks of ``block`` order numbers, so that no task gets a whole feed;
    the nearest marks beyond a block come to it by a scan of block summaries.  Rows times candidates stays linear.

    Output: ``feed, zone, used, declared, n_compared bigint, n_violations bigint, declared_violations bigint``; a feed whose
    rows can't be compared has no row, and one without a declaration uses its estimate.
    """
    keyed = df.where(F.col(feed).isNotNull()).select(
        F.col(feed).alias("feed"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in stream]).alias("k"),
        F.floor(F.col(order) / block).alias("b"),
        F.col(order).alias("o"),
        F.col("__marked").alias("m"),
        F.col("__p").alias("p"),
        (F.col(declared) if declared else F.lit(None).cast("string")).alias("d"),
    )
    before = Window.partitionBy("feed", "k", "b").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("feed", "k", "b").orderBy("o").rowsBetween(1, Window.unboundedFollowing)
    near = keyed.withColumn("lo", F.last("m", ignorenulls=True).over(before)).withColumn("hi", F.first("m", ignorenulls=True).over(after))
    marked = F.when(F.col("m").isNotNull(), F.col("o"))
    blocks = keyed.groupBy("feed", "k", "b").agg(F.min_by("m", marked).alias("first"), F.max_by("m", marked).alias("last"))
    scan = Window.partitionBy("feed", "k").orderBy("b")
    carries = blocks.select(
        "feed", "k", "b",
        F.last("last", ignorenulls=True).over(scan.rowsBetween(Window.unboundedPreceding, -1)).alias("lo0"),
        F.first("first", ignorenulls=True).over(scan.rowsBetween(1, Window.unboundedFollowing)).alias("hi0"),
    )
    near = near.join(carries, ["feed", "k", "b"], "left").withColumns({"lo": F.coalesce("lo", "lo0"), "hi": F.coalesce("hi", "hi0")})
    local = near.where(F.col("m").isNull() & F.col("p").isNotNull() & (F.col("lo").isNotNull() | F.col("hi").isNotNull()))
    zones = F.concat(F.array(F.col("d")), F.array(*[F.lit(z) for z in candidates]))
    tried = local.select("feed", "d", "lo", "hi", "p", F.posexplode(zones).alias("rank", "zone")).where(F.col("zone").isNotNull())
    tried = tried.withColumn("us", _instant("p", F.col("zone"))).where(F.col("us").isNotNull())
    bad = F.coalesce(F.col("us") < F.col("lo") - slack_us, F.lit(False)) | F.coalesce(F.col("us") > F.col("hi") + slack_us, F.lit(False))
    scored = tried.groupBy("feed", "rank", "zone").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("v"))
    best = scored.groupBy("feed").agg(F.min(F.struct("v", "rank", "zone", "n")).alias("b"), F.max(F.when(F.col("rank") == 0, F.struct("zone", "v", "n"))).alias("d"))
    refuted = (F.col("d.v") > tolerance * F.col("d.n")) & (F.col("b.v") * 2 <= F.col("d.v"))
    return best.select(
        "feed",
        F.col("b.zone").alias("zone"),
        F.when(F.col("d").isNotNull() & ~refuted, F.col("d.zone")).otherwise(F.col("b.zone")).alias("used"),
        F.col("d.zone").alias("declared"),
        F.col("b.n").alias("n_compared"),
        F.col("b.v").alias("n_violations"),
        F.col("d.v").alias("declared_violations"),
    )


def instants(read: DataFrame, row_id: str, declared: str, estimated: DataFrame | None = None, feed: str | None = None) -> DataFrame:
    """``row_id, utc_us bigint`` of the rows of ``read_times`` whose value denotes an instant.

    Zone information in the value wins; then the offset history ``used`` for ``feed`` in ``estimated`` (see
    ``estimate_zones``), where that is given and has one; then the one in column ``declared``.
    """
    zone = F.col(declared)
    if estimated is not None:
        read = read.withColumnRenamed(feed, "__feed").join(estimated.select(F.col("feed").alias("__feed"), F.col("used").alias("__guess")), "__feed", "left")
        zone = F.coalesce(F.col("__guess"), zone)
    us = F.coalesce("__epoch", _instant("__p", zone))
    return read.select(F.col(row_id), F.explode(F.array(us)).alias("utc_us")).where(F.col("utc_us").isNotNull())


def normalise_times(df: DataFrame, row_id: str, text: Column, declared: Column, month_first: Column, estimated: DataFrame | None = None, feed: str | None = None) -> DataFrame:
    """``instants`` of a table: null, empty and other values that are no time give no row; repeated rows stay repeated."""
    kept = df.select(F.col(row_id).alias("__id"), (F.col(feed) if feed else F.lit(None).cast("string")).alias("__name"), declared.alias("__zone"), text.alias("__raw"), month_first.alias("__mf"))
    out = instants(read_times(kept, F.col("__raw"), F.col("__mf")), "__id", "__zone", estimated, "__name")
    return out.withColumnRenamed("__id", row_id)
