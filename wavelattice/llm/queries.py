"""Queries of the text problems (p1, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.llm.digests import certify, error_bound, grouped_percentiles, merge_digests, partial_digests, quantiles
from wavelattice.llm.leaks import find_leaks
from wavelattice.llm.packing import fill_report, pack_documents
from wavelattice.llm.reading import english_label, reading_bands, reading_measures
from wavelattice.session import read_table

QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p1_meter_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Certified percentiles of consumption_kwh per meter."""
    return grouped_percentiles(read_table(spark, d, "spain_smart_meter_data"), ["meter_id"], "consumption_kwh", QS)


def p1_meter_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Certified percentiles per meter and day of timestamp."""
    days = read_table(spark, d, "spain_smart_meter_data").withColumn("day", F.to_date("timestamp"))
    return grouped_percentiles(days, ["meter_id", "day"], "consumption_kwh", QS)


def p1_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per meter out of the digests of its days, certified against the readings."""
    rows = read_table(spark, d, "spain_smart_meter_data").where(F.col("timestamp").isNotNull())
    days = merge_digests(partial_digests(rows.withColumn("day", F.to_date("timestamp")), ["meter_id", "day"], "consumption_kwh"), ["k0", "k1"], "part")
    merged = merge_digests(days.withColumn("part", F.unix_date("k1")), ["k0"], "part")
    found = quantiles(merged, ["k0"], QS).withColumnRenamed("k0", "meter_id")
    return certify(rows, ["meter_id"], "consumption_kwh", found).withColumn("bound", F.lit(error_bound(200.0, 6)))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of every capacity."""
    return pack_documents(read_table(spark, d, "documents"), read_table(spark, d, "pack_capacities"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p7_packed(spark, d), read_table(spark, d, "pack_capacities"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and the documents that their passage leaked into."""
    return find_leaks(read_table(spark, d, "eval_items"), read_table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading band of every English page with an article."""
    return reading_bands(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels")).select("doc_id", "band")


def p9_median_bands(spark: SparkSession, d: str) -> DataFrame:
    """The same from the median of the grade formulas alone."""
    return reading_bands(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"), names=("grade",)).select("doc_id", "band", "grade")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    """Readability measures and median grade of every English page."""
    docs = read_table(spark, d, "documents")
    return reading_measures(docs.where(english_label(F.col("lang")))).where("n_words > 0")


QUERIES = {f.__name__: f for f in (p1_meter_percentiles, p1_meter_day_percentiles, p1_from_days, p7_packed, p7_fill, p8_found, p9_found, p9_median_bands, p9_measures)}

ORACLES: dict[str, str] = {}
