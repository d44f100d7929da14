"""Joint and cross graphs of two series, comparison of networks and of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelattice.operators.graph import degrees
from wavelattice.operators.recurrence import epsilon_edges, knn_arcs, undirected


def pair_points(points: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``pairs`` (a, b) as points keyed by the pair: ``series_id`` is struct(a, b)."""
    left = points.join(pairs, points["series_id"] == pairs["a"]).select(F.struct("a", "b").alias("series_id"), "t", "value")
    right = points.join(pairs, points["series_id"] == pairs["b"]).select(F.struct("a", "b").alias("series_id"), "t", "value")
    return left, right


def joint_recurrence(x1: DataFrame, x2: DataFrame, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """``series_id, src, dst, weight``: pairs of times recurrent in both series; weight is the mean of both distances."""

    def edges(x: DataFrame) -> DataFrame:
        return epsilon_edges(x, threshold) if threshold is not None else undirected(knn_arcs(x, k or 5))

    a, b = edges(x1).withColumnRenamed("dist", "d1"), edges(x2).withColumnRenamed("dist", "d2")
    return a.join(b, ["series_id", "src", "dst"]).select("series_id", "src", "dst", ((F.col("d1") + F.col("d2")) / 2).alias("weight"))


def cross_visibility(x1: DataFrame, x2: DataFrame, method: str = "hvg", limit: int | None = None) -> DataFrame:
    """``series_id, src, dst``: points i of x1 and j of x2 that see each other; j counts from the length of x1.

    Horizontal: all later points of x1 and all earlier points of x2 are lower than both; such i are the
    right-to-left records of x1 and such j the left-to-right records of x2 only, so just these are
    joined.  Natural: x2 stands after x1 and no point between reaches the line.
    """
    back = Window.partitionBy("series_id").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    front = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    a = x1.withColumn("n1", F.count(F.lit(1)).over(Window.partitionBy("series_id"))).withColumn("ma", F.max("value").over(back))
    b = x2.withColumn("mb", F.max("value").over(front))
    if method == "hvg":
        a, b = a.where("ma is null or ma < value"), b.where("mb is null or mb < value")
        pairs = a.select("series_id", F.col("t").alias("i"), F.col("value").alias("va"), "ma", "n1").join(b.select("series_id", F.col("t").alias("j"), F.col("value").alias("vb"), "mb"), "series_id")
        low = F.least("va", "vb")
        seen = pairs.where((F.col("ma").isNull() | (F.col("ma") < low)) & (F.col("mb").isNull() | (F.col("mb") < low)))
    elif method == "nvg":
        a, b = x1.withColumn("n1", F.count(F.lit(1)).over(Window.partitionBy("series_id"))), x2
        whole = a.select("series_id", "t", "value", "n1", F.lit(1).alias("side"))
        sizes = a.groupBy("series_id").agg(F.first("n1").alias("n1"))
        moved = b.join(sizes, "series_id").select("series_id", (F.col("t") + F.col("n1")).alias("t"), "value", "n1", F.lit(2).alias("side"))
        line = whole.unionByName(moved)
        pairs = line.select("series_id", F.col("t").alias("i"), F.col("value").alias("va"), F.col("side").alias("s1"), "n1").join(line.select("series_id", F.col("t").alias("u"), F.col("value").alias("vb"), F.col("side").alias("s2")), "series_id").where("u > i and s1 = 1")
        slope = (F.col("vb") - F.col("va")) / (F.col("u") - F.col("i"))
        before = Window.partitionBy("series_id", "i").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
        seen = pairs.withColumn("s", slope).withColumn("m", F.max("s").over(before)).where("s2 = 2 and (m is null or s >= m)").withColumn("j", F.col("u") - F.col("n1"))
    else:
        raise ValueError("method must be hvg or nvg")
    if limit is not None:
        seen = seen.where(F.abs(F.col("i") - F.col("j")) <= limit)
    return seen.select("series_id", F.col("i").alias("src"), (F.col("j") + F.col("n1")).alias("dst"))


def coupling_strength(x1: DataFrame, x2: DataFrame, threshold: float) -> DataFrame:
    """Joint rate, its ratio to independence, synchronisation (Pearson of the two matrices) and asymmetry, from counts alone."""
    e1, e2 = epsilon_edges(x1, threshold), epsilon_edges(x2, threshold)

    def count(e: DataFrame, name: str) -> DataFrame:
        return e.groupBy("series_id").agg((2 * F.count(F.lit(1))).cast("double").alias(name))

    n = x1.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    both = e1.join(e2.select("series_id", "src", "dst"), ["series_id", "src", "dst"])
    c = n.join(count(e1, "c1"), "series_id", "left").join(count(e2, "c2"), "series_id", "left").join(count(both, "c12"), "series_id", "left").fillna(0.0, ["c1", "c2", "c12"])
    cells = (F.col("n") * F.col("n")).cast("double")
    r1, r2, r12 = F.col("c1") / cells, F.col("c2") / cells, F.col("c12") / cells
    spread = F.col("c1") * (cells - F.col("c1")) * F.col("c2") * (cells - F.col("c2"))
    sync = F.when(spread > 0, (cells * F.col("c12") - F.col("c1") * F.col("c2")) / F.sqrt(spread)).otherwise(0.0)
    return c.select("series_id", r12.alias("joint_rate"), F.when(r1 * r2 > 0, r12 / (r1 * r2)).otherwise(0.0).alias("coupling"), sync.alias("synchronisation"), F.abs(r1 - r2).alias("asymmetry"))


def compare_networks(nodes1: DataFrame, e1: DataFrame, nodes2: DataFrame, e2: DataFrame) -> DataFrame:
    """Degree correlation, edge overlap (Jaccard), density similarity and their mean for two graphs per series."""
    d1 = degrees(nodes1, e1).select("series_id", "node", F.col("degree").alias("d1"))
    d2 = degrees(nodes2, e2).select("series_id", "node", F.col("degree").alias("d2"))
    corr = d1.join(d2, ["series_id", "node"], "full").fillna(0, ["d1", "d2"]).groupBy("series_id").agg(F.coalesce(F.nanvl(F.corr("d1", "d2"), F.lit(0.0)), F.lit(0.0)).alias("degree_correlation"), F.count(F.lit(1)).alias("n"))
    a, b = (e.select("series_id", "src", "dst", F.lit(1).alias(c)) for e, c in ((e1, "a"), (e2, "b")))
    both = a.join(b, ["series_id", "src", "dst"], "full").groupBy("series_id").agg(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("both"), F.count(F.lit(1)).alias("any"), F.count("a").alias("m1"), F.count("b").alias("m2"))
    out = corr.join(both, "series_id", "left").fillna(0, ["both", "any", "m1", "m2"])
    overlap = F.when(F.col("any") > 0, F.col("both") / F.col("any")).otherwise(0.0)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    density = 1 - F.when(pairs > 0, F.abs(F.col("m1") - F.col("m2")) / pairs).otherwise(0.0)
    return out.select("series_id", "degree_correlation", overlap.alias("edge_overlap"), density.alias("density_similarity"), ((F.col("degree_correlation") + overlap + density) / 3).alias("structural_similarity"))


def compare_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature over all series: mean, sample spread, extremes, range and coefficient of variation."""
    long = features.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])))
    mean, sd = F.avg("v"), F.stddev_samp("v")
    return long.groupBy("feature").agg(mean.alias("mean"), sd.alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("range"), F.when(mean != 0, sd / mean).alias("cv"))


def cluster_features(features: DataFrame, columns: list[str], n_clusters: int | None = None, seed: int = 42) -> DataFrame:
    """``series_id, cluster``: k-means of standardised features (null as 0); by default max(2, sqrt(n / 2)) clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    clean = features.select("series_id", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    k = n_clusters or max(2, int((clean.count() / 2) ** 0.5))
    vectors = VectorAssembler(inputCols=columns, outputCol="raw").transform(clean)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vectors).transform(vectors)
    return KMeans(k=k, seed=seed).fit(scaled).transform(scaled).select("series_id", F.col("prediction").alias("cluster"))


def cross_weights(x1: DataFrame, x2: DataFrame, edges: DataFrame, mode: str = "absdiff") -> DataFrame:
    """Edges of ``cross_visibility`` with ``weight`` (X3): ``absdiff``, ``time_gap`` or ``slope`` between x1 at i and x2 at j.

    The slope is taken over j - i + 1 steps and null where these are none.
    """
    n = x1.groupBy("series_id").agg(F.count(F.lit(1)).alias("n1"))
    a = x1.select("series_id", F.col("t").alias("src"), F.col("value").alias("va"))
    b = x2.join(n, "series_id").select("series_id", (F.col("t") + F.col("n1")).alias("dst"), F.col("value").alias("vb"), F.col("t").alias("j"))
    steps = F.col("j") - F.col("src") + 1
    made = {"absdiff": F.abs(F.col("vb") - F.col("va")), "time_gap": F.abs(F.col("j") - F.col("src")).cast("double"), "slope": F.when(steps != 0, (F.col("vb") - F.col("va")) / steps)}
    if mode not in made:
        raise ValueError(f"mode must be one of {', '.join(made)}")
    return edges.join(a, ["series_id", "src"]).join(b, ["series_id", "dst"]).select("series_id", "src", "dst", made[mode].alias("weight"))
