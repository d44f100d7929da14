"""Recurrence networks and recurrence quantification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "chebyshev", "sqeuclidean")


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays as a JVM expression."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "chebyshev":
        return F.array_max(gaps)
    if metric == "manhattan":
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    return square if metric == "sqeuclidean" else F.sqrt(square)


def embed(points: DataFrame, m: int = 1, tau: int = 1) -> DataFrame:
    """``series_id, t, vec``: delay vectors of ``m`` values ``tau`` apart (those that fit the series)."""
    if m < 1 or tau < 1:
        raise ValueError("m and tau must be positive")
    by = Window.partitionBy("series_id").orderBy("t")
    parts = [F.col("value"), *[F.lead("value", k * tau).over(by) for k in range(1, m)]]
    wide = points.select("series_id", "t", F.array(*parts).alias("vec"))
    return wide.where(F.element_at("vec", -1).isNotNull())


def _vectors(df: DataFrame) -> DataFrame:
    return df if "vec" in df.columns else embed(df)


def _pairs(vectors: DataFrame) -> DataFrame:
    a = vectors.select("series_id", F.col("t").alias("src"), F.col("vec").alias("va"))
    b = vectors.select("series_id", F.col("t").alias("dst"), F.col("vec").alias("vb"))
    return a.join(b, "series_id")


def epsilon_edges(df: DataFrame, epsilon: float, metric: str = "euclidean", theiler: int = 0, positive: bool = False) -> DataFrame:
    """``series_id, src < dst, dist``: state vectors at most ``epsilon`` apart.

    A band join: vectors meet by series and by the cell of their first coordinate (width
    ``epsilon``) or a neighbouring one, so work follows the number of near pairs.  ``theiler`` drops
    pairs at most that far apart in time; ``positive`` drops pairs of equal vectors.
    """
    v = _vectors(df)
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    cell = F.floor(F.get("vec", F.lit(0)) / F.lit(float(epsilon))).cast("long")
    a = v.select("series_id", F.col("t").alias("src"), F.col("vec").alias("va"), cell.alias("cell"))
    b = v.select("series_id", F.col("t").alias("dst"), F.col("vec").alias("vb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = a.join(b, ["series_id", "cell"]).where(F.col("src") < F.col("dst"))
    out = near.withColumn("dist", distance(F.col("va"), F.col("vb"), metric)).where(F.col("dist") <= epsilon)
    if theiler > 0:
        out = out.where(F.col("dst") - F.col("src") > theiler)
    if positive:
        out = out.where(F.col("dist") > 0)
    return out.select("series_id", "src", "dst", "dist")


def knn_arcs(df: DataFrame, k: int, metric: str = "euclidean", theiler: int = 0) -> DataFrame:
    """``series_id, src, dst, dist``: each vector's ``k`` nearest others, ties by the smaller index.

    Vectors of one coordinate are ranked by value: the k nearest are among the k before and
    the k after in that order (and all equal to the outermost of these), so no pairs are made
    beyond them.  Longer vectors are compared within their series.
    """
    if k < 1:
        raise ValueError("k must be positive")
    v = _vectors(df)
    if "vec" not in df.columns and theiler == 0:
        return _knn_line(df, k)
    pairs = _pairs(v).where(F.abs(F.col("src") - F.col("dst")) > theiler).withColumn("dist", distance(F.col("va"), F.col("vb"), metric))
    rank = F.row_number().over(Window.partitionBy("series_id", "src").orderBy("dist", "dst"))
    return pairs.withColumn("r", rank).where(F.col("r") <= k).select("series_id", "src", "dst", "dist")


def _knn_line(points: DataFrame, k: int) -> DataFrame:
    """Nearest neighbours of scalars through the order of the distinct values."""
    # Of one value, only the k + 1 earliest points can be among anybody's k nearest.
    first = points.withColumn("__i", F.row_number().over(Window.partitionBy("series_id", "value").orderBy("t"))).where(F.col("__i") <= k + 1)
    levels = first.groupBy("series_id", "value").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    by = Window.partitionBy("series_id").orderBy("value")
    near = F.collect_list(F.struct("value", "ts")).over(by.rowsBetween(-k, k))
    around = levels.select("series_id", "value", near.alias("near"))
    asked = points.join(around, ["series_id", "value"]).select("series_id", F.col("t").alias("src"), F.col("value").alias("xa"), F.explode("near").alias("n"))
    pairs = asked.select("series_id", "src", F.abs(F.col("xa") - F.col("n.value")).alias("dist"), F.explode("n.ts").alias("dst")).where("src <> dst")
    rank = F.row_number().over(Window.partitionBy("series_id", "src").orderBy("dist", "dst"))
    return pairs.withColumn("r", rank).where(F.col("r") <= k).select("series_id", "src", "dst", "dist")


def undirected(arcs: DataFrame) -> DataFrame:
    """Edges of either direction once: ``series_id, src < dst, dist``."""
    return arcs.groupBy("series_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("dist").alias("dist")).select("series_id", F.col("a").alias("src"), F.col("b").alias("dst"), "dist")


def epsilon_of_fraction(df: DataFrame, fraction: float, metric: str = "euclidean") -> DataFrame:
    """``series_id, eps``: a fraction of the greatest distance of each series."""
    far = _pairs(_vectors(df)).where("src < dst").groupBy("series_id").agg(F.max(distance(F.col("va"), F.col("vb"), metric)).alias("far"))
    return far.select("series_id", (F.col("far") * fraction).alias("eps"))


def fraction_edges(df: DataFrame, fraction: float = 0.2, metric: str = "euclidean", theiler: int = 0, knn: int = 0, mutual: bool = True) -> DataFrame:
    """``series_id, src, dst, dist, weight``: the embedded recurrence graph with epsilon as a fraction of the greatest distance.

    Nearest-neighbour edges (mutual ones only, or all) may be added.  ``weight`` is 1 / (1 + dist).
    """
    v = _vectors(df)
    eps = epsilon_of_fraction(v, fraction, metric)
    pairs = _pairs(v).where(F.col("src") < F.col("dst")).where(F.col("dst") - F.col("src") > theiler).withColumn("dist", distance(F.col("va"), F.col("vb"), metric))
    out = pairs.join(eps, "series_id").where("dist <= eps").select("series_id", "src", "dst", "dist")
    if knn:
        arcs = knn_arcs(v, knn, metric, theiler)
        both = arcs.groupBy("series_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("n"))
        both = both.where("n = 2") if mutual else both
        out = out.unionByName(both.select("series_id", F.col("a").alias("src"), F.col("b").alias("dst"), "dist")).dropDuplicates(["series_id", "src", "dst"])
    return out.withColumn("weight", 1.0 / (1.0 + F.col("dist")))


def rqa(cells: DataFrame, sizes: DataFrame, lmin: int = 2, vmin: int = 2) -> DataFrame:
    """Recurrence quantification of cells ``series_id, i, j`` (all of the matrix) with ``sizes`` (series_id, n).

    Runs along diagonals (the main one included) and columns are gaps-and-islands by row numbers.
    """

    def runs(line: Column, place: Column, least: int) -> DataFrame:
        at = cells.select("series_id", line.alias("line"), place.alias("place"))
        island = F.col("place") - F.row_number().over(Window.partitionBy("series_id", "line").orderBy("place"))
        return at.withColumn("island", island).groupBy("series_id", "line", "island").agg(F.count(F.lit(1)).alias("len")).where(F.col("len") >= least)

    total = cells.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"))
    diagonal = runs(F.col("j") - F.col("i"), F.col("i"), lmin)
    lengths = diagonal.groupBy("series_id", "len").agg(F.count(F.lit(1)).alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("series_id"))
    entropy = lengths.withColumn("p", share).groupBy("series_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("entr"))
    d = diagonal.groupBy("series_id").agg(F.sum("len").alias("dsum"), F.avg("len").alias("l_mean"), F.max("len").alias("l_max"))
    v = runs(F.col("j"), F.col("i"), vmin).groupBy("series_id").agg(F.sum("len").alias("vsum"), F.avg("len").alias("tt"))
    out = sizes.join(total, "series_id", "left").join(d, "series_id", "left").join(entropy, "series_id", "left").join(v, "series_id", "left").fillna(0, ["k", "dsum", "vsum", "l_mean", "l_max", "tt", "entr"])
    k = F.greatest("k", F.lit(1))
    return out.select(
        "series_id",
        (F.col("k") / (F.col("n") * F.col("n"))).alias("rr"),
        (F.col("dsum") / k).alias("det"),
        F.col("l_mean").cast("double").alias("l_mean"),
        F.col("l_max").cast("long").alias("l_max"),
        F.col("entr").cast("double").alias("entr"),
        (F.col("vsum") / k).alias("lam"),
        F.col("tt").cast("double").alias("tt"),
    )


def matrix_cells(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """All cells (i, j) of a symmetric recurrence matrix with its main diagonal."""
    diagonal = sizes.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("series_id", "i", F.col("i").alias("j"))
    e = edges.select("series_id", F.col("src").alias("i"), F.col("dst").alias("j"))
    return e.unionByName(e.select("series_id", F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(diagonal)


def false_neighbours(points: DataFrame, m: int = 1, tau: int = 1, rtol: float = 10.0, atol: float = 2.0) -> DataFrame:
    """``series_id, m, share``: share of false nearest neighbours when the embedding grows from m to m + 1."""
    wide = embed(points, m + 1, tau).select("series_id", "t", F.slice("vec", 1, m).alias("vec"), F.element_at("vec", -1).alias("nxt"))
    arcs = knn_arcs(wide.select("series_id", "t", "vec"), 1)
    nxt = wide.select("series_id", "t", "nxt")
    both = arcs.join(nxt.select("series_id", F.col("t").alias("src"), F.col("nxt").alias("na")), ["series_id", "src"]).join(nxt.select("series_id", F.col("t").alias("dst"), F.col("nxt").alias("nb")), ["series_id", "dst"])
    sd = points.groupBy("series_id").agg(F.stddev_pop("value").alias("sd"))
    gap = F.abs(F.col("na") - F.col("nb"))
    false = (F.col("dist") == 0) | (gap / F.col("dist") > rtol) | (F.sqrt(F.col("dist") * F.col("dist") + gap * gap) / F.col("sd") > atol)
    return both.join(sd, "series_id").groupBy("series_id").agg(F.avg(F.coalesce(false, F.lit(True)).cast("double")).alias("share")).select("series_id", F.lit(m).alias("m"), "share")


def cao(points: DataFrame, m: int = 1, tau: int = 1) -> DataFrame:
    """``series_id, m, e, e_star``: Cao's mean growth of nearest distances and mean last-coordinate gap."""
    wide = embed(points, m + 1, tau)
    short = wide.select("series_id", "t", F.slice("vec", 1, m).alias("vec"))
    arcs = knn_arcs(short, 1, "chebyshev")
    full = wide.select("series_id", "t", "vec")
    both = arcs.join(full.select("series_id", F.col("t").alias("src"), F.col("vec").alias("va")), ["series_id", "src"]).join(full.select("series_id", F.col("t").alias("dst"), F.col("vec").alias("vb")), ["series_id", "dst"])
    grown = distance(F.col("va"), F.col("vb"), "chebyshev")
    last = F.abs(F.element_at("va", -1) - F.element_at("vb", -1))
    return both.groupBy("series_id").agg(F.avg(F.when(F.col("dist") > 0, grown / F.col("dist"))).alias("e"), F.avg(last).alias("e_star")).select("series_id", F.lit(m).alias("m"), "e", "e_star")
