"""How well clusters are separated: distances from representatives to members and from members to other representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import table
from . import distances, strips


def representative(df: DataFrame) -> DataFrame:
    """(cluster, bucket, rep_id, mz, hv): of each cluster the first flagged spectrum, else the first."""
    best = df.where("cluster is not null").groupBy("cluster").agg(F.min(F.struct((~F.col("is_representative")).cast("int").alias("n"), "spectrum_id")).alias("r"))
    ids = best.select("cluster", F.col("r.spectrum_id").alias("rep_id"))
    return df.select(F.col("spectrum_id").alias("rep_id"), "bucket", F.col("precursor_mz").alias("mz"), "hv").join(ids, "rep_id").select("cluster", "bucket", "rep_id", "mz", "hv")


def apart(members: DataFrame, reps: DataFrame, tol: float, dim: int, mode: str, hot: int) -> DataFrame:
    """As strips.separations(), of members and representatives of any number in a band: members of bands of over `hot` of both, and of those beside, go by a join with the representatives."""
    here = distances.band(F.col("precursor_mz"), tol, mode)
    good = F.coalesce(~F.isnan("precursor_mz") & F.col("hv").isNotNull() & F.col("bucket").isNotNull() & (F.col("precursor_mz") > 0 if mode == "ppm" else F.col("precursor_mz").isNotNull()), F.lit(False))
    own = [F.lit(1).cast("long").alias("n"), F.col("own").isNotNull().cast("long").alias("k"), *[F.coalesce("own", F.lit(0.0)).alias(c) for c in "st"]]
    alone = members.where(~good).select("cluster", "bucket", F.lit(None).cast("long").alias("o"), F.lit(1.0).alias("v"), *own)
    near, far = members.where(good).withColumn("_band", here), reps.where(good).withColumn("_band", here)
    at = ["bucket", "_band"]
    bands = table(near.select(*at).unionByName(far.select(*at)).groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > hot))
    if bands.isEmpty():
        return strips.separations(near, far, tol, dim, mode).unionByName(alone)
    wide = table(bands.select("bucket", F.explode(F.array(*[F.col("_band") + k for k in (-1, 0, 1)])).alias("_band")).distinct())
    few = strips.separations(near.join(wide, at, "left_anti"), far.join(bands, at, "left_anti"), tol, dim, mode)
    many = table(near.join(wide, at, "left_semi"))
    other = far.select("bucket", F.col("cluster").alias("o"), F.col("precursor_mz").alias("o_mz"), F.col("hv").alias("o_hv"), F.explode(F.array(*[F.col("_band") + k for k in (-1, 0, 1)])).alias("_band"))
    pair = many.join(other, at).where((F.col("o") != F.col("cluster")) & distances.within(F.col("precursor_mz"), F.col("o_mz"), tol, mode)).select("cluster", "bucket", "spectrum_id", "o", distances.hamming("hv", "o_hv", dim).alias("_d"))
    least = pair.groupBy("cluster", "spectrum_id").agg(F.min("_d").alias("v"))
    each = many.join(least, ["cluster", "spectrum_id"], "left").select("cluster", "bucket", F.lit(None).cast("long").alias("o"), F.coalesce("v", F.lit(1.0)).alias("v"), *own)
    zero = [F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("k", "long"), ("s", "double"), ("t", "double"))]
    saved = pair.groupBy("cluster", "bucket", "o").agg(F.sum(1 - F.col("_d")).alias("v")).select("cluster", "bucket", "o", "v", *zero)
    return few.unionByName(each).unionByName(saved).unionByName(alone)


def separation(df: DataFrame, tol: float, dim: int, mode: str = "ppm", hot: int = 4_096) -> DataFrame:
    """Per cluster: bucket, size, avg_intra, max_intra, nearest_cluster, nearest_inter, separation_margin, separation_score, cluster_min_sep, cluster_avg_sep and cluster_p50_sep.

    avg_intra and max_intra go from the representative to all members, itself included. A member's separation is its distance to the
    nearest representative of another cluster in the representative's bucket; nearest_inter is its median over members. The nearest
    cluster has the least mean distance over members (ties: the least id). Precursors beyond tolerance are at distance 1. A cluster
    alone in its bucket has null separations; a score over an avg_intra of 0 is infinite.
    """
    member = df.where("cluster is not null").select("cluster", "spectrum_id", F.col("precursor_mz").alias("m_mz"), F.col("hv").alias("m_hv"))
    count = member.groupBy("cluster").agg(F.count("*").alias("size"))
    reps = table(representative(df).join(count, "cluster"))
    own = F.when(distances.within(F.col("mz"), F.col("m_mz"), tol, mode), distances.hamming("hv", "m_hv", dim)).otherwise(F.lit(1.0))
    both = member.join(reps.select("cluster", "bucket", "mz", "hv"), "cluster").select("cluster", "bucket", "spectrum_id", F.col("m_mz").alias("precursor_mz"), F.col("m_hv").alias("hv"), own.alias("own"))
    points = reps.withColumnRenamed("mz", "precursor_mz")
    got = table(apart(both, points, tol, dim, mode, hot).groupBy("cluster", "bucket", "o", "v").agg(*[F.sum(c).alias(c) for c in "nks"], F.max("t").alias("t"), F.sum("v").alias("_saved")))
    one = got.where("o is null")
    intra = one.groupBy("cluster", "bucket").agg(
        F.sum("n").alias("size"), F.try_divide(F.sum("s"), F.sum("k")).alias("avg_intra"), F.when(F.sum("k") > 0, F.max("t")).alias("max_intra"), F.min("v").alias("cluster_min_sep"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("cluster_avg_sep"), F.percentile("v", 0.5, F.col("n")).alias("cluster_p50_sep"),
    )
    # a candidate's mean is 1 less what its near pairs save
    saved = got.where("o is not null").groupBy("cluster", "o").agg(F.sum("_saved").alias("_saved"))
    best = saved.join(count, "cluster").groupBy("cluster").agg(F.min(F.struct(F.round(1 - F.col("_saved") / F.col("size"), 9).alias("m"), "o")).alias("_best"))
    w = Window.partitionBy("bucket").orderBy("cluster")
    firsts = reps.select("bucket", "cluster", F.row_number().over(w).alias("n")).where("n <= 2").groupBy("bucket").agg(F.min("cluster").alias("_f1"), F.max("cluster").alias("_f2"), F.count("*").alias("_nf"))
    out = intra.join(best, "cluster", "left").join(firsts, "bucket")
    far = F.struct(F.lit(1.0).alias("m"), F.when(F.col("_f1") == F.col("cluster"), F.col("_f2")).otherwise(F.col("_f1")).alias("o"))
    some = F.col("_nf") > 1
    if_some = lambda c: F.when(some, c)
    return out.select(
        "cluster", "bucket", "size", "avg_intra", "max_intra",
        if_some(F.least(F.coalesce("_best", far), far)["o"]).alias("nearest_cluster"),
        if_some(F.col("cluster_p50_sep")).alias("nearest_inter"),
        if_some(F.col("cluster_p50_sep") - F.col("max_intra")).alias("separation_margin"),
        if_some(F.when(F.col("avg_intra") > 0, F.try_divide(F.col("cluster_p50_sep"), F.col("avg_intra"))).otherwise(F.lit(float("inf")))).alias("separation_score"),
        *[if_some(F.col(c)).alias(c) for c in ("cluster_min_sep", "cluster_avg_sep", "cluster_p50_sep")],
    )


def top_per_size(stats: DataFrame, sizes: list[int], k: int = 3) -> DataFrame:
    """Of each of these sizes the k clusters of the greatest separation score (ties: the least cluster)."""
    w = Window.partitionBy("size").orderBy(F.desc("separation_score"), "cluster")
    some = stats.where(F.col("size").isin(sizes) & F.col("separation_score").isNotNull())
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
