"""Hamming distances between packed vectors and the joins that use them.

All pair joins are equi-joins on charge and bucket, narrowed by the precursor band where there is one, so that the engine can deal
them out and split skewed ones. Within a band pairs beyond the tolerance are never made: their masked distance is 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["precursor_charge", "bucket"]


def hamming(a: str | F.Column, b: str | F.Column, dim: int) -> F.Column:
    """Share of differing bits of two arrays of 32-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n) / F.lit(dim)


def within(mz_x: F.Column, mz_y: F.Column, tol: float, mode: str = "ppm") -> F.Column:
    """Whether the precursors lie strictly within tolerance; in ppm of the second."""
    gap = F.abs(mz_x - mz_y)
    return (gap / mz_y < tol * 1e-6) if mode == "ppm" else (gap < tol)


def band(mz: F.Column, tol: float, mode: str = "ppm") -> F.Column:
    """Number of the band of a precursor; precursors within tolerance lie in the same or in neighbouring bands."""
    if mode == "ppm":
        # bands are slightly wider than the tolerance, since it is measured against either of the two
        return F.floor(F.log(mz) / F.lit(2 * math.log1p(tol * 1e-6))).cast("long")
    return F.floor(mz / F.lit(float(tol))).cast("long")


def masked_pairs(df: DataFrame, tol: float, dim: int, mode: str = "ppm", keys: list[str] | None = None) -> DataFrame:
    """(keys, id_a, id_b, dist): pairs id_a < id_b of a group whose precursors lie within tolerance. All other pairs have distance 1.

    The band is part of the join key: the second side stands in its own and both neighbouring bands.
    """
    keys = GROUP if keys is None else keys
    src = df.select(*keys, "spectrum_id", "precursor_mz", "hv", band(F.col("precursor_mz"), tol, mode).alias("_band"))
    a = src.select(*keys, F.col("spectrum_id").alias("id_a"), F.col("precursor_mz").alias("_mz_a"), F.col("hv").alias("_hv_a"), "_band")
    b = src.select(*keys, F.col("spectrum_id").alias("id_b"), F.col("precursor_mz").alias("_mz_b"), F.col("hv").alias("_hv_b"), F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)).alias("_band"))
    both = a.join(b, [*keys, "_band"]).where((F.col("id_a") < F.col("id_b")) & within(F.col("_mz_a"), F.col("_mz_b"), tol, mode))
    return both.select(*keys, "id_a", "id_b", hamming("_hv_a", "_hv_b", dim).alias("dist"))


def pairs(df: DataFrame, dim: int, keys: list[str], most: float | None = None, id_col: str = "spectrum_id") -> DataFrame:
    """(keys, id_a, id_b, dist): all pairs of a group without a mask, at most `most` apart if given. Groups must be small or bounded: their pairs are their square."""
    a = df.select(*keys, F.col(id_col).alias("id_a"), F.col("hv").alias("_a"))
    b = df.select(*keys, F.col(id_col).alias("id_b"), F.col("hv").alias("_b"))
    out = a.join(b, keys).where("id_a < id_b").select(*keys, "id_a", "id_b", hamming("_a", "_b", dim).alias("dist"))
    return out if most is None else out.where(F.col("dist") <= most)


def nearest_rep(new: DataFrame, reps: DataFrame, tol: float, dim: int, mode: str = "ppm", keys: list[str] | None = None) -> DataFrame:
    """new with best_rep and best_dist: the nearest representative of its group, the least rep id of equally near ones.

    A representative beyond the precursor tolerance is at distance 1; so where none is within it, the group's least rep id is the
    best, at 1. A group without representatives gives nulls. reps has keys, rep_id, precursor_mz and hv.
    """
    keys = GROUP if keys is None else keys
    r = reps.select(*keys, "rep_id", F.col("precursor_mz").alias("_rmz"), F.col("hv").alias("_rhv"), F.explode(F.array(*[band(F.col("precursor_mz"), tol, mode) + k for k in (-1, 0, 1)])).alias("_band"))
    near = new.select(*keys, "spectrum_id", "precursor_mz", "hv", band(F.col("precursor_mz"), tol, mode).alias("_band")).join(r, [*keys, "_band"])
    # a new spectrum comes after the representatives, so that the tolerance is in ppm of its own precursor
    near = near.where(within(F.col("_rmz"), F.col("precursor_mz"), tol, mode)).select("spectrum_id", "rep_id", hamming("_rhv", "hv", dim).alias("dist"))
    best = near.groupBy("spectrum_id").agg(F.min(F.struct("dist", "rep_id")).alias("near"))
    first = reps.groupBy(*keys).agg(F.min("rep_id").alias("_first"))
    joined = new.join(best, "spectrum_id", "left").join(first, keys, "left")
    far = F.struct(F.lit(1.0).alias("dist"), F.col("_first").alias("rep_id"))
    chosen = F.when(F.col("_first").isNotNull(), F.least(F.coalesce("near", far), far))
    return joined.withColumn("_chosen", chosen).select(*new.columns, F.col("_chosen.rep_id").alias("best_rep"), F.col("_chosen.dist").alias("best_dist"))


def join_clusters(meta: DataFrame, clusters: DataFrame, key: list[str], order: str) -> DataFrame:
    """Left join of spectra with their cluster rows by the natural key, of which the first row in `order` counts."""
    from pyspark.sql import Window

    first = clusters.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
    return meta.join(first, key, "left")
