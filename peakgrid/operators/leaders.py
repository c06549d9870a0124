"""Incremental clustering within buckets in the order of ids, where a new cluster's representative is seen by the very next spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, table
from .distances import GROUP, masked_pairs, nearest_rep


def assign_in_order(new: DataFrame, reps: DataFrame, eps: float, tol: float, dim: int) -> DataFrame:
    """new with cluster and founded: in the order of spectrum_id a spectrum joins the cluster of its group's nearest representative (the least id of equally near ones) if that is within eps < 1, else it founds a cluster, named by its id, whose representative it is for all that come later.

    reps has the group, rep_id, cluster, precursor_mz and hv; new spectra have larger ids than they, so that tolerances in ppm are of the new
    one, or of the later of two. The rows' order is kept without a loop over rows: who founds a cluster is decided in rounds. A spectrum without an
    earlier undecided one within eps founds one; whoever has an earlier founder within eps doesn't, and all others wait for the
    next round. Each round is a few joins over the undecided, and long chains of spectra that wait for each other are rare.
    """
    if eps >= 1:
        raise ValueError("eps must be less than 1, the distance of masked pairs")
    known = table(nearest_rep(new.select(*GROUP, "spectrum_id", "precursor_mz", "hv"), reps, tol, dim).where(F.col("best_dist") <= eps).select("spectrum_id", "best_dist", "best_rep"))
    pairs = table(masked_pairs(new, tol, dim).where(F.col("dist") <= eps).select("id_a", "id_b", "dist"))
    left = cut(new.select("spectrum_id").join(known.select("spectrum_id"), "spectrum_id", "left_anti"))
    founders: DataFrame | None = None
    while not left.isEmpty():
        inner = pairs.join(left.select(F.col("spectrum_id").alias("id_a")), "id_a", "left_semi").join(left.select(F.col("spectrum_id").alias("id_b")), "id_b", "left_semi")
        inner = cut(inner.select("id_a", "id_b"))
        more = cut(left.join(inner.select(F.col("id_b").alias("spectrum_id")), "spectrum_id", "left_anti"))
        founders = more if founders is None else cut(founders.unionByName(more))
        joined = inner.join(more.select(F.col("spectrum_id").alias("id_a")), "id_a", "left_semi").select(F.col("id_b").alias("spectrum_id"))
        left = cut(left.join(more.unionByName(joined), "spectrum_id", "left_anti"))
    if founders is None:
        founders = left
    later = pairs.join(founders.select(F.col("spectrum_id").alias("id_a")), "id_a", "left_semi").select(F.col("id_b").alias("spectrum_id"), F.struct(F.col("dist").alias("d"), F.col("id_a").alias("rep")).alias("near"))
    every = later.unionByName(known.select("spectrum_id", F.struct(F.col("best_dist").alias("d"), F.col("best_rep").alias("rep")).alias("near")))
    best = every.groupBy("spectrum_id").agg(F.min("near").alias("near")).select("spectrum_id", F.col("near.rep").alias("_rep"))
    named = reps.select(F.col("rep_id").alias("_rep"), F.col("cluster").alias("_c"))
    own = founders.withColumn("founded", F.lit(True))
    out = new.join(own, "spectrum_id", "left").join(best, "spectrum_id", "left").join(named, "_rep", "left")
    cluster = F.when(F.col("founded"), F.col("spectrum_id")).otherwise(F.coalesce("_c", "_rep"))
    return out.select(*new.columns, cluster.alias("cluster"), F.coalesce("founded", F.lit(False)).alias("founded"))
