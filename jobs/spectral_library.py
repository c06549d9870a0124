"""Builds a spectral library: cleans and encodes all spectra, clusters them, marks each cluster's medoid, and writes one partition per charge.

    python jobs/spectral_library.py --data DIR --out PATH [--config jobs/spectral_library.ini]

DIR holds orders.parquet (a spectrum a row) and lineitem.parquet (its peaks). PATH may be on any file system that Spark writes. The whole
library is made anew by each run and takes the old one's place, so that a run over the same tables gives the same rows, also after one that was
broken off.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peakgrid.operators import clustering, encoding, peaks, tiles
from peakgrid.params import Params
from peakgrid.plans import scratch, testdata

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "spectral_library.ini")
SCHEMA = "spectrum_id long, bucket int, precursor_mz double, cluster long, label long, n_spectra long, is_representative boolean, precursor_charge int"
log = logging.getLogger("jobs.spectral_library")


def library(spectra: DataFrame, p: Params) -> DataFrame:
    """A row per clean spectrum: its cluster (null: noise), the cluster's number over the whole library and size, and whether it stands for it. Repeated spectrum ids are an error of the input."""
    dbscan = p.cluster_alg == "dbscan"
    columns = ["spectrum_id", "precursor_mz", "precursor_charge", "bucket", "hv"]
    known = scratch.table(encoding.encode(peaks.preprocess(spectra, p), p, packed=dbscan).select(*columns))
    if dbscan:
        found = tiles.dbscan(known, p.precursor_tol, p.hd_dim, p.eps, p.precursor_tol_mode)
    else:
        found = tiles.hierarchical(known, p.precursor_tol, p.hd_dim, p.eps, p.cluster_alg.removeprefix("hc_"), p.precursor_tol_mode)
    marked = tiles.medoids(scratch.table(found), p.precursor_tol, p.hd_dim, p.precursor_tol_mode)
    marked = scratch.table(clustering.global_labels(marked.drop("hv")))
    size = marked.groupBy("label").agg(F.count("*").alias("n_spectra"))
    return marked.join(size, "label").select("spectrum_id", "bucket", "precursor_mz", "cluster", "label", "n_spectra", "is_representative", "precursor_charge")


def run(spark: SparkSession, data: str, out: str, config: str = CONFIG) -> dict[str, int]:
    """Builds the library of the tables in data at out; returns what the log says: rows read, written, and clusters."""
    p, seen = Params.from_ini(config), Observation()
    spectra = testdata.spectra(spark, data).observe(seen, F.count("*").alias("n"))
    with scratch.scope(spark):
        made = library(spectra, p).repartition("precursor_charge", "bucket").sortWithinPartitions("bucket", "label", "spectrum_id")
        made.write.mode("overwrite").partitionBy("precursor_charge").parquet(out)
    row = read(spark, out).agg(F.count("*").alias("rows"), F.count_if(F.col("is_representative") & F.col("cluster").isNotNull()).alias("clusters"), F.count_if(F.col("cluster").isNull()).alias("noise")).first()
    told = {"read": int(seen.get["n"]), "written": row["rows"], "clusters": row["clusters"], "noise": row["noise"]}
    log.info("read %d spectra of %s; wrote %d rows, %d clusters and %d single spectra, to %s", told["read"], data, told["written"], told["clusters"], told["noise"], out)
    return told


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(out)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("--data", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--config", default=CONFIG)
    a = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("spectral_library").getOrCreate()
    try:
        run(spark, a.data, a.out, a.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
