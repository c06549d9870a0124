"""Whole runs from files to files: clustering, incremental detection, and the classical detectors side by side."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, baselines, clustering, encoding, metrics, peaks, tiles
from ..params import Params
from ..sources import files, mgf
from .scratch import table


def load(spark: SparkSession, paths: str | list[str], p: Params, checkpoint: str | None = None) -> DataFrame:
    """Cleaned spectra of MGF files with buckets and vectors, from the checkpoint if there is one; else they are made and, if a checkpoint is named, kept there."""
    if checkpoint and (found := files.load_checkpoint(spark, checkpoint)) is not None:
        return found
    raw = peaks.natural_key(mgf.read(spark, paths)).withColumn("spectrum_id", F.xxhash64("source_file", "scan", "retention_time", "precursor_mz", "peaks"))
    # parsed once: filters of the cleaning would be pushed into the parsing, and lines be parsed again for each
    made = encoding.encode(peaks.preprocess(table(raw), p), p).drop("peaks", "title")
    if not checkpoint:
        return table(made)
    files.save_checkpoint(made, checkpoint)
    return spark.read.parquet(checkpoint)


def cluster(df: DataFrame, p: Params) -> DataFrame:
    """Spectra with cluster, is_representative, label and anomaly (false), by p.cluster_alg, refined by precursor and retention time."""
    kept = table(clustering.enough(df))
    if p.cluster_alg == "dbscan":
        found = tiles.dbscan(kept, p.precursor_tol, p.hd_dim, p.eps)
    else:
        found = tiles.hierarchical(kept, p.precursor_tol, p.hd_dim, p.eps, p.cluster_alg.removeprefix("hc_"))
    refined = table(clustering.refine(found, p.precursor_tol, p.precursor_tol_mode, p.rt_tol))
    return clustering.global_labels(tiles.medoids(refined, p.precursor_tol, p.hd_dim)).withColumn("anomaly", F.lit(False))


def cluster_run(spark: SparkSession, paths: str | list[str], p: Params, out: str, checkpoint: str | None = None, representatives: bool = False) -> DataFrame:
    """Read, cluster and export: out/clusters (Parquet and CSV) and, if asked for, out/representatives as MGF. Returns the clusters."""
    found = table(cluster(load(spark, paths, p, checkpoint), p))
    files.save_results(found, f"{out}/clusters")
    if representatives:
        key = ["identifier", "scan", "retention_time"]
        mgf.write_representatives(peaks.natural_key(mgf.read(spark, paths)), found, f"{out}/representatives", key)
    return found


def detect_run(train: DataFrame, test: DataFrame, p: Params, out: str, truth: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Cluster train, assign test to it in batches by bucket, export results, timings and, with truth, accuracy. Returns the assigned test spectra."""
    began = time.time()
    history = table(cluster(train, p))
    batches = table(anomaly.batches_of(test, ["bucket", "precursor_charge", "spectrum_id"], p.batch_size))
    clustered = time.time()
    found = anomaly.fold_batches(batches, history, p, p.hd_dim)
    files.save_results(found, f"{out}/assigned")
    files.save_results(found.where("anomaly"), f"{out}/anomalies")
    done = time.time()
    rows = batches.count()
    files.append_csv(throughput(test.sparkSession, rows, began, clustered, done), f"{out}/timing")
    if truth is not None:
        key = key or ["identifier", "scan"]
        report = metrics.detection_report(found.where("anomaly"), truth, key)
        marked = found.join(truth.select(*key).distinct().withColumn("_t", F.lit(True)), key, "left").select(F.col("anomaly").cast("double").alias("s"), F.coalesce("_t", F.lit(False)).alias("t"))
        report = report.crossJoin(metrics.auroc(marked, "s", "t").select("auroc")).crossJoin(metrics.auprc(marked, "s", "t").select("auprc"))  # single rows
        files.append_csv(report, f"{out}/accuracy")
    return found


def throughput(spark: SparkSession, rows: int, began: float, clustered: float, done: float) -> DataFrame:
    """(n_spectra, total_s, detect_s, spectra_per_s)."""
    return spark.createDataFrame([(rows, done - began, done - clustered, rows / max(done - clustered, 1e-9))], "n_spectra long, total_s double, detect_s double, spectra_per_s double")


#: Name -> features of binned intensities, and detector.
DETECTORS = {
    "Isolation Forest": (lambda x: baselines.log_features(x), lambda x, c: baselines.isolation_forest(x, c)),
    "LOF": (lambda x: x, lambda x, c: baselines.local_outlier_factor(x, c)),
    "One-Class SVM": (lambda x: baselines.log_features(x, magnitude=True), lambda x, c: baselines.one_class_svm(x, c)),
    "OC-PCA": (lambda x: baselines.log_features(x), lambda x, c: baselines.one_class_pca(x, c, 10)),
    "GODS": (lambda x: baselines.log_features(x), lambda x, c: baselines.subspace_pair(x)),
}


def baseline_run(spectra: DataFrame, truth: DataFrame, contamination: float, skip: tuple[str, ...] = (), low: float = 0.0, high: float = 1500.0, width: float = 50.0, components: int | None = None) -> DataFrame:
    """A row per detector that isn't skipped: its counts, precision, recall, f1, fpr, auroc, auprc and seconds. truth names anomalous spectra by spectrum_id. With components, features are projected first (but for OC-PCA, which projects itself)."""
    x = table(baselines.features(peaks.bin_spectra(peaks.baseline_filter(spectra, low, high), low, high, width), int((high - low) / width)))
    marks = truth.select("spectrum_id").distinct().withColumn("t", F.lit(True))
    out: DataFrame | None = None
    for name, (prepare, detect) in DETECTORS.items():
        if name in skip:
            continue
        began = time.time()
        given = table(prepare(x))
        if components and name != "OC-PCA":
            mean, parts, _ = baselines.pca(given, components)
            given = table(baselines.project(given, mean, parts))
        found = table(detect(given, contamination).join(marks, "spectrum_id", "left").select("outlier", (-F.col("score")).alias("s"), F.coalesce("t", F.lit(False)).alias("t")))
        row = metrics.confusion(found, "outlier", "t").crossJoin(metrics.auroc(found, "s", "t").select("auroc")).crossJoin(metrics.auprc(found, "s", "t").select("auprc"))  # single rows
        row = row.select(F.lit(name).alias("method"), "*", F.lit(time.time() - began).alias("seconds"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("every detector is skipped")
    return out
