"""Other files: text spectra, checkpoints, results, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import strips, tiles
from ..plans.scratch import carried

#: Columns of accuracy lines, in order.
ACCURACY = ["param", "true_pos_rate", "false_pos_rate", "detection_rate", "true_anomalies", "false_anomalies", "expected_total_anomalies", "precision", "recall", "f1_score", "auroc", "auprc"]


def read_text_spectrum(spark: SparkSession, path: str, skip: int = 1, least: float | None = None) -> DataFrame:
    """(source_file, channel, mz, intensity) of text files with two or three columns parted by white space. Lines of comments (#) and the file's first `skip` other lines are left out; what is no number is null."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    kept = F.filter(F.split("value", "\\r?\\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    rows = lines.select("source_file", F.posexplode(F.slice(kept, skip + 1, 1 << 30)).alias("line", "text")).select("source_file", "line", F.split(F.trim("text"), "\\s+").alias("f"))
    get = lambda i: F.get("f", F.lit(i)).try_cast("double")
    three = F.size("f") >= 3
    out = rows.select("source_file", F.when(three, get(0).cast("int")).otherwise(F.col("line")).alias("channel"), F.when(three, get(1)).otherwise(get(0)).alias("mz"), F.when(three, get(2)).otherwise(get(1)).alias("intensity"))
    return out if least is None else out.where(F.col("intensity") >= least)


def save_checkpoint(df: DataFrame, path: str) -> None:
    """Spectra with their hypervectors, one table, a folder per charge and sorted by bucket within files, so that readers skip what they don't need."""
    df.repartition("precursor_charge", "bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("precursor_charge").parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """A checkpoint; None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def save_results(df: DataFrame, path: str) -> None:
    """Results as Parquet and as CSV: path/parquet and path/csv. Arrays are JSON text in CSV."""
    df = df.withColumn("identifier", F.col("identifier").cast("string")) if "identifier" in df.columns else df
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> None:
    spark.read.csv(source, header=True, schema=schema).write.mode("overwrite").parquet(target)


def write_distances(edges: DataFrame, path: str) -> None:
    """Distances (id_a, id_b, dist) as CSV with a header. Pairs that aren't there have distance 1, so that a matrix is never written out."""
    edges.select("id_a", "id_b", "dist").write.mode("overwrite").option("header", True).csv(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id_a long, id_b long, dist double")


def write_distance_lines(df: DataFrame, path: str, tol: float, dim: int, mode: str = "ppm") -> None:
    """The distances of all pairs within tolerance as gzipped CSV with a header, about a byte for a pair: lines of strips.lines(), of usable spectra. For tables whose pairs are too many for a line each."""
    strips.lines(df.where(tiles.usable()), tol, dim, mode).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_distance_lines(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id_a, id_b, dist), as read_distances()."""
    return strips.pairs_of(spark.read.csv(path, header=True, schema="ids string, n string, d string"), dim)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a folder of CSV files; each has a header, which readers with header=True leave out."""
    df.write.mode("append").option("header", True).csv(path)


def write_outliers(df: DataFrame, path: str) -> None:
    """(spectrum_id, verdict): outlier, normal, or skipped where the detector gave no flag."""
    df.select("spectrum_id", F.when(F.col("outlier").isNull(), "skipped").when(F.col("outlier"), "outlier").otherwise("normal").alias("verdict")).write.mode("overwrite").option("header", True).csv(path)


def parse_accuracy(lines: DataFrame) -> DataFrame:
    """Accuracy lines (column value): comma-separated numbers in the order of ACCURACY, missing ones at the end null. Rates are brought to 0..1 if any is over 1.5."""
    f = F.split("value", ",")
    some = lines.where(F.col("value").rlike("^\\s*[0-9.]+\\s*,"))
    out = some.select(*[F.get(f, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(ACCURACY)])
    most = out.agg(F.max(F.greatest("precision", "recall")).alias("_m"))
    scaled = out.crossJoin(F.broadcast(most))  # one row
    for c in ("precision", "recall", "f1_score"):
        scaled = scaled.withColumn(c, F.when(F.col("_m") > 1.5, F.col(c) / 100).otherwise(F.col(c)))
    return scaled.drop("_m")


def parse_tradeoff(lines: DataFrame) -> DataFrame:
    """(mz_interval, line, value): each line of numbers with the mz_interval of the last header above it. lines has line (its place) and value."""
    head = F.regexp_extract("value", "mz_interval\\s*=\\s*([0-9.]+)", 1)
    filled = lines.withColumn("_h", F.when(head != "", head.cast("double")))
    out = carried(filled, ["line"], "_h", "mz_interval", "source_file" if "source_file" in lines.columns else None)
    return out.where(F.col("_h").isNull() & F.col("value").rlike("^\\s*[0-9.]+")).drop("_h")


#: Names of the detectors in run logs.
METHODS = ["Isolation Forest", "LOF", "One-Class SVM", "OC-PCA", "GODS"]


def parse_run_log(lines: DataFrame) -> DataFrame:
    """(run, method, precision, recall, f1): metric lines of run logs, `method precision recall f1` parted by white space or bars after a line that names the run's contamination in per cent. lines has line and value."""
    pct = F.regexp_extract("value", "contamination\\s*[=:]\\s*([0-9.]+)", 1)
    filled = carried(lines.withColumn("_run", F.when(pct != "", pct.cast("double"))), ["line"], "_run", "run")
    pattern = "^\\s*(" + "|".join(METHODS) + ")[\\s|:]+([0-9.]+)%?[\\s|]+([0-9.]+)%?[\\s|]+([0-9.]+)"
    hit = filled.where(F.col("value").rlike(pattern))
    return hit.select("run", F.regexp_extract("value", pattern, 1).alias("method"), *[F.regexp_extract("value", pattern, i).cast("double").alias(c) for i, c in ((2, "precision"), (3, "recall"), (4, "f1"))])


def timing_table(times: DataFrame) -> DataFrame:
    """(run, one column per method): subtotal of preprocessing, projection and fitting. times has run, method, preproc_s, pca_s and fit_s; a missing part counts 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("preproc_s", "pca_s", "fit_s")), F.lit(0.0))
    return times.withColumn("s", total).groupBy("run").pivot("method", METHODS).agg(F.sum("s"))
