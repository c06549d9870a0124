"""Evaluation of flags and scores against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import running


def safe(a: F.Column, b: F.Column) -> F.Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, flag: str, truth: str) -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1 and fpr of a boolean flag against a boolean truth; nulls count as false."""
    f, t = F.coalesce(F.col(flag), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    counts = df.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & ~t).alias("tn"), F.count_if(~f & t).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(fp, fp + tn).alias("fpr"))


def detection_report(flagged: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """One row: flagged rows in truth are true anomalies. true_pos_rate is precision, false_pos_rate its complement and detection_rate recall, to 2 places; precision and recall to 4, and f1_score from these, to 4."""
    f, t = flagged.select(*key).distinct().withColumn("_f", F.lit(True)), truth.select(*key).distinct().withColumn("_t", F.lit(True))
    n = f.join(t, key, "full").agg(F.count_if(F.col("_f") & F.col("_t")).alias("true_anomalies"), F.count_if(F.col("_f") & F.col("_t").isNull()).alias("false_anomalies"), F.count_if("_t").alias("expected_total_anomalies"))
    tp, fp, total = F.col("true_anomalies"), F.col("false_anomalies"), F.col("expected_total_anomalies")
    n = n.select("*", F.round(safe(tp, tp + fp), 4).alias("precision"), F.round(safe(tp, total), 4).alias("recall"))
    f1 = safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return n.select(F.round(safe(tp, tp + fp), 2).alias("true_pos_rate"), F.round(safe(fp, tp + fp), 2).alias("false_pos_rate"), F.round(safe(tp, total), 2).alias("detection_rate"), "true_anomalies", "false_anomalies", "expected_total_anomalies", "precision", "recall", F.round(f1, 4).alias("f1_score"))


def by_score(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(score, pos, neg, pos_up_to, neg_up_to): per distinct score the rows of either kind, and their running counts from the greatest score down. Rows are counted per score first; the order over scores is made by ranges."""
    kinds = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    return running(kinds.withColumn("_down", -F.col("score")), ["_down"], {"pos_up_to": "pos", "neg_up_to": "neg"}).drop("_down")


def auroc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: the area under the ROC curve of a score that is higher for true rows, tied pairs counting half; null if either kind is missing."""
    s = by_score(df, score, truth)
    pairs = F.sum(F.col("pos") * (F.col("neg_up_to") - F.col("neg")) + F.col("pos") * F.col("neg") / 2)
    total = F.sum("pos") * F.sum("neg")
    return s.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.when(total > 0, 1 - pairs / total).alias("auroc"))


def auprc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: average precision, the sum over falling distinct scores of the recall gained times the precision there; null without a true row."""
    s = by_score(df, score, truth)
    gained = F.sum(F.col("pos") * F.col("pos_up_to") / (F.col("pos_up_to") + F.col("neg_up_to")))
    return s.agg(F.sum("pos").alias("n_pos"), F.when(F.sum("pos") > 0, gained / F.sum("pos")).alias("auprc"))


def label_sanity(spectra: DataFrame, binned: DataFrame, label: str) -> DataFrame:
    """Per label the mean number of peaks, summed intensity and non-zero bins of its spectra."""
    filled = binned.where("intensity <> 0").groupBy("spectrum_id").agg(F.count("*").alias("_bins"))
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    both = spectra.withColumn("_n", F.size("peaks")).withColumn("_sum", total).join(filled, "spectrum_id", "left")
    return both.groupBy(label).agg(F.count("*").alias("n_spectra"), F.avg("_n").alias("mean_peaks"), F.avg("_sum").alias("mean_intensity"), F.avg(F.coalesce("_bins", F.lit(0))).alias("mean_bins"))


def best_by(df: DataFrame, keys: list[str], metric: str, tie: str) -> DataFrame:
    """Of each group the row with the greatest metric, the least `tie` of equal ones; null and NaN metrics don't count."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(metric), tie)
    return df.where(F.col(metric).isNotNull() & ~F.isnan(metric)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mean_over(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means of metrics per group; null and NaN are left out."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics])
