"""Watches a growing folder of texts (notes, reports, logs that come with runs) for those that don't look like the rest of their language.

    python jobs/text_watch.py --documents PATH --out PATH --checkpoint PATH [--config jobs/text_watch.ini]

A text's letters are a spectrum: a peak for each letter, as strong as it is frequent. Spectra are cleaned, scaled and encoded as hypervectors
by the library; a language's profile is the majority vector of all its texts so far, and a text's distance to the profile is judged by the
library's threshold over all distances so far. A file stream with a checkpoint takes only what is new. What is carried from batch to batch, for each
language, is the number of ones of each bit and the histogram of distances, so that a batch costs its own rows, however long the history. Rows are
judged once, by what is known with their batch.

Below --out: results/batch=N/lang=L has a row per text, profile/batch=N and distances/batch=N the state after batch N. Every table of a batch is
overwritten if the batch is run again after a failure, and none of another batch is touched.
"""

from __future__ import annotations

import argparse
import configparser
import logging
import os
import sys
from dataclasses import dataclass

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakgrid.operators import anomaly, distances, encoding, peaks
from peakgrid.params import Params
from peakgrid.plans import scratch

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "text_watch.ini")
#: m/z of the first letter.
FIRST_MZ = 101
SCHEMA = "doc_id long, source string, dist double, anomaly_eps double, anomaly boolean, batch int, lang string"
PROFILE, DISTANCES = "lang string, members long, ones array<long>", "lang string, dist double, n long"
log = logging.getLogger("jobs.text_watch")


@dataclass(frozen=True)
class Settings:
    letters: str
    max_files: int
    p: Params

    @classmethod
    def read(cls, path: str) -> Settings:
        file = configparser.ConfigParser()
        with open(path, encoding="utf-8") as f:
            file.read_file(f)
        s = file["DEFAULT"]
        p = Params(hd_dim=s.getint("hd_dim"), hd_q=s.getint("hd_q"), min_intensity=s.getfloat("min_intensity"), anomaly_percentile=s.getfloat("anomaly_percentile"), anomaly_margin=s.getfloat("anomaly_margin"), anomaly_cap=s.getfloat("anomaly_cap"), max_mz=FIRST_MZ + len(s["letters"]))
        return cls(s["letters"], s.getint("max_files"), p)


def vectors(texts: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, source, lang, hv) of documents; hv is null for a text without any of the letters, lang is und for null and empty ones."""
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda letter: (F.length("_low") - F.length(F.replace("_low", F.lit(letter)))).cast("double")
    all_peaks = F.array(*[F.struct(F.lit(float(FIRST_MZ + i)).alias("mz"), count(letter).alias("intensity")) for i, letter in enumerate(s.letters)])
    spectra = texts.select("doc_id", "source", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("lang"), low.alias("_low")).withColumn("peaks", F.filter(all_peaks, lambda x: x["intensity"] > 0)).drop("_low")
    clean = peaks.normalize(peaks.top_peaks(spectra, s.p.max_peaks_used, s.p.min_intensity))
    return encoding.encode(clean, s.p, portable=True).select("doc_id", "source", "lang", F.when(F.size("peaks") > 0, F.col("hv")).alias("hv"))


def grown(before: DataFrame | None, now: DataFrame, dim: int) -> DataFrame:
    """The bit counts of two sets of texts together, from those of each."""
    if before is None:
        return now
    old = before.select("lang", F.col("members").alias("_m"), F.col("ones").alias("_o"))
    none = F.array_repeat(F.lit(0).cast("long"), dim)
    both = old.join(now, "lang", "full")
    members = F.coalesce("members", F.lit(0)) + F.coalesce("_m", F.lit(0))
    return both.select("lang", members.cast("long").alias("members"), F.zip_with(F.coalesce("ones", none), F.coalesce("_o", none), lambda a, b: a + b).alias("ones"))


def judge(batch: DataFrame, number: int, out: str, s: Settings) -> dict[str, int]:
    """Judges the texts of one micro-batch and carries the state on. State before it is that of batch number - 1."""
    spark, dim = batch.sparkSession, s.p.hd_dim

    def state(name: str, schema: str) -> DataFrame | None:
        return spark.read.schema(schema).parquet(f"{out}/{name}/batch={number - 1}") if number else None

    with scratch.scope(spark):
        made = scratch.table(vectors(batch, s))
        grown(state("profile", PROFILE), encoding.bit_counts(made, ["lang"], dim), dim).write.mode("overwrite").parquet(f"{out}/profile/batch={number}")
        known = spark.read.schema(PROFILE).parquet(f"{out}/profile/batch={number}")
        profile = known.select("lang", encoding.majority_of_counts(F.col("ones"), F.col("members"), dim).alias("_profile"))
        far = scratch.table(made.join(profile, "lang").select("doc_id", "source", "lang", distances.hamming("hv", "_profile", dim).alias("dist")))
        count = far.where("dist is not null").groupBy("lang", "dist").agg(F.count("*").alias("n"))
        before = state("distances", DISTANCES)
        count = count if before is None else count.unionByName(before).groupBy("lang", "dist").agg(F.sum("n").alias("n"))
        count.write.mode("overwrite").parquet(f"{out}/distances/batch={number}")
        told = spark.read.schema(DISTANCES).parquet(f"{out}/distances/batch={number}")
        eps = anomaly.weighted_percentile(told, ["lang"], "dist", "n", s.p.anomaly_percentile)
        eps = eps.select("lang", F.least(F.col("at") + s.p.anomaly_margin, F.lit(s.p.anomaly_cap)).alias("anomaly_eps"))
        judged = far.join(eps, "lang", "left").withColumn("anomaly", F.coalesce(F.col("dist") > F.col("anomaly_eps"), F.lit(True))).withColumn("batch", F.lit(number))
        judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(f"{out}/results")
        row = far.agg(F.count("*").alias("n")).first()
    flagged = read(spark, out).where(F.col("batch") == number).agg(F.count("*").alias("n"), F.count_if("anomaly").alias("a")).first()
    return {"batch": number, "read": row["n"], "written": flagged["n"], "anomalies": flagged["a"]}


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: str = CONFIG) -> list[dict[str, int]]:
    """Judges the texts that have come since the last run with this checkpoint, and returns what the log says of each batch. A run that finds nothing new writes nothing.

    A text that is null or has none of the letters has no distance and is an anomaly; repeated rows are judged each; texts are read whole.
    """
    s, told = Settings.read(config), []
    source = spark.readStream.schema(spark.read.parquet(documents).schema)
    if s.max_files:
        source = source.option("maxFilesPerTrigger", s.max_files)

    def step(batch: DataFrame, number: int) -> None:
        told.append(judge(batch, number, out, s))
        log.info("batch %(batch)d: read %(read)d texts; wrote %(written)d rows, %(anomalies)d of them anomalies", told[-1])

    # a stream's path must be a folder or a pattern; as a pattern that names itself it may be a single file, too
    above, slash, name = documents.rstrip("/").rpartition("/")
    stream = source.parquet(f"{above}{slash}{{{name}}}").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %s to its end: %d new batches, %d texts; results are in %s/results", documents, len(told), sum(t["read"] for t in told), out)
    return told


def read(spark: SparkSession, out: str) -> DataFrame:
    """All results so far."""
    return spark.read.schema(SCHEMA).parquet(f"{out}/results")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--documents", "--out", "--checkpoint"):
        args.add_argument(name, required=True)
    args.add_argument("--config", default=CONFIG)
    a = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_watch").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, a.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
