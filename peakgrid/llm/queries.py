"""The corpus operators as queries over the test tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_packing, decontaminate, html_text, language, licenses, merkle, packing, quality_pu, quality_rules, sharding, simhash, warc
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.place(read(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.apply(docs, language.fit(docs), ["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality_pu.apply(docs, quality_pu.fit(docs, read(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", quality_pu.in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(read(spark, sf_dir, "documents"), tokenizer())


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.placed(read(spark, sf_dir, "documents"), byte_tokenizer())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op7 alone, without its trees."""
    return quality_rules.apply(read(spark, sf_dir, "documents"), None).drop("score", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_hilbert_shards, op3_license_scan, op4_decontaminate, op5_html_text, op6_warc, op7_quality_rules, op8_language_id, op9_quality_pu, op10_packing, op11_curve_packing, op12_merkle_manifest, text_counts)}

SQL: dict[str, str] = {"op3_license_scan": licenses.sql(licenses.TEMPLATES), "op4_decontaminate": decontaminate.SQL, "op6_warc": warc.SQL, "op12_merkle_manifest": merkle.SQL, "text_counts": quality_rules.SQL}
