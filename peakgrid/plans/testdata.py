"""Spectra, peaks and hypervectors made of the test tables, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables in DuckDB's SQL; queries build on spec and peak.
SQL = """
spec AS (
  SELECT o_orderkey AS spectrum_id, 50 + o_totalprice / 1000 AS precursor_mz, cast(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 + 1 AS precursor_charge,
    cast(date_diff('day', DATE '1992-01-01', cast(o_orderdate AS DATE)) AS DOUBLE) AS retention_time, concat('c', o_custkey) AS identifier, cast(o_orderkey AS INTEGER) AS scan
  FROM orders),
peak AS (
  SELECT l_orderkey AS spectrum_id, round(100 + l_partkey % 1400 + l_linenumber / 100::DOUBLE, 2) AS mz, l_extendedprice AS intensity FROM lineitem)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum_id"), F.round(100 + F.col("l_partkey") % 1400 + F.col("l_linenumber") / F.lit(100.0), 2).alias("mz"), F.col("l_extendedprice").alias("intensity"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("spectrum_id"),
        (50 + F.col("o_totalprice") / 1000).alias("precursor_mz"),
        (F.substring("o_orderpriority", 1, 1).cast("int") % 3 + 1).alias("precursor_charge"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("retention_time"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("identifier"),
        F.col("o_orderkey").cast("int").alias("scan"),
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra with their peaks in order of m/z. An order has a few dozen lines at most, so that a group is small."""
    grouped = peaks(spark, sf_dir).groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    return meta(spark, sf_dir).join(grouped, "spectrum_id")


def long_peaks(df: DataFrame) -> DataFrame:
    """A row per peak."""
    return df.select("spectrum_id", F.explode("peaks").alias("p")).select("spectrum_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def hypervectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, hv): the sign bits of the embeddings as two 32-bit words, least bit first."""
    word = lambda k: F.aggregate(F.transform(F.slice("embedding", 32 * k + 1, 32), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(word(0), word(1)).alias("hv"))


#: hv as above, one column per word.
HV_SQL = """
bits AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
vec AS (
  SELECT vec_id, label, cast(sum(CASE WHEN x > 0 AND i < 32 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS w0, cast(sum(CASE WHEN x > 0 AND i >= 32 THEN 1::BIGINT << (i - 32) ELSE 0 END) AS BIGINT) AS w1
  FROM bits GROUP BY vec_id, label)"""
