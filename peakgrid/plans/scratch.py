"""Intermediate tables in the folder that the driver and all executors share, and orders over whole tables without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, in local mode, a temporary folder is set instead."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="peakgrid-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/peakgrid-{spark.sparkContext.applicationId}"


#: Folders of the scopes that are open, the innermost last.
_scopes: list[str] = []


def table(df: DataFrame, path: str | None = None) -> DataFrame:
    """As cut(), but as compressed Parquet at path, or else in the innermost scope's folder. release() deletes all such tables of the application."""
    spark = df.sparkSession
    path = path or f"{_scopes[-1] if _scopes else scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are deleted at the end; what reads them must be written before, to a path of its own."""
    _scopes.append(f"{scratch(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, _scopes.pop())


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the application's scratch tables. Results that still read them must have been written before."""
    delete(spark, scratch(spark))


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with running totals in the order of columns that identify a row: for each new name the sum of a column over all rows up to this one.

    Rows are sorted by ranges; each range's totals, a row per partition, are added up on the driver and put in front of the range's own
    running totals. No task sees more than its range.
    """
    names = list(sums)
    part = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    part = table(part)
    totals = sorted(part.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).collect(), key=lambda r: r["_part"])
    before: dict[str, list] = {n: [] for n in names}
    so_far = dict.fromkeys(names, 0)
    at = {r["_part"]: r for r in totals}
    for k in range(max(at, default=-1) + 1):
        for n in names:
            before[n].append(so_far[n])
            so_far[n] += (at[k][n] or 0) if k in at else 0
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = part.select(*df.columns, "_part", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    lift = lambda n: F.coalesce(F.col(n), F.lit(0)) + F.get(F.array(*[F.lit(b) for b in before[n] or [0]]), F.col("_part"))
    return own.select(*df.columns, *[lift(n).alias(n) for n in names])


def carried(df: DataFrame, order: list[str], value: str, name: str, key: str | None = None) -> DataFrame:
    """df with name: the last value that isn't null up to a row, in the order of columns that identify a row; with key, which then comes first in the order, of rows of equal key alone.

    As in running(), no task sees more than its range of rows, and the driver one row per range.
    """
    order = ([key] if key else []) + order
    part = table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    last = part.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max(F.struct(*order, F.col(value).alias("_value"))).alias("_last")).collect()
    at = {r["_part"]: r["_last"] for r in last}
    values, keys, now = [], [], None
    for k in range((part.agg(F.max("_part")).first()[0] or 0) + 1):
        values.append(now and now["_value"])
        keys.append(now and key and now[key])
        now = at.get(k, now)
    kind = df.schema[value].dataType
    own = F.last(value, True).over(Window.partitionBy("_part", *([key] if key else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_part"))
    if key:
        before = F.when(F.col(key) == F.get(F.array(*[F.lit(v).cast(df.schema[key].dataType) for v in keys]), F.col("_part")), before)
    return part.select(*df.columns, F.coalesce(own, before).alias(name))
