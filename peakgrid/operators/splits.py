"""Deterministic samples and splits: all draws are by md5 of an id, the same on every engine and at every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import running


def draw(column: str | F.Column, salt: str = "") -> F.Column:
    """A text that orders ids at random."""
    c = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat(F.lit(salt), c.cast("string")))


def train_test(df: DataFrame, split_size: int = 2, test_share: float = 0.4, mark: str = "anomalies") -> DataFrame:
    """df with part: train or test; rows that are in neither are left out.

    Spectra whose identifier contains mark are test. Other spectra of clusters that hold such ones are left out. Clusters of up to
    split_size are train; others are split per cluster and bucket, ceil(test_share * n) of n > 1 to test.
    """
    marked = F.coalesce(F.col("identifier").contains(mark), F.lit(False))
    bad = df.where(marked).select("cluster").distinct()
    normal = df.where(~marked).join(bad, "cluster", "left_anti")
    one, two = Window.partitionBy("cluster"), Window.partitionBy("cluster", "bucket")
    counted = normal.withColumn("_c", F.count("*").over(one)).withColumn("_n", F.count("*").over(two)).withColumn("_r", F.row_number().over(two.orderBy(draw("spectrum_id"))))
    test = (F.col("_c") > split_size) & (F.col("_n") > 1) & (F.col("_r") <= F.ceil(F.col("_n") * test_share))
    parts = counted.withColumn("part", F.when(test, "test").otherwise("train")).select(*df.columns, "part")
    return parts.unionByName(df.where(marked).withColumn("part", F.lit("test")))


def placed(df: DataFrame, id_col: str) -> DataFrame:
    """(id, place): places from 1 in random order. Ranges of the order are counted and ranked on their own; no task sees all rows."""
    drawn = df.select(id_col).withColumn("_draw", draw(id_col)).withColumn("_one", F.lit(1))
    return running(drawn, ["_draw", id_col], {"place": "_one"}).select(id_col, "place")


def ratio_split(df: DataFrame, ratio: float, id_col: str = "spectrum_id") -> DataFrame:
    """df with part: first for int(ratio * n) of n rows in random order, else second. id_col must be unique."""
    n = int(ratio * df.count())
    return df.join(placed(df, id_col), id_col).withColumn("part", F.when(F.col("place") <= n, "first").otherwise("second")).drop("place")


def sample_percent(df: DataFrame, percent: float, id_col: str = "spectrum_id") -> DataFrame:
    """max(1, round(percent of n)) rows without replacement. id_col must be unique."""
    n = max(1, round(df.count() * percent / 100))
    return df.join(placed(df, id_col).where(F.col("place") <= n).select(id_col), id_col, "left_semi")


def balanced_split(df: DataFrame, parts: int, width: float = 50.0, mz: str = "mz", id_col: str | None = None) -> DataFrame:
    """df with part from 1 to parts: within each m/z bin (0, width], (width, 2 width], ... the rows, in an order drawn from id_col (mz itself if not given), are dealt into chunks whose sizes differ by one at most, the larger first."""
    binned = df.withColumn("_bin", F.ceil(F.col(mz) / width).cast("int")).where("_bin >= 1")
    order = [draw(id_col or mz), F.col(id_col or mz)]
    return binned.withColumn("part", F.ntile(parts).over(Window.partitionBy("_bin").orderBy(*order))).drop("_bin")


def spatial_mass(df: DataFrame, low: float, high: float, image: str | None = None) -> DataFrame:
    """df of pixels (x, y) with pseudo_mass: low + ((ny + nx / max(w + 1, 1)) mod 1) * (high - low), with nx and ny scaled to 0..1 over the image and w its width. image: the column that tells images apart; without it all rows are one."""
    span = df.groupBy(*[image] if image else []).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    w, h = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    nx, ny = (F.col("x") - F.col("_x0")) / F.greatest(w, F.lit(1)), (F.col("y") - F.col("_y0")) / F.greatest(h, F.lit(1))
    mass = low + F.pmod(ny + nx / F.greatest(w + 1, F.lit(1)), F.lit(1.0)) * (high - low)
    placed = df.join(span, image) if image else df.crossJoin(F.broadcast(span))  # one row without image
    return placed.withColumn("pseudo_mass", mass).drop("_x0", "_x1", "_y0", "_y1")
