"""Clusters and medoids by tiles: those of the pairs, with hot bands, copies and small tiles; and many copies through whole runs."""

import numpy as np
import pytest
from peakgrid.operators import clustering, distances, tiles
from peakgrid.params import Params
from peakgrid.plans import runs
from pyspark.sql import functions as F

SCHEMA = "spectrum_id long, precursor_charge int, bucket int, precursor_mz double, hv array<long>"


def spectra(seed, n, kinds=25):
    """Most in one hot band, near copies of few vectors, exact copies too."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 32, (kinds, 2))
    out = []
    for i in range(n):
        hv = base[r.integers(0, kinds)].copy()
        for b in r.choice(64, r.integers(0, 9), replace=False):
            hv[b // 32] ^= 1 << b % 32
        mz = 500.0 + (0 if r.random() < 0.6 else int(r.integers(-6, 7)) * 0.006)
        out.append((int(i * 3 + 1), 1 + int(r.random() < 0.1), 4, mz, hv.tolist()))
    return out + [(10 * n + k, *out[k % 7][1:]) for k in range(30)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).fillna(-1).collect())


@pytest.mark.parametrize("hot, tile", [(0, 16), (20, 16), (20, 1024), (10_000, 16)])
@pytest.mark.parametrize("mode, tol", [("ppm", 20), ("Da", 0.01)])
def test_tiles_equal_pairs(spark, hot, tile, mode, tol):
    df = spark.createDataFrame(spectra(5, 220), SCHEMA).cache()
    edges = distances.masked_pairs(df, tol, 64, mode).cache()
    for least in (1, 2):
        want = clustering.dbscan(df, edges, 0.13, least)
        got = tiles.dbscan(df, tol, 64, 0.13, mode, least, tile, hot)
        assert rows(got, "spectrum_id", "cluster") == rows(want, "spectrum_id", "cluster")
    assert len({c for _, c in rows(got, "spectrum_id", "cluster")}) > 5
    marks = rows(tiles.medoids(want, tol, 64, mode, tile, hot), "spectrum_id", "cluster", "is_representative")
    assert marks == rows(clustering.medoids(want, edges), "spectrum_id", "cluster", "is_representative")


@pytest.mark.parametrize("mode, tol", [("ppm", 20), ("Da", 0.01)])
def test_strips_meet_at_their_edges(spark, mode, tol):
    """Pairs and chains on both sides of the edges of strips, with rising and falling ids."""
    r = np.random.default_rng(3)
    mz = np.cumsum(r.uniform(0, 0.011, 2_000)) + 500.0
    ids = r.permutation(2_000)
    base = r.integers(0, 1 << 32, (2, 2))
    df = spark.createDataFrame([(int(i), 1, 4, float(m), base[r.integers(0, 2)].tolist()) for i, m in zip(ids, mz, strict=True)], SCHEMA).cache()
    edges = distances.masked_pairs(df, tol, 64, mode).cache()
    want = clustering.dbscan(df, edges, 0.13).cache()
    assert rows(tiles.dbscan(df, tol, 64, 0.13, mode), "spectrum_id", "cluster") == rows(want, "spectrum_id", "cluster")
    marks = rows(tiles.medoids(want, tol, 64, mode), "spectrum_id", "cluster", "is_representative")
    assert marks == rows(clustering.medoids(want, edges), "spectrum_id", "cluster", "is_representative")


@pytest.mark.parametrize("hot", [0, 20, 4_096])
def test_nearest_equals_pairs(spark, hot):
    df = spark.createDataFrame(spectra(7, 150) + [(1_000_000, 1, 4, 900.0, [1, 1])], SCHEMA).cache()
    ends = distances.masked_pairs(df, 20, 64).select(F.explode(F.array("id_a", "id_b")).alias("spectrum_id"), "dist")
    want = {r[0]: r[1] for r in ends.groupBy("spectrum_id").agg(F.min("dist")).collect()}
    got = tiles.nearest(df, 20, 64, tile=16, hot=hot).where("d is not null").collect()
    assert {r.spectrum_id: r.d for r in got} == want and len(got) == len(want) > 100


def test_pairs_of_a_band_are_not_rows(spark):
    """3,000 spectra in reach of each other make labels and sums in proportion, though no band counts as hot."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 1, 4, 500.0 + i * 1e-6, r.integers(0, 1 << 32, 2).tolist()) for i in range(3_000)], SCHEMA).cache()
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    made: list[str] = []
    keep = tiles.strips.table
    tiles.strips.table = lambda d: made.append(plan(d)) or keep(d)
    try:
        found = tiles.dbscan(df, 20, 64, 0.3)
    finally:
        tiles.strips.table = keep
    assert len(made) == 1 and "Join" not in made[0]
    assert found.count() == 3_000


def test_spectra_without_vectors_stand_alone(spark):
    df = spark.createDataFrame([(1, 1, 1, 500.0, None), (2, 1, 1, None, [1, 1]), (3, 1, 1, 500.0, [1, 1]), (4, 1, 1, 500.0, [1, 1])], SCHEMA)
    for hot in (0, 100):
        got = {r.spectrum_id: r.cluster for r in tiles.dbscan(df, 20, 64, 0.1, hot=hot).collect()}
        assert got == {1: None, 2: None, 3: 3, 4: 3}
    assert tiles.dbscan(df.limit(0), 20, 64, 0.1).count() == 0


def test_many_copies_through_whole_runs(spark, tmp_path):
    """50,000 copies of one spectrum among others: pairs of copies are never made."""
    few = spark.createDataFrame(spectra(6, 60), SCHEMA)
    hot = spark.range(50_000).select((F.col("id") + 1_000_000).alias("spectrum_id"), F.lit(1).alias("precursor_charge"), F.lit(4).alias("bucket"), F.lit(500.0).alias("precursor_mz"), F.array(F.lit(123).cast("long"), F.lit(456).cast("long")).alias("hv"))
    df = few.unionByName(hot).withColumn("identifier", F.lit("f")).withColumn("scan", F.col("spectrum_id").cast("int")).withColumn("retention_time", F.lit(1.0))
    p = Params(hd_dim=64, eps=0.13, cluster_alg="dbscan", batch_size=40_000)
    made = runs.cluster(df, p)
    hot_rows = made.where("spectrum_id >= 1000000").groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("is_representative").alias("r")).collect()
    assert [(r.n, r.r) for r in hot_rows] == [(50_000, 1)]
    test = df.where("spectrum_id % 2 = 0").withColumn("spectrum_id", F.col("spectrum_id") + 10_000_000)
    found = runs.detect_run(df, test, p, str(tmp_path))
    again = found.where("spectrum_id >= 11000000").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("c"), F.count_if("anomaly").alias("a")).first()
    assert (again.n, again.c, again.a) == (25_000, 1, 0)
