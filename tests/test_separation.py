"""Separation along strips, and in hot bands by a join, against plain loops."""

import math

import numpy as np
import pytest
from peakgrid.operators import distances, separation, strips
from pyspark.sql import functions as F

SCHEMA = "spectrum_id long, bucket int, precursor_mz double, hv array<long>, cluster long, is_representative boolean"


def spectra(mode, n=260):
    """Two buckets, precursors over many bands with edges of strips and ties among them, clusters of all sizes, some over several strips; noise, and a spectrum without a vector."""
    r = np.random.default_rng(7)
    wide = 40e-6 if mode == "ppm" else 1.0
    rows = []
    for k in range(n):
        cluster = int(r.integers(0, 45))
        mz = float(500.0 * math.exp((cluster % 9 * 8 + r.integers(0, 70) * (r.random() < 0.3)) * wide + r.choice([0, 0.3, 0.5]) * wide)) if mode == "ppm" else float(100 + cluster % 9 * 8 + r.integers(0, 3) / 2)
        hv = [int(x) for x in r.integers(0, 1 << 4, 2)]
        rows.append((k, cluster % 2, mz, None if k == 11 else hv, None if k % 17 == 0 else cluster, bool(r.random() < 0.1)))
    return rows


def plain(rows, tol, mode):
    """{cluster: (bucket, size, avg_intra, max_intra, nearest_cluster, cluster_min_sep, cluster_avg_sep, cluster_p50_sep)}"""
    member = {}
    for x in rows:
        if x[4] is not None:
            member.setdefault(x[4], []).append(x)
    rep = {c: min(m, key=lambda x: (not x[5], x[0])) for c, m in member.items()}

    def dist(x, y):
        gap = abs(x[2] - y[2])
        if (gap / y[2] >= tol * 1e-6) if mode == "ppm" else (gap >= tol):
            return 1.0
        return None if x[3] is None or y[3] is None else sum((a ^ b).bit_count() for a, b in zip(x[3], y[3], strict=True)) / 64

    out = {}
    for c, m in member.items():
        own = [d for d in (dist((0, 0, rep[c][2], rep[c][3]), x) if mode != "ppm" else own_ppm(rep[c], x, tol) for x in m) if d is not None]
        others = [o for o in member if o != c and rep[o][1] == rep[c][1]]
        seen = {o: [1.0 if (d := dist(x, rep[o])) is None else d for x in m] for o in others}
        least = [min(seen[o][k] for o in others) for k in range(len(m))]
        nearest = min(others, key=lambda o: (round(sum(seen[o]) / len(m), 9), o))
        out[c] = (rep[c][1], len(m), float(np.mean(own)), max(own), nearest, min(least), float(np.mean(least)), float(np.median(least)))
    return out


def own_ppm(rep, x, tol):
    """The distance of a representative to a member, in ppm of the member."""
    if abs(rep[2] - x[2]) / x[2] >= tol * 1e-6:
        return 1.0
    return None if x[3] is None or rep[3] is None else sum((a ^ b).bit_count() for a, b in zip(x[3], rep[3], strict=True)) / 64


@pytest.mark.parametrize(("mode", "tol"), [("ppm", 20), ("da", 0.6)])
@pytest.mark.parametrize("hot", [4_096, 6])
def test_separation_equals_loops(spark, mode, tol, hot):
    rows = spectra(mode)
    df = spark.createDataFrame(rows, SCHEMA)
    got = separation.separation(df, tol, 64, mode, hot=hot).collect()
    want = plain(rows, tol, mode)
    assert len(got) == len(want) > 30
    for x in got:
        w = want[x.cluster]
        assert (x.bucket, x.size, x.nearest_cluster) == (w[0], w[1], w[4])
        assert (x.avg_intra, x.max_intra, x.cluster_min_sep, x.cluster_avg_sep, x.cluster_p50_sep) == pytest.approx((w[2], w[3], *w[5:]))
    assert any(x.cluster_min_sep < 1 for x in got)


def test_members_and_representatives_are_not_paired_as_rows(spark):
    """4,000 members of 500 clusters within tolerance of each other: a row or two per cluster and distance, no row per pair."""
    df = spark.range(4_000).select(F.col("id").alias("spectrum_id"), F.lit(1).alias("bucket"), F.lit(100.0).alias("precursor_mz"), F.array(F.hash("id").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("long")).alias("hv"), (F.col("id") % 500).alias("cluster"))
    reps = df.where("spectrum_id < 500").select("cluster", "bucket", "precursor_mz", "hv", F.lit(8).cast("long").alias("size"))
    got = strips.separations(df.withColumn("own", F.lit(0.5)), reps, 20, 64)
    assert got.where("o is not null").count() == 500 and got.where("o is null").agg(F.sum("n")).first()[0] == 4_000
    assert got.count() <= 4_500
    pair = df.alias("a").join(reps.alias("b"), F.col("a.cluster") != F.col("b.cluster")).select("a.cluster", F.col("b.cluster").alias("o"), distances.hamming("a.hv", "b.hv", 64).alias("d"))
    best = pair.groupBy("cluster", "o").agg(F.sum(1 - F.col("d")).alias("s")).groupBy("cluster").agg(F.min(F.struct(-F.col("s"), "o"))["o"].alias("o"))
    assert {(r.cluster, r.o) for r in got.where("o is not null").collect()} == {(r.cluster, r.o) for r in best.collect()}
