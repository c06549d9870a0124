"""Exact neighbours and exact percentiles against numpy and Spark's own aggregate."""

import numpy as np
import pytest
from peakgrid.operators import knn, quantiles
from pyspark.sql import functions as F


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
    return out


def clouds(r):
    return np.concatenate([r.standard_normal((300, 3)) * 0.01, r.standard_normal((200, 3)) * 0.5 + 10, r.standard_normal((100, 3)) + np.array([50, 0, 0])])


CASES = {
    "gauss": lambda r: r.standard_normal((600, 5)),
    "clusters": clouds,
    "ties": lambda r: r.integers(0, 4, (500, 3)).astype(float),
    "long vectors": lambda r: np.exp(r.standard_normal((300, 6)) * 3) * 1e4,
    "many dimensions": lambda r: r.standard_normal((400, 64)),
    "fewer than k": lambda r: r.standard_normal((5, 3)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_neighbours_are_those_of_all_pairs(spark, name):
    """Small blocks, so that cells are dealt, split and left out."""
    r = np.random.default_rng(3)
    x = CASES[name](r)
    ids = r.permutation(3 * len(x))[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "point long, x array<double>")
    got = {}
    for p, o, d in knn.nearest(df, 7, blocks=6, least=8).collect():
        got.setdefault(p, []).append((o, d))
    got = {p: sorted(v, key=lambda t: (t[1], t[0])) for p, v in got.items()}
    assert got == brute(ids, x, 7)


def test_far_cells_are_left_out(spark):
    """Three clouds far from each other: a block takes the cells of its own alone."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal((400, 3)) + c for c in (0, 1000, 2000)])
    seen = []
    taken = knn.table

    def spy(df):
        out = taken(df)
        if out.columns == ["to", "cell", "rank"]:
            seen.append((out.groupBy("to").count().agg(F.max("count")).first()[0], out.select("cell").distinct().count()))
        return out

    knn.table = spy
    try:
        knn.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point long, x array<double>"), 5, blocks=12, least=8).count()
    finally:
        knn.table = taken
    most, cells = seen[0]
    assert most < 0.6 * cells


def test_neighbours_of_one_and_none(spark):
    assert knn.nearest(spark.createDataFrame([(5, [1.0, 2.0])], "point long, x array<double>"), 1).count() == 0
    assert knn.nearest(spark.createDataFrame([], "point long, x array<double>"), 3).count() == 0


VALUES = {
    "normal": lambda r: r.standard_normal(5_000),
    "ties": lambda r: r.integers(0, 5, 3_000).astype(float),
    "one hot value": lambda r: np.where(r.random(4_000) < 0.6, 1.5, r.standard_normal(4_000)),
    "few": lambda r: r.standard_normal(7),
    "one": lambda r: np.array([3.0]),
}


@pytest.mark.parametrize("name", list(VALUES))
def test_percentiles_are_exact(spark, name):
    v = VALUES[name](np.random.default_rng(0))
    df = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(v)] + [(None, 1), (None, 9)], "v double, g int").repartition(5)
    for share in (0.0, 0.013, 0.5, 0.9, 1.0):
        want = df.agg(F.percentile("v", share)).first()[0]
        assert quantiles.percentile(df, "v", share, last=20) == pytest.approx(want, abs=1e-12)
        assert quantiles.percentile_by(df, [], "v", share).first()["at"] == pytest.approx(want, abs=1e-12)
    got = {r["g"]: r["at"] for r in quantiles.percentile_by(df, ["g"], "v", 0.37).collect()}
    want = {r["g"]: r["p"] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", 0.37).alias("p")).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double, g int")
    assert quantiles.percentile(df, "v", 0.5) is None
    assert quantiles.percentile_by(df, ["g"], "v", 0.5).count() == 0
