import numpy as np
import pytest
from peakgrid.operators import clustering, distances, strips, tiles

from tests.test_tiles import SCHEMA, rows, spectra


@pytest.mark.parametrize("how", ["complete", "average"])
def test_rounds_of_merges_make_the_clusters_of_a_matrix(how):
    r = np.random.default_rng(11)
    for n in (2, 5, 20, 60):
        for _ in range(20):
            d = np.triu(r.integers(0, 9, (n, n)) / 8, 1)  # many ties
            d[r.random((n, n)) < 0.3] = 1.0
            d = np.triu(d, 1) + np.triu(d, 1).T
            copies = r.integers(1, 4, n)
            a, b = np.nonzero(np.triu(d < 1, 1))
            dist, eps = d[a, b], float(r.choice([0.25, 0.5, 0.7]))
            if how == "complete":
                a, b, dist = a[dist <= eps], b[dist <= eps], dist[dist <= eps]
            assert (strips.merges(a, b, dist, copies, eps, how) == clustering.linkage_labels(d, eps, how, copies)).all()


@pytest.mark.parametrize("most", [0, 300, tiles.PAIRS])
@pytest.mark.parametrize("how, mode, tol", [("complete", "ppm", 20), ("average", "ppm", 20), ("average", "Da", 0.01)])
def test_components_are_linked_without_a_table_of_pairs(spark, how, mode, tol, most, monkeypatch):
    df = spark.createDataFrame([*spectra(8, 90), (7_000_001, 1, 4, None, [1, 2]), (7_000_002, 1, 4, 500.0, None)], SCHEMA).cache()
    want = rows(clustering.hierarchical_of_copies(df, lambda p: distances.masked_pairs(p, tol, 64, mode), 0.2, how), "spectrum_id", "cluster")
    if most == tiles.PAIRS:
        monkeypatch.setattr(tiles, "masked_pairs", None)
    got = tiles.hierarchical(df, tol, 64, 0.2, how, mode, most)
    assert got.columns == [*df.columns, "cluster"]
    assert rows(got, "spectrum_id", "cluster") == want
    assert 5 < len({c for _, c in want}) < len(want)


@pytest.mark.parametrize("how", ["complete", "average"])
@pytest.mark.parametrize("mode, tol", [("ppm", 20), ("Da", 0.01)])
def test_a_long_component_is_linked_as_points_come(how, mode, tol):
    r = np.random.default_rng(3)
    for dim, copied, come in ((64, 1, 1), (96, 4, 8), (128, 4, 1 << 20)):
        n = 150
        mz, ids = np.sort(500 + np.round(r.random(n) * 0.12, 4)), r.permutation(9 * n)[:n]
        w = r.integers(0, 1 << 32, (12, dim // 32), np.uint64).astype(np.uint32)[r.integers(0, 12, n)]
        w[:, 0] ^= r.integers(0, 1 << 16, n, np.uint64).astype(np.uint32)
        w = w if dim % 64 else np.ascontiguousarray(w).view(np.uint64)
        copies, order = r.integers(1, copied + 1, n), np.argsort(ids)
        d = np.ones((n, n))
        for i, j in strips.sweep(np.zeros(n), mz, ids, tol, mode):
            d[i, j] = d[j, i] = strips.differing(w, i, j) / dim
        for eps in (0.1, 0.3, 0.45):
            want = np.empty(n, np.int64)
            want[order] = ids[order][clustering.linkage_labels(d[np.ix_(order, order)], eps, how, copies[order])]
            got = strips.dense(ids, mz, w, copies, tol, mode, dim, eps, how, come)
            assert (got == want).all()
            assert 10 < len(np.unique(got)) < n


def test_a_component_of_many_pairs_needs_no_table_of_pairs(spark, monkeypatch):
    n = 7_200  # in two bands, so that about 1.5 * 7,000 * 7,000 / 2 pairs are possible, more than 2^25
    r, edge = np.random.default_rng(4), np.exp(2 * np.log1p(20e-6) * 155_363)
    rows = [(k, 2, 7, float(edge * (1 + (7e-6 if k % 2 else -7e-6))), [int(v), 0]) for k, v in enumerate(r.integers(0, 1 << 16, n))]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    monkeypatch.setattr(tiles, "masked_pairs", None)
    got = tiles.hierarchical(df, 20, 64, 0.08, "average").groupBy("cluster").count().collect()
    assert sum(x["count"] for x in got) == n
    assert 1 < len(got) < n / 2
