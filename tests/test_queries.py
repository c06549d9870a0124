"""Each query runs, and equals its SQL where it has one."""

import __spark_entry__
import duckdb
import numpy as np
import pytest
from peakgrid.operators import baselines
from peakgrid.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(cols).collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    want = duck.sql(queries.ORACLES[name])
    names = list(want.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = queries.QUERIES["charge_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderpriority:string>" in plan
    plan = queries.QUERIES["truth_semi_join"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(far, far[near, -1]).mean(1) + 1e-10)
    return -lrd[near].mean(1) / lrd


def test_lof_sees_all_dimensions(spark, tmp_path):
    r = np.random.default_rng(8)
    x = np.c_[np.tile([1.0, 2, 3, 4], (70, 1)), r.standard_normal((70, 60))].round(6)  # all are copies in their first 4 dimensions
    x[7, 50] += 40
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[7].tolist())], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.spectrum_id: r for r in queries.QUERIES["lof_outliers"](spark, str(tmp_path)).collect()}
    want = brute_lof(x, 20)
    assert len(got) == 71 and got[100].score == got[7].score
    assert np.allclose([got[i].score for i in range(70)], want, atol=1e-9)
    assert [got[i].outlier for i in range(70)] == (want < np.percentile(want, 5)).tolist() and got[7].outlier and got[100].outlier


def test_lof_of_the_table_is_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float).round(6)
    key, back = np.unique(x, axis=0, return_inverse=True)
    got = {r.spectrum_id: r.score for r in queries.QUERIES["lof_outliers"](spark, data).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], brute_lof(key, 20)[back.ravel()], atol=1e-6)


@pytest.mark.parametrize("name, rows", [("ocsvm", 10_000), ("gods", 20_000)])
def test_one_class_fits_ask_for_the_references_rows(spark, data, monkeypatch, name, rows):
    asked, sample = [], baselines.sample
    monkeypatch.setattr(baselines, "sample", lambda df, n=baselines.SAMPLE: (asked.append(n), sample(df, n))[1])
    queries.QUERIES[name](spark, data)
    assert asked == [rows]


def dense(spark, data):
    rows = sorted(queries.vectors(spark, data).collect(), key=lambda r: r.spectrum_id)
    return [r.spectrum_id for r in rows], np.array([list(r.x) for r in rows])


def test_ocpca_is_the_distance_to_a_plane_of_components(spark, data):
    ids, x = dense(spark, data)
    z = x - x.mean(0)
    parts = np.linalg.svd(z, full_matrices=False)[2][:5]
    want = -np.linalg.norm(z - z @ parts.T @ parts, axis=1)
    got = {r.spectrum_id: r for r in queries.QUERIES["ocpca"](spark, data).collect()}
    assert len(got) == len(ids) and np.allclose([got[i].score for i in ids], want, atol=1e-8)
    assert [got[i].outlier for i in ids] == (np.array([got[i].score for i in ids]) < np.percentile([got[i].score for i in ids], 1)).tolist()


def test_projection_is_on_the_first_component(spark, data):
    got = {r.spectrum_id: r.pc1 for r in queries.QUERIES["pca_projection"](spark, data).collect()}
    ids, x = dense(spark, data)
    z = x - x.mean(0)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][0]
    mine = np.array([got[i] for i in ids])
    assert np.allclose(mine, want, atol=1e-6) or np.allclose(-mine, want, atol=1e-6)


def test_svm_meets_the_conditions_of_its_dual(spark, data):
    """On the rows that it was fitted on about nu are outliers, and scores are higher where the kernel's density is."""
    got = queries.QUERIES["ocsvm"](spark, data).collect()
    share = sum(r.outlier for r in got) / len(got)
    assert all(r.outlier == (r.score < 0) for r in got) and abs(share - 0.05) < 0.02


def test_forest_isolates_as_its_depths_say(spark, data):
    ids, x = dense(spark, data)
    got = {r.spectrum_id: r for r in queries.QUERIES["isolation_forest"](spark, data).collect()}
    score = np.array([got[i].score for i in ids])
    assert ((score < 0) & (score >= -1)).all()
    assert [got[i].outlier for i in ids] == (score < np.percentile(score, 1)).tolist()
    far = np.linalg.norm(x - np.median(x, 0), axis=1)
    assert score[np.argsort(far)[-30:]].mean() < score[np.argsort(far)[:300]].mean()  # what lies far is isolated sooner
