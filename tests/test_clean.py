import random

import numpy as np
import pytest
from peakgrid.operators import encoding, peaks
from peakgrid.params import Params

SCHEMA = "spectrum_id long, precursor_mz double, precursor_charge int, peaks array<struct<mz: double, intensity: double>>, note string"


def odd_spectra(n=600, seed=5):
    rng = random.Random(seed)
    mzs = [100.0, 101.0, 150.0, 249.5, 250.0, 251.5, 300.0, 400.0, 1500.0, 1600.0, None, float("nan"), float("inf")]
    strengths = [0.0, 0.5, 1.0, 1.0, 2.0, 50.0, 100.0, -1.0]
    rows = []
    for i in range(n):
        odd = [None, float("nan"), float("inf")] if i % 5 == 0 else [3.0]
        got = [(rng.choice(mzs), rng.choice(strengths + odd)) if rng.random() > 0.02 else None for _ in range(rng.choice([0, 1, 2, 4, 9, 30]))]
        if i % 3:
            got.sort(key=lambda p: (p is None, p is not None and (p[0] is None or p[0] != p[0]), (p and p[0]) or 0.0))
        rows.append((i, rng.choice([250.0, 151.0, 126.0, 700.0, None]), rng.choice([1, 2, 3, 0, -1, None]), None if i % 50 == 7 else got, f"n{i}"))
    return rows


def plain(df):
    return sorted((r["spectrum_id"], r["note"], r["bucket"], repr([(p["mz"], p["intensity"]) for p in r["peaks"]])) for r in df.collect())


@pytest.mark.parametrize("change", [{}, {"max_peaks_used": 3}, {"min_intensity": 0.5}, {"scaling": "root"}, {"min_peaks": 0, "min_mz_range": 0.0}, {"cluster_charges": (1, 2)}])
def test_batches_are_cleaned_as_expressions_clean_rows(spark, change):
    p = Params(min_peaks=2, min_mz_range=50.0).with_(**change)
    df = spark.createDataFrame(odd_spectra(), SCHEMA)
    got = peaks.preprocess(df, p)
    want = peaks.assign_bucket(peaks.filter_charges(peaks.by_expressions(df, p), p.cluster_charges), p.mz_interval)
    assert got.schema.names == want.schema.names
    assert plain(got) == plain(want)
    assert got.count() > 20


def test_the_chain_is_not_copied_into_filters(spark):
    p = Params(min_peaks=2, min_mz_range=50.0)
    plan = peaks.preprocess(spark.createDataFrame(odd_spectra(20), SCHEMA), p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(") <= 1


def test_sums_over_peaks_are_those_of_a_loop():
    rng = np.random.default_rng(3)
    levels, ids = encoding.md5_codebooks(64, 16, 40)
    count = np.array([0, 3, 1, 0, 7, 2])
    end = count.cumsum()
    lv, m = rng.integers(0, 17, end[-1]), rng.integers(0, 40, end[-1])
    want = [(levels[lv[e - c : e]] * ids[m[e - c : e]]).sum(0, dtype=int) for c, e in zip(count, end, strict=True)]
    assert (encoding.signs(levels, ids, lv, m, end - count, count) == np.array(want)).all()


@pytest.mark.parametrize("dim", [32, 64, 2048])
def test_vectors_are_added_up_in_lanes(dim):
    """No counter per bit and spectrum: sums of up to 70 peaks in binary digits across words, ties and spectra without peaks included."""
    r = np.random.default_rng(5)
    levels, ids = (r.choice([-1, 1], (n, dim)).astype(np.int8) for n in (17, 40))
    count = np.r_[0, 1, 2, 3, 4, 7, 8, 70, r.integers(0, 20, 200)]
    end = count.cumsum()
    lv, m = r.integers(0, 17, end[-1]), r.integers(0, 40, end[-1])
    want = encoding.pack(encoding.signs(levels, ids, lv, m, end - count, count) > 0)
    got = encoding.majorities(encoding.lanes(levels), encoding.lanes(ids), lv, m, end - count, count)
    assert (got.view("<u4").astype(np.int64) == want).all()


@pytest.mark.parametrize("hot", [4_096, 3])
def test_packed_vectors_give_the_same_clusters(spark, data, hot):
    from peakgrid.operators import tiles
    from peakgrid.plans import testdata

    p = Params(min_peaks=2, min_mz_range=50, mz_interval=80, hd_dim=128, eps=0.45, precursor_tol=2000)
    clean = peaks.preprocess(testdata.spectra(spark, data), p)
    found = []
    for packed in (False, True):
        df = encoding.encode(clean, p, packed=packed).drop("peaks")
        assert dict(df.dtypes)["hv"] == ("binary" if packed else "array<bigint>")
        marked = tiles.medoids(tiles.dbscan(df, 2000, 128, 0.45, hot=hot).cache(), 2000, 128, hot=hot)
        found.append(sorted((r.spectrum_id, r.cluster or -1, r.is_representative) for r in marked.collect()))
    assert found[0] == found[1] and len({c for _, c, _ in found[0]}) > 1
