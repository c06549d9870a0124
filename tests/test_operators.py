import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from peakgrid.operators import anomaly, baselines, clustering, distances, encoding, graph, metrics, peaks, separation, splits
from peakgrid.params import Params
from peakgrid.plans import scratch
from pyspark.sql import functions as F

SPECTRA = "spectrum_id long, precursor_mz double, precursor_charge int, retention_time double, identifier string, scan int, peaks array<struct<mz:double,intensity:double>>"


def spectra(spark, rows):
    return spark.createDataFrame([(i, mz, z, 0.0, f"f{i}", i, p) for i, mz, z, p in rows], SPECTRA)


def only(df):
    return [(p.mz, p.intensity) for p in df.first().peaks]


def test_mz_range_is_inclusive(spark):
    df = spectra(spark, [(1, 500.0, 1, [(100.0, 1.0), (200.0, 2.0), (300.0, 3.0)])])
    assert only(peaks.filter_mz_range(df, 100, 200)) == [(100.0, 1.0), (200.0, 2.0)]
    assert len(only(peaks.filter_mz_range(df))) == 3
    assert only(peaks.filter_mz_range(df, 200)) == [(200.0, 2.0), (300.0, 3.0)]


def test_validity_limits(spark):
    df = spectra(spark, [(1, 500.0, 1, [(100.0, 1.0), (350.0, 2.0)]), (2, 500.0, 1, [(100.0, 1.0), (349.9, 2.0)]), (3, 500.0, 1, []), (4, 500.0, 1, None)])
    assert [r.spectrum_id for r in peaks.valid_spectra(df, 2, 250).collect()] == [1]


def test_precursor_removal_at_every_charge(spark):
    pmz, z = 300.0, 3
    neutral = (pmz - peaks.HYDROGEN) * z
    at = [neutral / c + peaks.HYDROGEN for c in (3, 2, 1)]
    rows = sorted([(m, 1.0) for m in at] + [(at[1] + 1.4, 1.0), (at[1] + 1.6, 1.0)])
    df = spectra(spark, [(1, pmz, z, rows)])
    assert [round(m, 4) for m, _ in only(peaks.remove_precursor(df, 1.5))] == [round(at[1] + 1.6, 4)]
    assert len(only(peaks.remove_precursor(df, 0.1, isotopes=1))) == 2
    assert len(only(peaks.remove_precursor(df, 10, "ppm"))) == 2
    assert len(only(peaks.remove_precursor(spectra(spark, [(1, pmz, 0, rows)]), 1.5))) == 5


def test_strongest_peaks_strictly_over_the_limit(spark):
    df = spectra(spark, [(1, 500.0, 1, [(100.0, 50.0), (110.0, 100.0), (120.0, 51.0), (130.0, 60.0)])])
    assert only(peaks.top_peaks(df, 3, 0.5)) == [(110.0, 100.0), (120.0, 51.0), (130.0, 60.0)]
    assert only(peaks.top_peaks(df, None, 0.5)) == [(110.0, 100.0), (120.0, 51.0), (130.0, 60.0)]
    assert only(peaks.top_peaks(df, 1, 0.0)) == [(110.0, 100.0)]
    assert peaks.top_peaks(spectra(spark, [(1, 500.0, 1, [])]), 3, 0.5).first().peaks == []


def test_scaling(spark):
    df = spectra(spark, [(1, 500.0, 1, [(1.0, 4.0), (2.0, 16.0), (3.0, 1.0)])])
    assert [i for _, i in only(peaks.scale_intensity(df, "root"))] == [2.0, 4.0, 1.0]
    assert [round(i, 9) for _, i in only(peaks.scale_intensity(df, "log"))] == [round(math.log2(1 + x), 9) for x in (4, 16, 1)]
    assert [i for _, i in only(peaks.scale_intensity(df, "rank"))] == [2.0, 3.0, 1.0]
    assert [i for _, i in only(peaks.scale_intensity(df, "off", max_intensity=8))] == [2.0, 8.0, 0.5]
    with pytest.raises(Exception, match="max_rank"):
        peaks.scale_intensity(df, "rank", max_rank=2).collect()
    with pytest.raises(ValueError):
        peaks.scale_intensity(df, "cube")


def test_norm_and_padding(spark):
    df = spectra(spark, [(1, 500.0, 1, [(1.0, 3.0), (2.0, 4.0)])])
    assert [i for _, i in only(peaks.normalize(df))] == [0.6, 0.8]
    row = peaks.pad(df, 4).first()
    assert row.mz == [1.0, 2.0, -1.0, -1.0] and row.intensity == [3.0, 4.0, -1.0, -1.0]


@pytest.mark.parametrize(("mz", "interval", "want"), [(500.07, 1, 5000), (500.07, 0.01, 500000), (99.99, 80, 12), (0.0, 80, 0)])
def test_buckets(spark, mz, interval, want):
    assert spark.range(1).select(peaks.bucket(F.lit(mz), interval)).first()[0] == want


def test_params_are_checked(tmp_path):
    with pytest.raises(ValueError):
        Params(hd_dim=100)
    with pytest.raises(ValueError):
        Params(cluster_alg="louvain")
    file = tmp_path / "c.ini"
    file.write_text("[DEFAULT]\neps = 0.26\ncluster_charges = 1 2 3\nrt_tol = none\ncluster_alg = dbscan\nmin_peaks = 1\n")
    p = Params.from_ini(str(file))
    assert (p.eps, p.cluster_charges, p.rt_tol, p.cluster_alg, p.min_peaks) == (0.26, (1, 2, 3), None, "dbscan", 1)


def test_production_codebook():
    levels, ids = encoding.codebooks(2048, 16, 50, 2.0)
    assert (levels[0] != levels[16]).sum() == 1024 and (levels[0] != levels[4]).sum() == 256
    assert 0 < (ids[0] != ids[1]).sum() < 1024
    n, start, end = encoding.codebook_length(101, 1500, 0.05)
    assert start <= 101 and end >= 1500 and n == math.ceil((end - start) / 0.05)


def test_packing_is_its_own_inverse():
    bits = np.random.default_rng(1).random((5, 96)) > 0.5
    assert (encoding.unpack(encoding.pack(bits)) == bits).all()


def test_encoders_agree_and_empty_spectra_are_zero(spark):
    rows = [(i, 500.0, 1, [(100.0 + 7 * i + j, (j + 1) / 9) for j in range(i)]) for i in range(9)]
    df = spectra(spark, rows)
    native = {r.spectrum_id: r.hv for r in encoding.encode_portable(df, 64, 16).collect()}
    fast = {r.spectrum_id: r.hv for r in encoding.encode(df, Params(hd_dim=64), portable=True).collect()}
    assert native == fast and native[0] == [0, 0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=32, max_size=32), min_size=1, max_size=9))
def test_majority_of_bits(rows):
    bits = np.array(rows)
    from peakgrid.functions.registry import hv_bundle

    import pandas as pd

    got = hv_bundle.func(pd.Series(encoding.pack(bits).tolist()))
    assert (encoding.unpack(np.array([got]))[0] == (bits.sum(0) > len(bits) // 2)).all()


def vectors(spark, n=60, seed=3, keys=2):
    r = random.Random(seed)
    base = [[r.getrandbits(32), r.getrandbits(32)] for _ in range(6)]
    rows = []
    for i in range(n):
        hv = [w ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) for w in base[i % 6]]
        rows.append((i, 400 + (i % 3) * 0.004 + r.random() * 0.01, 1, i % keys, hv, float(i)))
    return spark.createDataFrame(rows, "spectrum_id long, precursor_mz double, precursor_charge int, bucket int, hv array<long>, retention_time double"), rows


def dist(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) / 64


def test_masked_pairs_against_brute_force(spark):
    df, rows = vectors(spark)
    want = sorted((a[0], b[0], dist(a[4], b[4])) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and abs(a[1] - b[1]) / b[1] < 10e-6)
    assert sorted((r.id_a, r.id_b, r.dist) for r in distances.masked_pairs(df, 10, 64).collect()) == want and want
    da = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 0.003)
    assert sorted((r.id_a, r.id_b) for r in distances.masked_pairs(df, 0.003, 64, "Da").collect()) == da


def test_distance_laws(spark):
    df, rows = vectors(spark, 12)
    m = {(a[0], b[0]): dist(a[4], b[4]) for a in rows for b in rows}
    got = {(r.a, r.b): r.d for r in df.select(F.col("spectrum_id").alias("a"), F.col("hv").alias("x")).crossJoin(df.select(F.col("spectrum_id").alias("b"), F.col("hv").alias("y"))).select("a", "b", distances.hamming("x", "y", 64).alias("d")).collect()}
    assert got == m
    assert all(m[a, a] == 0 for a in range(12)) and all(m[a, b] == m[b, a] for a in range(12) for b in range(12))
    assert all(m[a, c] <= m[a, b] + m[b, c] + 1e-12 for a in range(12) for b in range(12) for c in range(12))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    r = random.Random(1)
    r.shuffle(chain)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_eps_only_merges(spark):
    df, _ = vectors(spark)
    edges = scratch.table(distances.masked_pairs(df, 30, 64))
    sizes = []
    for eps in (0.0, 0.1, 0.3, 0.9):
        got = {r.spectrum_id: r.cluster for r in clustering.dbscan(df, edges, eps, 1).collect()}
        sizes.append(len(set(got.values())))
    assert sizes == sorted(sizes, reverse=True)
    with pytest.raises(ValueError):
        clustering.dbscan(df, edges, 0.5, 3)


def brute_linkage(d, eps, how):
    groups = [[i] for i in range(len(d))]
    f = {"single": np.min, "complete": np.max, "average": np.mean}[how]
    while len(groups) > 1:
        best = min((f(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] > eps:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


@pytest.mark.parametrize("how", ["single", "complete", "average"])
def test_linkage_against_brute_force(how):
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 17, 30):
        d = r.random((n, n))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        for eps in (0.2, 0.5, 0.8):
            labels = clustering.linkage_labels(d, eps, how)
            got = sorted(sorted(np.flatnonzero(labels == k)) for k in set(labels.tolist()))
            assert [[int(x) for x in g] for g in got] == brute_linkage(d, eps, how)


@pytest.mark.parametrize("how", ["complete", "average"])
def test_linkage_by_component_is_linkage_by_bucket(spark, how):
    df, rows = vectors(spark)
    r = random.Random(6)  # no two distances are equal, so that the order of merges is given
    made = [(a[0], b[0], r.random() ** 2) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and r.random() < 0.4]
    edges = spark.createDataFrame(made, "id_a long, id_b long, dist double")
    near = {(a, b): d for a, b, d in made}
    got = {}
    for x in clustering.hierarchical(df, edges, 0.3, how).collect():
        got.setdefault(x.cluster, set()).add(x.spectrum_id)
    want = []
    for k in (0, 1):
        ids = [r[0] for r in rows if r[3] == k]
        d = np.array([[0 if a == b else near.get((min(a, b), max(a, b)), 1.0) for b in ids] for a in ids])
        want += [{ids[i] for i in g} for g in brute_linkage(d, 0.3, how)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    with pytest.raises(ValueError):
        clustering.hierarchical(df, edges, 1.0, how)


@pytest.mark.parametrize("how", ["complete", "average"])
def test_large_components_are_linked_by_joins(spark, how, monkeypatch):
    monkeypatch.setattr(clustering, "LINKAGE_MAX", 5)
    r = np.random.default_rng(21)
    n, eps = 40, 0.4
    d = r.random((n, n)) ** 1.5
    d[r.random((n, n)) < 0.2] = 1  # masked pairs
    d = np.triu(d, 1) + np.triu(d, 1).T
    df = spark.createDataFrame([(i, 2, 0) for i in range(n)], "spectrum_id long, precursor_charge int, bucket int")
    edges = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n) if d[i, j] < 1], "id_a long, id_b long, dist double")
    got = {}
    for x in clustering.hierarchical(df, edges, eps, how).collect():
        got.setdefault(x.cluster, []).append(x.spectrum_id)
    assert sorted(map(sorted, got.values())) == brute_linkage(d, eps, how) and all(k == min(v) for k, v in got.items())


@pytest.mark.parametrize("most", [2, 2_000])
@pytest.mark.parametrize("how", ["complete", "average"])
def test_copies_are_linked_as_weighted_points(spark, how, most, monkeypatch):
    monkeypatch.setattr(clustering, "LINKAGE_MAX", most)
    r = np.random.default_rng(5)
    kinds = r.integers(0, 2**31, (9, 4)) & ~(r.integers(0, 2**31, (9, 4)) & r.integers(0, 2**31, (9, 4)))
    rows = [(10 * c + k, 2, 0, 500.0, kinds[k].tolist()) for k in range(9) for c in range(1 + 3 * (k % 3))]
    df = spark.createDataFrame(rows, "spectrum_id long, precursor_charge int, bucket int, precursor_mz double, hv array<int>")
    seen = []

    def pairs(points):
        seen.append(points.count())
        noise = F.abs(F.xxhash64("id_a", "id_b") % 1000) / 1e7  # no two distances are equal
        return distances.masked_pairs(points, 20, 128).withColumn("dist", F.col("dist") + noise)

    rows = {x[0]: x[4] for x in rows}
    ids = sorted(rows)
    e = {(x.id_a % 10, x.id_b % 10): x.dist for x in pairs(df.where("spectrum_id < 10")).collect()}
    d = np.array([[0 if a % 10 == b % 10 else e[min(a % 10, b % 10), max(a % 10, b % 10)] for b in ids] for a in ids])
    for eps in (0.42, 0.48):
        got = {}
        for x in clustering.hierarchical_of_copies(df, pairs, eps, how).collect():
            got.setdefault(x.cluster, []).append(x.spectrum_id)
        want = [[ids[i] for i in g] for g in brute_linkage(d, eps, how)]
        assert sorted(map(sorted, got.values())) == sorted(want)
    assert set(seen) == {9}


def test_groups_on_a_line():
    assert clustering.split_1d(np.array([100.0, 100.001, 100.5]), 0.01).tolist() == [0, 0, 1]
    assert clustering.split_1d(np.array([100.5, 100.001, 100.0]), 20, "ppm").tolist() == [1, 0, 0]
    assert clustering.split_1d(np.array([1.0, 2.0, 3.0, 4.0]), 1.5).tolist() == [0, 0, 1, 1]
    assert clustering.split_1d(np.array([5.0]), 1.0).tolist() == [0]


def test_refinement(spark):
    rows = [(1, 100.0, 1.0, 1), (2, 100.001, 1.0, 1), (3, 100.5, 1.0, 1), (4, 200.0, 1.0, 4), (5, 300.0, 1.0, 4), (6, 50.0, 1.0, 6), (7, 50.0, 900.0, 6), (8, 50.0, 901.0, 6), (9, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "spectrum_id long, precursor_mz double, retention_time double, cluster long")
    got = {r.spectrum_id: r.cluster for r in clustering.refine(df, 20).collect()}
    assert got == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: 6, 7: 6, 8: 6, 9: None}
    by_time = {r.spectrum_id: r.cluster for r in clustering.refine(df, 20, rt_tol=10.0).collect()}
    assert by_time == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: 7, 8: 7, 9: None}


def test_medoid_is_the_central_member(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, None)], "spectrum_id long, cluster long")
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (1, 3, 0.4), (4, 5, 0.2)], "id_a long, id_b long, dist double")
    got = {r.spectrum_id: r.is_representative for r in clustering.medoids(df, edges).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_histogram_edges(spark):
    rows = [(k, 0) for k, n in ((0, 1), (1, 3), (2, 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "bucket int, precursor_charge int")
    assert [tuple(r) for r in clustering.size_histogram(df, [0, 3, 5]).orderBy("low").collect()] == [(0, 3, 1), (3, 5, 2)]


def history(spark):
    hv = lambda *ones: [sum(1 << i for i in ones), 0]
    rows = [(1, 100.0, 1, 0, hv(1, 2), 1, True), (2, 100.0, 1, 0, hv(1, 3), 1, False), (3, 100.0, 1, 0, hv(*range(10, 30)), None, True), (4, 900.0, 1, 5, hv(4), 4, False), (5, 900.0, 1, 5, hv(5), 4, False), (6, 50.0, 1, 9, hv(1), 6, True)]
    return spark.createDataFrame(rows, "spectrum_id long, precursor_mz double, precursor_charge int, bucket int, hv array<long>, cluster long, is_representative boolean"), hv


def test_assignment_cases(spark):
    old, hv = history(spark)
    new = [(10, 100.0, 1, 0, hv(1, 2)), (11, 100.0, 1, 0, hv(*range(32))), (12, 500.0, 1, 3, hv(1)), (13, 950.0, 1, 6, hv(1)), (14, 900.0, 1, 5, hv(4)), (15, 900.0, 1, 5, hv(4)), (16, 50.5, 1, 9, hv(1)), (17, 1000.0, 1, 6, hv(2))]
    df = spark.createDataFrame(new, "spectrum_id long, precursor_mz double, precursor_charge int, bucket int, hv array<long>")
    p = Params(hd_dim=64, eps=0.3, anomaly_threshold="fixed", anomaly_eps=0.1)
    got = {r.spectrum_id: r for r in anomaly.assign(df, old, p, 64).collect()}
    assert len(got) == 8
    assert (got[10].cluster, got[10].anomaly, got[10].best_rep) == (1, False, 1)
    assert (got[11].cluster, got[11].anomaly, got[11].is_representative) == (11, True, True)
    assert (got[12].cluster, got[12].anomaly, got[12].is_representative) == (None, False, True)
    assert got[13].anomaly and got[17].anomaly
    assert (got[14].cluster, got[15].cluster, got[14].anomaly, got[14].is_representative, got[15].is_representative) == (14, 14, False, True, False)
    assert got[16].anomaly and got[16].best_dist == 1.0


def test_thresholds(spark):
    old, _ = history(spark)
    reps = anomaly.representatives(old)
    for how in ("percentile", "weighted", "mean", "median", "mad"):
        got = {(r.precursor_charge, r.bucket): r.anomaly_eps for r in anomaly.thresholds(reps, Params(hd_dim=64, anomaly_threshold=how), 64).collect()}
        assert got[1, 5] == 0.9 and got[1, 9] == 0.9 and 0 < got[1, 0] <= 0.9
    with pytest.raises(ValueError):
        anomaly.thresholds(reps, Params(anomaly_threshold="x"), 64)


def test_weighted_percentile(spark):
    df = spark.createDataFrame([(1, v, w) for v, w in ((0.1, 1), (0.2, 5), (0.3, 1), (0.9, 3))], "k int, v double, w int")
    at = lambda q: anomaly.weighted_percentile(df, ["k"], "v", "w", q).first()["at"]
    assert [at(q) for q in (5, 50, 70, 71, 100)] == [0.1, 0.2, 0.3, 0.9, 0.9]


def test_fold_of_one_batch_is_a_step_and_look_alikes_join(spark):
    old, hv = history(spark)
    new = spark.createDataFrame([(20, 100.0, 1, 0, hv(*range(32))), (21, 100.0, 1, 0, hv(*range(31)))], "spectrum_id long, precursor_mz double, precursor_charge int, bucket int, hv array<long>")
    p = Params(hd_dim=64, anomaly_threshold="fixed", anomaly_eps=0.1)
    step = sorted((r.spectrum_id, r.cluster, r.anomaly) for r in anomaly.assign(new, old, p, 64).collect())
    assert sorted((r.spectrum_id, r.cluster, r.anomaly) for r in anomaly.fold([new], old, p, 64).collect()) == step == [(20, 20, True), (21, 21, True)]
    two = anomaly.fold([new.where("spectrum_id = 20"), new.where("spectrum_id = 21")], old, p, 64)
    assert sorted((r.spectrum_id, r.cluster, r.anomaly) for r in two.collect()) == [(20, 20, True), (21, 20, False)]


def test_separation_by_hand(spark):
    hv = lambda n: [(1 << n) - 1, 0]
    rows = [(1, 0, 100.0, hv(0), 1, True), (2, 0, 100.0, hv(16), 1, False), (3, 0, 100.0, hv(32), 3, True), (4, 7, 100.0, hv(1), 4, True)]
    df = spark.createDataFrame(rows, "spectrum_id long, bucket int, precursor_mz double, hv array<long>, cluster long, is_representative boolean")
    got = {r.cluster: r for r in separation.separation(df, 20, 64).collect()}
    one = got[1]
    assert (one.avg_intra, one.max_intra, one.nearest_cluster, one.cluster_min_sep, one.cluster_avg_sep, one.nearest_inter) == (0.125, 0.25, 3, 0.25, 0.375, 0.375)
    assert one.separation_margin == 0.125 and one.separation_score == 3.0
    assert got[3].separation_score == math.inf and got[3].nearest_cluster == 1
    assert got[4].nearest_cluster is None and got[4].separation_score is None


def test_running_totals(spark):
    r = random.Random(1)
    values = [(r.random(), r.randint(0, 9)) for _ in range(300)]
    got = scratch.running(spark.createDataFrame(values, "k double, v int"), ["k"], {"upto": "v"}).orderBy("k").collect()
    assert [x.upto for x in got] == np.cumsum([v for _, v in sorted(values)]).tolist()


def test_areas_against_definition(spark):
    r = random.Random(2)
    rows = [(float(r.randint(0, 15)), r.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame(rows, "s double, t boolean")
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auroc(df, "s", "t").first().auroc == pytest.approx(want)
    ap, before = 0.0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(p >= s for p in pos), sum(x >= s for x, _ in rows)
        ap += (tp - before) / len(pos) * tp / n
        before = tp
    assert metrics.auprc(df, "s", "t").first().auprc == pytest.approx(ap)
    assert metrics.auroc(df.where("t"), "s", "t").first().auroc is None


def test_splits(spark):
    rows = [(i, i // 5, 0, f"s{i}" if i != 7 else "s_anomalies") for i in range(50)] + [(60, 20, 0, "x"), (61, 20, 1, "x"), (62, 21, 0, "y")]
    df = spark.createDataFrame(rows, "spectrum_id long, cluster long, bucket int, identifier string")
    got = {r.spectrum_id: r.part for r in splits.train_test(df).collect()}
    assert got[7] == "test" and not set(range(5, 10)) - {7} & set(got)
    for k in range(10):
        if k != 1:
            assert sum(got[i] == "test" for i in range(5 * k, 5 * k + 5)) == 2
    assert {got[i] for i in (60, 61, 62)} == {"train"}
    assert splits.sample_percent(df, 10).count() == 5 and splits.sample_percent(df, 0.001).count() == 1
    assert splits.ratio_split(df, 0.7).groupBy("part").count().orderBy("part").collect()[0]["count"] == int(0.7 * len(rows))
    many = spark.range(23).select((F.col("id") * 2.0 + 1).alias("mz"))
    sizes = [r["count"] for r in splits.balanced_split(many, 3, 1000).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [8, 8, 7]


def planted(spark, n=400):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(6) * [1, 1, 0.2, 0.2, 0.1, 0.1] + 5).tolist()) for i in range(n)]
    rows += [(1000 + i, (r.standard_normal(6) + 5 + 8 * r.choice([-1, 1], 6)).tolist()) for i in range(20)]
    return spark.createDataFrame(rows, "spectrum_id long, x array<double>")


@pytest.mark.parametrize("detect", [lambda d: baselines.isolation_forest(d, 0.02), lambda d: baselines.local_outlier_factor(d, 0.02, 20), lambda d: baselines.one_class_svm(d, 0.05, 400), lambda d: baselines.one_class_pca(d, 0.02, 2), lambda d: baselines.subspace_pair(d, 2)], ids=["iforest", "lof", "ocsvm", "ocpca", "gods"])
def test_detectors_rank_planted_outliers_low(spark, detect, request):
    got = detect(planted(spark)).withColumn("t", F.col("spectrum_id") >= 1000).withColumn("s", -F.col("score"))
    assert got.count() == 420
    assert metrics.auroc(got, "s", "t").first().auroc > (0.6 if "gods" in request.node.name else 0.8)  # frames see directions alone


def test_svm_outlier_share_is_about_nu(spark):
    got = baselines.one_class_svm(planted(spark, 500), 0.1, 1000)
    share = got.where("outlier").count() / got.count()
    assert 0.03 < share < 0.2


def test_svm_settles_on_more_rows(spark):
    df = planted(spark, 3000)
    got = baselines.one_class_svm(df, 0.1)
    x = baselines.sample(df)
    assert len(x) == 3020  # no row is left out
    share = got.where("outlier").count() / got.count()
    assert abs(share - 0.1) < 0.01  # on the fitted rows themselves


def test_subspaces_see_the_length_of_rows(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, (30 * x[i]).tolist()) for i in range(5)], "spectrum_id long, x array<double>")
    got = {r.spectrum_id: r.score for r in baselines.subspace_pair(df).collect()}
    assert all(abs(got[1000 + i] - got[i]) > 1e-3 for i in range(5))


def test_linkage_both_ways_on_many_tied_matrices(spark, monkeypatch):
    """500 components with few different distances, some of weighted points: by matrices, by joins and by a loop over the least pair."""
    r = np.random.default_rng(7)
    pairs, nodes, want = [], [], {"complete": {}, "average": {}}
    for t in range(500):
        n = 9
        bits = r.integers(0, 2, (n, 32))
        dist = (bits[:, None] != bits[None]).mean(2)
        copies = r.integers(1, 4, n) if t % 3 == 0 else np.ones(n, int)
        base = 100 * t
        nodes += [(base + i, int(copies[i])) for i in range(n)]
        pairs += [(base + i, base + j, float(dist[i, j])) for i in range(n) for j in range(i + 1, n)]
        for how, found in want.items():
            held = {i: [i] for i in range(n)}
            weight = np.rint((1 - dist) * clustering.STEPS).astype(int) * copies[:, None] * copies[None]

            def far(a, b, held=held, weight=weight, how=how, dist=dist, copies=copies):
                at = np.ix_(held[a], held[b])
                return dist[at].max() if how == "complete" else 1.0 - weight[at].sum() / (copies[held[a]].sum() * copies[held[b]].sum() * clustering.STEPS)

            while len(held) > 1:
                d, a, b = min((far(a, b), a, b) for a in held for b in held if a < b)
                if d > 0.4 + 1e-12:
                    break
                held[a] += held.pop(b)
            found.update({base + i: base + k for k, v in held.items() for i in v})
    df = spark.createDataFrame(nodes, "spectrum_id long, copies long").cache()
    edges = spark.createDataFrame(pairs, "id_a long, id_b long, dist double").cache()
    for how in want:
        for most in (2_000, 2):
            monkeypatch.setattr(clustering, "LINKAGE_MAX", most)
            got = {x.spectrum_id: x.cluster for x in clustering.hierarchical(df, edges, 0.4, how).collect()}
            assert got == want[how], (how, most)


def test_small_groups_share_batches(spark):
    df = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    import pandas as pd

    got = clustering.by_group(df, "k", lambda p: pd.DataFrame({"k": p.k.iloc[:1], "n": [len(p)], "kinds": [p.k.nunique()]}), "k long, n long, kinds long").collect()
    assert sorted(r.k for r in got) == list(range(300)) and sum(r.n for r in got) == 2000 and {r.kinds for r in got} == {1}
