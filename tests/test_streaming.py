"""Detection in steps: a fold over batches, micro-batches over tables, and keyed state give the same."""

import time
from collections import Counter

import numpy as np
import pytest
from peakgrid.operators import anomaly, clustering, distances
from peakgrid.params import Params
from peakgrid.streaming import incremental
from pyspark.sql import functions as F

VECTORS = "spectrum_id long, precursor_mz double, precursor_charge int, bucket int, hv array<long>"
HISTORY = VECTORS + ", cluster long, is_representative boolean"
DIM = 64


def spectra(seed, first, n, buckets=4, low=100.0):
    """Vectors near one of few kinds, precursors that fall into few bands, some alone."""
    r = np.random.default_rng(seed)
    kinds = np.random.default_rng(99).integers(0, 1 << 32, (6, 2))
    out = []
    for i in range(n):
        hv = kinds[r.integers(0, 6)].copy()
        for b in r.choice(64, r.integers(0, 14), replace=False):
            hv[b // 32] ^= 1 << b % 32
        bucket = int(r.integers(0, buckets))
        mz = low + 8 * bucket + int(r.integers(0, 5)) * 0.0013
        out.append((first + int(i), float(mz), 1 + bucket % 2, bucket, hv.tolist()))
    return out


def rows(df):
    near = lambda x: None if x is None else round(x, 9)
    return sorted((r.spectrum_id, r.best_rep, near(r.best_dist), near(r.anomaly_eps), r.cluster, r.is_representative, r.anomaly) for r in df.collect())


@pytest.fixture(scope="module")
def history(spark):
    old = spark.createDataFrame(spectra(1, 0, 60, buckets=3), VECTORS).cache()
    edges = distances.masked_pairs(old, 20, DIM)
    return clustering.medoids(clustering.dbscan(old, edges, 0.2), edges).cache()


BATCHES = [spectra(2, 1000, 50), spectra(3, 2000, 40), spectra(4, 3000, 45)]


def settings(kind, lost):
    return Params(hd_dim=DIM, eps=0.2, anomaly_threshold=kind, anomaly_percentile=60.0, anomaly_eps=0.1, no_history=lost)


def streamed(spark, folder, batches, begin):
    """Run a stream over a folder to which the batches are added one by one."""
    source = f"{folder}/in"
    spark.createDataFrame([], VECTORS).write.parquet(source)
    query = begin(spark.readStream.schema(VECTORS).parquet(source))
    try:
        for b in batches:
            spark.createDataFrame(b, VECTORS).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()


@pytest.mark.parametrize("kind, lost", [("percentile", "noise"), ("weighted", "cluster"), ("mean", "noise"), ("median", "cluster"), ("mad", "noise"), ("fixed", "cluster")])
def test_state_and_tables_equal_the_fold(spark, history, tmp_path, kind, lost):
    p = settings(kind, lost)
    want = rows(anomaly.fold([spark.createDataFrame(b, VECTORS) for b in BATCHES], history, p, DIM))
    assert len(want) == 135 and len({r[4] for r in want}) > 10 and 0 < sum(r[6] for r in want) < 135
    span = history.agg(F.min("precursor_mz"), F.max("precursor_mz")).first()
    with incremental.keyed_state(spark):
        start = anomaly.start_state(history, p, DIM)
        streamed(spark, tmp_path / "a", BATCHES, lambda s: incremental.stateful(s, start, p, DIM, *span).writeStream.format("memory").queryName(f"found_{kind}").option("checkpointLocation", str(tmp_path / "c1")).start())
    got = rows(spark.table(f"found_{kind}"))
    assert got == want
    if kind in ("percentile", "fixed"):
        out = str(tmp_path / "out")
        streamed(spark, tmp_path / "b", BATCHES, lambda s: incremental.start(s, history, p, DIM, out, str(tmp_path / "c2")))
        held = spark.read.parquet(*[f"{out}/batch={n}" for n in range(len(BATCHES) + 1) if n])
        assert rows(held) == want


def test_without_history(spark, tmp_path):
    p = settings("percentile", "noise")
    with incremental.keyed_state(spark):
        streamed(spark, tmp_path, BATCHES, lambda s: incremental.stateful(s, None, p, DIM, 100.0, 120.0).writeStream.format("memory").queryName("found_alone").option("checkpointLocation", str(tmp_path / "c")).start())
    got = rows(incremental.labelled(spark.table("found_alone")))
    first = [r for r in got if r[0] < 2000]
    assert all(r[4] == r[0] and r[5] for r in first)  # each its own
    assert Counter(r[6] for r in first) == Counter((b[1] > 120) for b in BATCHES[0])
    assert any(not r[5] for r in got if r[0] >= 2000)


def test_state_grows_with_what_is_new(spark, history, tmp_path):
    """A batch of known spectra adds nothing to the vectors; entries split when they are full."""
    p = settings("fixed", "noise").with_(anomaly_eps=0.0)
    many = [(i, 100.0, 1, 0, [i, 7]) for i in range(600)]
    with incremental.keyed_state(spark):
        folder = str(tmp_path / "c")
        streamed(spark, tmp_path, [many, [(10_000 + i, *many[i][1:]) for i in range(600)]], lambda s: incremental.stateful(s, None, p, DIM, 0.0, 1e9).writeStream.format("memory").queryName("found_many").option("checkpointLocation", folder).start())
    got = rows(spark.table("found_many"))
    assert [r[1] for r in got if r[0] >= 10_000] == list(range(600)) and not any(r[5] for r in got if r[0] >= 10_000)
    state = spark.read.format("statestore").option("stateVarName", "vectors").load(folder)
    sizes = [len(r.user_map_value.mz) for r in state.select("user_map_value").collect()]
    assert sorted(sizes) == [600 - 2 * incremental.CHUNK, incremental.CHUNK, incremental.CHUNK]


def test_representatives_are_forgotten(spark, tmp_path):
    """Before the third spectrum the time to live has passed. Such a stream makes empty batches for ever, so that results are awaited."""
    p, source = settings("fixed", "noise"), f"{tmp_path}/in"
    spark.createDataFrame([], VECTORS).write.parquet(source)
    with incremental.keyed_state(spark):
        found = incremental.stateful(spark.readStream.schema(VECTORS).parquet(source), None, p, DIM, 0.0, 1e9, ttl_ms=20_000)
        query = found.writeStream.format("memory").queryName("found_ttl").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for k, wait in ((1, 0), (2, 0), (3, 21)):
            time.sleep(wait)
            spark.createDataFrame([(k, 100.0, 1, 0, [5, 5])], VECTORS).coalesce(1).write.mode("append").parquet(source)
            until = time.time() + 60
            while spark.table("found_ttl").count() < k:
                assert time.time() < until
                time.sleep(0.5)
    finally:
        query.stop()
    assert {r.spectrum_id: r.cluster for r in spark.table("found_ttl").collect()} == {1: None, 2: 1, 3: None}


def test_settings_that_do_not_exist_are_an_error():
    with pytest.raises(ValueError):
        incremental.threshold(np.array([0.1, 0.2]), np.ones(2), settings("other", "noise"))


def test_fold_reads_each_step_alone(spark, history):
    """Results don't depend on how groups' batches are numbered, and groups with fewer batches drop out of the state."""
    p = settings("percentile", "noise")
    every = [b for batch in BATCHES for b in batch if b[0] < 3000 or b[3] == 1]
    df = spark.createDataFrame(every, VECTORS)
    number = F.floor(F.col("spectrum_id") / 1000).cast("int")
    a = rows(anomaly.fold_batches(df.withColumn("batch", number), history, p, DIM))
    b = rows(anomaly.fold_batches(df.withColumn("batch", number * 10 + 3), history, p, DIM))
    assert a == b and len(a) == len(every)


def test_files_to_files_by_streams(spark, data, tmp_path):
    """MGF files come one after the other; a stream cleans and encodes them and keeps state, another writes them as MGF again. A second run takes only the new file."""
    from peakgrid.operators import encoding, peaks
    from peakgrid.plans import testdata
    from peakgrid.sources import mgf

    p = Params(min_peaks=2, min_mz_range=50, mz_interval=80, hd_dim=DIM, anomaly_threshold="fixed", anomaly_eps=0.3)
    source, out = tmp_path / "in", str(tmp_path / "mgf")
    source.mkdir()
    spectra_of = testdata.spectra(spark, data).limit(60).cache()
    parts = [spectra_of.where(f"spectrum_id % 2 = {k}") for k in (0, 1)]
    seen = []
    for k, part in enumerate(parts):
        mgf.write(part.coalesce(1), str(tmp_path / f"text{k}"))
        next((tmp_path / f"text{k}").glob("part-*")).rename(source / f"batch{k}.{'MGF' if k else 'mgf'}")
        (source / f"notes{k}.txt").write_text("BEGIN IONS\nPEPMASS=1\n1 1\nEND IONS\n")
        again = mgf.write_stream(mgf.read_stream(spark, str(source)).withColumn("spectrum_id", F.col("scan").cast("long")), out, str(tmp_path / "c1")).trigger(availableNow=True).start()
        assert again.awaitTermination(90)
        raw = mgf.read_stream(spark, str(source), max_files=1).withColumn("spectrum_id", F.xxhash64("source_file", "scan"))
        clean = encoding.encode(peaks.preprocess(raw, p), p).drop("peaks")
        with incremental.keyed_state(spark):
            query = incremental.stateful(clean, None, p, DIM, 0.0, 1e9).writeStream.format("parquet").option("path", str(tmp_path / "found")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
            assert query.awaitTermination(90)
        seen.append(spark.read.parquet(str(tmp_path / "found")).count())
    want = peaks.preprocess(mgf.read(spark, str(source)).withColumn("spectrum_id", F.xxhash64("source_file", "scan")), p)
    assert seen[0] < seen[1] == want.count()
    key = lambda df: sorted((r.scan, r.precursor_mz, len(r.peaks)) for r in df.collect())
    assert key(mgf.read(spark, out, raw=True)) == key(mgf.read(spark, str(source))) and mgf.read(spark, out, raw=True).count() == 60
