import os

import numpy as np
import pytest
from peakgrid import functions
from peakgrid.operators import anomaly
from peakgrid.params import Params
from peakgrid.plans import testdata
from peakgrid.sources import files, mgf
from peakgrid.streaming import incremental
from pyspark.sql import functions as F

ONE = """# a comment
BEGIN IONS
TITLE=first=one
SCANS=338
RTINSECONDS=165.133194
PEPMASS=300.148804 1234.5
CHARGE=2+
101.07 523.4
# in between
bad line
200.5\t1e3
END IONS

BEGIN IONS
PEPMASS=100
CHARGE=1-
END IONS
BEGIN IONS
99.5 1.0
PEPMASS=200.25
SCANS=7
CHARGE=3+
150.25 2.5
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.mgf").write_text(ONE)
    (tmp_path / "B.MGF").write_text(ONE.replace("338", "339"))
    (tmp_path / "other.txt").write_text("no")
    os.makedirs(tmp_path / "sub")
    (tmp_path / "sub" / "c.mgf").write_text(ONE)
    return str(tmp_path)


def by_scan(df):
    return {(r.identifier, r.scan): r for r in df.collect()}


def test_reading(spark, folder):
    got = by_scan(mgf.read(spark, f"{folder}/a.mgf"))
    first = got["a", 338]
    assert (first.title, first.retention_time, first.precursor_mz, first.precursor_charge) == ("first=one", 165.133194, 300.148804, 2)
    assert [tuple(p) for p in first.peaks] == [(101.07, 523.4), (200.5, 1000.0)]
    bare = got["a", -1]
    assert (bare.retention_time, bare.precursor_charge, bare.peaks, bare.title) == (-1.0, 1, [], None)
    assert [tuple(p) for p in got["a", 7].peaks] == [(99.5, 1.0), (150.25, 2.5)]


def test_strict_reading_takes_peaks_after_the_charge(spark, folder):
    got = by_scan(mgf.read(spark, f"{folder}/a.mgf", mode="strict"))
    assert [tuple(p) for p in got["a", 7].peaks] == [(150.25, 2.5)] and got["a", 338].title is None


def test_paths(spark, folder):
    assert mgf.read(spark, [folder, f"{folder}/a.mgf"]).count() == 6
    assert mgf.read(spark, folder, recursive=True).count() == 9
    assert sorted(r.n_spectra for r in mgf.count_spectra(spark, folder).collect()) == [3, 3]
    with pytest.raises(FileNotFoundError):
        mgf.read(spark, f"{folder}/none.mgf")
    labels = mgf.read(spark, folder, anomaly_paths=[f"{folder}/a.mgf"]).groupBy("identifier").agg(F.max("label").alias("l")).collect()
    assert {r.identifier: r.l for r in labels} == {"a": 1, "B": 0}


def test_data_source(spark, folder):
    mgf.register(spark)
    got = by_scan(spark.read.format("mgf").load(f"{folder}/a.mgf"))
    assert {k: [tuple(p) for p in r.peaks] for k, r in got.items()} == {k: [tuple(p) for p in r.peaks] for k, r in by_scan(mgf.read(spark, f"{folder}/a.mgf")).items()}
    assert spark.read.format("mgf").load(folder).count() == 6


def test_writing_in_capped_parts(spark, data, tmp_path):
    df = testdata.spectra(spark, data).limit(200).cache()
    mgf.write(df, str(tmp_path / "one"))
    back = mgf.read(spark, str(tmp_path / "one"), raw=True)
    want = {r.scan: r.peaks for r in df.collect()}
    got = {r.scan: r.peaks for r in back.collect()}
    assert got.keys() == want.keys()
    for scan, peaks in want.items():
        assert [p.mz for p in got[scan]] == pytest.approx([p.mz for p in peaks], abs=1e-5)
        assert [p.intensity for p in got[scan]] == pytest.approx([p.intensity for p in peaks], abs=0.051)
    mgf.write(df, str(tmp_path / "parts"), cap_bytes=5000)
    sizes = [sum(os.path.getsize(os.path.join(d, f)) for f in names if f.startswith("part-")) for d, _, names in os.walk(tmp_path / "parts") if "part=" in d]
    assert len(sizes) > 3 and max(sizes) < 5000 + 2000


def test_representatives_are_written(spark, data, tmp_path):
    df = testdata.spectra(spark, data).limit(50).cache()
    marks = df.select("identifier", "scan").withColumn("is_representative", F.col("scan") % 2 == 0).withColumn("cluster", F.col("scan").cast("long"))
    mgf.write_representatives(df, marks, str(tmp_path / "r"), ["identifier", "scan"])
    text = "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "r")).collect())
    assert text.count("BEGIN IONS") == marks.where("is_representative").count() == text.count("CLUSTER=")


def test_text_spectra(spark, tmp_path):
    (tmp_path / "s.asc").write_text("# comment\nchannel mz intensity\n1 100.5 3\n2\t101.5\tx\n\n# more\n3 102.5 9e1\n")
    got = [tuple(r)[1:] for r in files.read_text_spectrum(spark, str(tmp_path / "s.asc")).orderBy("channel").collect()]
    assert got == [(1, 100.5, 3.0), (2, 101.5, None), (3, 102.5, 90.0)]
    assert files.read_text_spectrum(spark, str(tmp_path / "s.asc"), least=5).count() == 1


def test_checkpoints_and_results(spark, data, tmp_path):
    df = testdata.meta(spark, data).withColumn("bucket", F.lit(1)).withColumn("hv", F.array(F.lit(1), F.lit(2)))
    assert files.load_checkpoint(spark, str(tmp_path / "c")) is None
    files.save_checkpoint(df, str(tmp_path / "c"))
    assert files.load_checkpoint(spark, str(tmp_path / "c")).count() == df.count()
    files.save_results(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r/csv"), header=True).count() == df.count() == spark.read.parquet(str(tmp_path / "r/parquet")).count()
    for _ in range(2):
        files.append_csv(df.select("scan").limit(3), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 6
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "spectrum_id long, outlier boolean")
    files.write_outliers(flags, str(tmp_path / "o"))
    assert sorted(r.verdict for r in spark.read.csv(str(tmp_path / "o"), header=True).collect()) == ["normal", "outlier", "skipped"]


def test_logs(spark):
    lines = spark.createDataFrame([(0, "contamination=0.1"), (1, "Isolation Forest | 100.0% | 90.0 | 94.7"), (2, "LOF 46.09 39.07 42.3"), (3, "noise"), (4, "contamination: 1.0"), (5, "GODS  0.7 95.5 1.5")], "line long, value string")
    got = [tuple(r) for r in files.parse_run_log(lines).orderBy("run", "method").collect()]
    assert got == [(0.1, "Isolation Forest", 100.0, 90.0, 94.7), (0.1, "LOF", 46.09, 39.07, 42.3), (1.0, "GODS", 0.7, 95.5, 1.5)]
    acc = spark.createDataFrame([("0.1,0.9,0.1,0.8,5,1,6,90.0,80.0,85.0",), ("tag line",), ("1,0.5,0.5,0.5,1,1,2,50,50,50,0.7,0.6",)], "value string")
    rows = files.parse_accuracy(acc).orderBy("param").collect()
    assert [(r.param, r.precision, r.auroc) for r in rows] == [(0.1, 0.9, None), (1.0, 0.5, 0.7)]
    times = spark.createDataFrame([(0.1, "LOF", 1.0, 2.0, 3.0), (0.1, "GODS", None, 1.0, 1.0)], "run double, method string, preproc_s double, pca_s double, fit_s double")
    row = files.timing_table(times).first()
    assert row["LOF"] == 6.0 and row["GODS"] == 2.0 and row["OC-PCA"] is None


def test_headers_are_carried_over_ranges(spark):
    """Many ranges, some of them without a header of their own; nothing is carried from file to file."""
    from peakgrid.plans.scratch import carried

    rows = [(f, i, float(10 * i) if i in (3, 40) and f == "a" or i == 90 else None) for f in "abc" for i in range(120)]
    df = spark.createDataFrame(rows, "f string, i int, h double").repartition(7)
    want, now = {}, {}
    for f, i, h in rows:
        now[f] = h if h is not None else now.get(f)
        want[f, i] = now[f]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {(r.f, r.i): r.x for r in carried(df, ["i"], "h", "x", "f").collect()} == want
        one = df.where("f = 'a'").drop("f")
        assert {r.i: r.x for r in carried(one, ["i"], "h", "x").collect()} == {i: want["a", i] for i in range(120)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sql_functions(spark):
    functions.register(spark)
    row = spark.sql("SELECT hv_hamming(array(3L, 0L), array(1L, 1L)) AS h, mz_bucket(500.07D, 80D) AS b, round(ppm_gap(100.001D, 100D), 6) AS g").first()
    assert (row.h, row.b, row.g) == (2 / 64, 62, 10.0)
    assert spark.sql("SELECT hv_bundle(v) AS v FROM VALUES (array(3L)), (array(1L)), (array(4L)) AS t(v)").first().v == [1]
    assert [tuple(r) for r in spark.sql("SELECT * FROM mgf_peaks('BEGIN IONS\\nPEPMASS=3\\n1 2\\n# x\\n3.5 4 z\\nEND IONS')").collect()] == [(1.0, 2.0), (3.5, 4.0)]


def test_nearest_of_state_equals_all_pairs(monkeypatch):
    """Distances kept from batch to batch are those of all pairs; of blocks of any size."""
    rng = np.random.default_rng(3)
    ids, mz, hv = rng.permutation(60), 100 + rng.integers(0, 9, 60) * 0.001, rng.integers(0, 1 << 32, (60, 2))
    for block in (1, 100, 1 << 22):
        monkeypatch.setattr(incremental, "BLOCK", block)
        near = np.empty(0)
        for upto in (1, 2, 20, 60):
            near = incremental.nearest(near, ids[:upto], mz[:upto], hv[:upto], 20.0, 64)
            for k in range(upto):
                others = [j for j in range(upto) if j != k]
                wanted = [int(np.bitwise_count(hv[k] ^ hv[j]).sum()) / 64 if abs(mz[k] - mz[j]) / (mz[k] if ids[k] > ids[j] else mz[j]) < 20e-6 else 1.0 for j in others]
                assert near[k] == min(wanted, default=np.inf)
        best, least = incremental.closest(ids[:40], mz[:40], hv[:40], mz[40:], hv[40:], 20.0, 64)
        d = incremental.masked(hv[:40], mz[:40], hv[40:], mz[40:], 20.0, 64)
        assert best.tolist() == [min(range(40), key=lambda j: (row[j], ids[j])) for row in d] and least.tolist() == d.min(1).tolist()
