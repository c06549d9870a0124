import os

import pytest
from peakgrid.operators import encoding
from peakgrid.params import Params
from peakgrid.plans import runs, testdata
from peakgrid.sources import mgf
from pyspark.sql import functions as F

P = Params(min_peaks=2, min_mz_range=50, mz_interval=80, hd_dim=256, eps=0.4, cluster_alg="dbscan", batch_size=150)


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mgf"))
    mgf.write(testdata.spectra(spark, data).coalesce(1), f"{path}/text")
    os.rename(next(f"{path}/text/{f}" for f in os.listdir(f"{path}/text") if f.startswith("part-")), f"{path}/a.mgf")
    return path


@pytest.mark.parametrize("alg", ["dbscan", "hc_complete"])
def test_clustering_from_files_to_files(spark, folder, tmp_path, alg):
    p = P.with_(cluster_alg=alg)
    out = str(tmp_path)
    found = runs.cluster_run(spark, f"{folder}/a.mgf", p, f"{out}/o", f"{out}/cp", representatives=True)
    n = found.count()
    assert n > 500 and found.select("label").distinct().count() == found.agg(F.max("label")).first()[0] + 1
    assert spark.read.parquet(f"{out}/o/clusters/parquet").count() == n
    assert found.groupBy("cluster").agg(F.count_if("is_representative").alias("r")).where("cluster is not null and r <> 1").count() == 0
    written = mgf.read(spark, f"{out}/o/representatives", raw=True).count()
    assert written == found.where("is_representative").count()
    again = runs.cluster_run(spark, "/nowhere", p, f"{out}/o2", f"{out}/cp")
    assert sorted(map(tuple, again.select("spectrum_id", "cluster", "label").collect()), key=repr) == sorted(map(tuple, found.select("spectrum_id", "cluster", "label").collect()), key=repr)


def test_detection_from_files_to_files(spark, folder, tmp_path):
    df = runs.load(spark, f"{folder}/a.mgf", P)
    train, test = df.where("scan % 3 <> 0"), df.where("scan % 3 = 0")
    truth = test.where("scan % 7 = 0")
    found = runs.detect_run(train, test, P, str(tmp_path), truth)
    assert found.count() == test.count() and found.select("batch").distinct().count() > 1
    assert spark.read.parquet(f"{tmp_path}/anomalies/parquet").count() == found.where("anomaly").count()
    acc = spark.read.csv(f"{tmp_path}/accuracy", header=True, inferSchema=True).first()
    assert acc.expected_total_anomalies == truth.count() and 0 <= acc.auroc <= 1
    assert spark.read.csv(f"{tmp_path}/timing", header=True).count() == 1


def test_baselines_side_by_side(spark, data):
    spectra = testdata.spectra(spark, data).limit(300).cache()
    rows = runs.baseline_run(spectra, spectra.where("scan % 50 = 0"), 0.05, skip=("GODS",), components=5).collect()
    assert [r.method for r in rows] == ["Isolation Forest", "LOF", "One-Class SVM", "OC-PCA"]
    assert all(r.tp + r.fp + r.tn + r.fn == rows[0].tp + rows[0].fp + rows[0].tn + rows[0].fn and 0 <= r.auroc <= 1 for r in rows)
    with pytest.raises(ValueError):
        runs.baseline_run(spectra, spectra, 0.05, skip=tuple(runs.DETECTORS))


def test_files_are_parsed_once(spark, tmp_path, monkeypatch):
    """What is cleaned reads parsed spectra; filters on peaks aren't pushed into the parsing of text."""
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=x\nSCANS=1\nRTINSECONDS=2\nPEPMASS=500.5\nCHARGE=2+\n200.5 10\n300.5 20\n700.5 30\nEND IONS\n")
    plans, keep = [], encoding.encode
    monkeypatch.setattr(encoding, "encode", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, *a))
    assert runs.load(spark, str(tmp_path), Params(min_peaks=2, hd_dim=64)).count() == 1
    assert len(plans) == 1 and "BEGIN IONS" not in plans[0]
