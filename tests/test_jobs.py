"""The jobs: command lines' functions over copies of the tables, run again and over growing input, and against their SQL."""

import logging
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from jobs import queries, spectral_library, text_watch
from pyspark.sql import functions as F

from .test_queries import TABLES, plain


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


def texts(spark, folder, made):
    """Append a file of (doc_id, text, lang, source) to a folder of documents."""
    spark.createDataFrame([(*r, len(r[1] or "")) for r in made], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = con.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(map(repr, rows(got))) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_library_is_made_anew_by_each_run(spark, data, tmp_path, caplog):
    copy, out = str(tmp_path / "data"), str(tmp_path / "library")
    os.mkdir(copy)
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{data}/{t}.parquet").where(f"{t[0]}_orderkey % 4 <> 0").write.parquet(f"{copy}/{t}.parquet")
    with caplog.at_level(logging.INFO, "jobs.spectral_library"):
        told = spectral_library.run(spark, copy, out)
    first = rows(spectral_library.read(spark, out))
    assert f"read {told['read']} spectra" in caplog.text and f"wrote {len(first)} rows" in caplog.text
    assert told["written"] == len(first) and told["clusters"] > 0
    assert {d for d in os.listdir(out) if d.startswith("precursor_charge=")} == {f"precursor_charge={c}" for c in (1, 2, 3)}
    spectral_library.run(spark, copy, out)
    assert rows(spectral_library.read(spark, out)) == first
    # a table that has grown is clustered as a whole again
    spark.read.parquet(f"{data}/orders.parquet").where("o_orderkey % 4 = 0").write.mode("append").parquet(f"{copy}/orders.parquet")
    spark.read.parquet(f"{data}/lineitem.parquet").where("l_orderkey % 4 = 0").write.mode("append").parquet(f"{copy}/lineitem.parquet")
    spectral_library.run(spark, copy, out)
    whole = str(tmp_path / "whole")
    spectral_library.run(spark, data, whole)
    assert rows(spectral_library.read(spark, out)) == rows(spectral_library.read(spark, whole))


def test_library_by_linkage(spark, data, tmp_path):
    config = tmp_path / "settings.ini"
    config.write_text(open(spectral_library.CONFIG).read().replace("cluster_alg = dbscan", "cluster_alg = hc_complete").replace("hd_dim = 2048", "hd_dim = 256"))
    told = spectral_library.run(spark, data, str(tmp_path / "out"), str(config))
    assert told["clusters"] > 0 and told["noise"] == 0
    one = spectral_library.read(spark, str(tmp_path / "out")).groupBy("label").agg(F.count_if("is_representative").alias("r"), F.count("*").alias("n"), F.max("n_spectra").alias("m"))
    assert one.where("r <> 1 or n <> m").count() == 0


EN, DE = "the quick brown fox jumps over the lazy dog and runs home again", "zwölf boxkämpfer jagen viktor quer über den großen sylter deich"


def test_watch_takes_only_what_is_new(spark, tmp_path):
    docs, out, checkpoint = (str(tmp_path / n) for n in ("documents", "out", "checkpoint"))
    texts(spark, docs, [(i, f"{EN} {'abc'[i % 3]}", "en", "s") for i in range(30)] + [(100, "zzzz qqqq zzzz xxxx", "en", "s"), (101, None, "en", "s"), (102, "12 34 !!", None, "s")])
    first = text_watch.run(spark, docs, out, checkpoint)
    assert [(t["read"], t["written"]) for t in first] == [(33, 33)]
    before = rows(text_watch.read(spark, out))
    flagged = {r.doc_id for r in text_watch.read(spark, out).where("anomaly").collect()}
    assert flagged == {100, 101, 102}
    assert text_watch.run(spark, docs, out, checkpoint) == [] and rows(text_watch.read(spark, out)) == before
    texts(spark, docs, [(200 + i, f"{DE} {'abc'[i % 3]}", "de", "s") for i in range(20)] + [(300, f"{EN} b", "en", "s"), (301, "qqq zzz qq", "en", "s"), (300, f"{EN} b", "en", "s")])
    second = text_watch.run(spark, docs, out, checkpoint)
    assert [(t["batch"], t["read"]) for t in second] == [(1, 23)]
    got = text_watch.read(spark, out)
    assert rows(got.where("batch = 0")) == before
    assert {r.doc_id for r in got.where("batch = 1 and anomaly").collect()} == {301}
    assert sorted(r.doc_id for r in got.where("batch = 1 and lang = 'en'").collect()) == [300, 300, 301]
    members = {r.lang: r.members for r in spark.read.parquet(f"{out}/profile/batch=1").collect()}
    assert members == {"en": 34, "de": 20, "und": 0}
    assert sum(r.n for r in spark.read.parquet(f"{out}/distances/batch=1").collect()) == 54


def test_state_of_many_batches_is_that_of_one(spark, data, tmp_path):
    """Counts add up: after four files in four batches the state is as after one batch of all."""
    docs = str(tmp_path / "documents")
    spark.read.parquet(f"{data}/documents.parquet").repartition(4).write.parquet(docs)
    config = tmp_path / "settings.ini"
    config.write_text(open(text_watch.CONFIG, encoding="utf-8").read().replace("max_files = 0", "max_files = 1"), encoding="utf-8")
    many = text_watch.run(spark, docs, str(tmp_path / "many"), str(tmp_path / "c1"), str(config))
    one = text_watch.run(spark, docs, str(tmp_path / "one"), str(tmp_path / "c2"))
    assert len(many) == 4 and len(one) == 1
    assert rows(spark.read.parquet(str(tmp_path / "many/profile/batch=3"))) == rows(spark.read.parquet(str(tmp_path / "one/profile/batch=0")))


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    s, out = text_watch.Settings.read(text_watch.CONFIG), str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"{EN} {'abc'[i % 3]}", "en" if i % 2 else "fr", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    text_watch.judge(df.where("doc_id < 20"), 0, out, s)
    text_watch.judge(df.where("doc_id >= 20"), 1, out, s)
    before = rows(text_watch.read(spark, out)), rows(spark.read.parquet(f"{out}/profile/batch=1"))
    text_watch.judge(df.where("doc_id >= 20"), 1, out, s)
    assert (rows(text_watch.read(spark, out)), rows(spark.read.parquet(f"{out}/profile/batch=1"))) == before


def test_watch_of_no_rows(spark, tmp_path):
    docs = str(tmp_path / "documents")
    texts(spark, docs, [])
    text_watch.run(spark, docs, str(tmp_path / "out"), str(tmp_path / "c"))
    assert text_watch.read(spark, str(tmp_path / "out")).count() == 0


def test_command_lines(data, tmp_path):
    """Each job as its own process, with a session of its own."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "documents.parquet")
    shutil.copy(f"{data}/documents.parquet", copy)
    env = dict(os.environ, PYTHONPATH=here, SPARK_LOCAL_DIRS=str(tmp_path))
    for name, args in (("spectral_library", ["--data", data, "--out", f"{tmp_path}/a"]), ("text_watch", ["--documents", copy, "--out", f"{tmp_path}/b", "--checkpoint", f"{tmp_path}/c"])):
        done = subprocess.run([sys.executable, f"{here}/jobs/{name}.py", *args], env=env, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"jobs.{name}" in done.stderr and "wrote" in done.stderr
    assert os.path.isdir(f"{tmp_path}/a/precursor_charge=1") and os.path.isdir(f"{tmp_path}/b/results/batch=0")


