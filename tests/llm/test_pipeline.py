import random

import corpus_pipeline
import pytest
from peakgrid.llm import queries
from pyspark.sql import functions as F

from . import helpers as H


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with good, bad, foreign, copied and contaminated documents, nulls and repeated rows."""
    r = random.Random(21)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(i, H.say(r, 25)) for i in range(5)]
    good = [(i, ". ".join(H.say(r, 14) for _ in range(9)), "en", "s", 1) for i in range(200)]
    bad = [(1000 + i, " ".join("junk###$$$" for _ in range(80 + i)), "en", "s", 1) for i in range(40)]
    copies = [(2000 + i, good[i % 4][1], "en", "s", 1) for i in range(30)]
    dirty = [(3000 + i, f"{H.say(r, 60)}. {items[i % 5][1]} {H.say(r, 60)}", "en", "s", 1) for i in range(10)]
    odd = [(4000, None, None, None, None), (4001, "", "en", "s", 0), good[7], good[7]]
    almost = [(2500 + i, good[50 + i][1].replace(good[50 + i][1].split()[40], "changed", 1), "en", "s", 1) for i in range(20)]
    unmarked = [(2700 + i, H.say(r, 120), None, "s", 1) for i in range(5)]
    rows = good + bad + copies + almost + unmarked + dirty + odd
    spark.createDataFrame(rows, H.DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(x[0], 1, 0) for x in good[::2]] + [(x[0], 0, 0) for x in bad[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def test_stages_one_by_one(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, path)
        if k < 4:
            assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append([x.doc_id for x in docs.select("doc_id").collect()])
        if k == 1:
            assert {x.lang for x in docs.select("lang").collect()} == {"en"}
    good, langs, near, clean, packed = kept
    assert not [i for i in good if i is not None and 1000 <= i < 2000] and set(range(200)) <= set(good)
    assert set(langs) == set(good) - {4000, 4001}
    shingles = {x[0]: {tuple(w[i : i + 5]) for w in [x[1].lower().split()] for i in range(len(w) - 4)} for x in rows if x[0] in set(langs)}
    roots = H.components(sorted(shingles), lambda a, b: 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]))
    assert sorted(near) == sorted(set(roots.values())) and len(near) < len(set(langs)) - 30
    text = {x[0]: x[1] for x in rows}
    assert sorted(clean) == sorted(i for i in near if not H.contamination(text[i], items)[-1])
    assert set(packed) == set(clean)


def test_run_is_the_stages(spark, folder):
    path, *_ = folder
    made = corpus_pipeline.run(spark, path)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert made.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_keep_extra_columns_and_take_empty_tables(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").select("*", F.lit(1).alias("score"), F.lit(2).alias("predicted"), F.lit("x").alias("key"), F.lit(3).alias("n"), F.lit(4).alias("Doc_Id"), F.lit(5).alias("_1"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_tables(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    assert got.count() > 0 and not [c for c, t in got.dtypes if t == "void"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    made = con.sql(queries.SQL[name])
    assert sorted(made.columns) == cols
    at = [made.columns.index(c) for c in cols]
    flat = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert flat(got.select(cols).collect()) == flat(tuple(r[i] for i in at) for r in made.fetchall())
