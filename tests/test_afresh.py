import pytest
from peakgrid.operators import anomaly, distances
from peakgrid.params import Params
from pyspark.sql import functions as F

from tests.test_tiles import SCHEMA, rows, spectra


@pytest.mark.parametrize("no_history", ["noise", "cluster"])
def test_groups_that_are_clustered_afresh_are_not_compared_with_history(spark, no_history, monkeypatch):
    p = Params(hd_dim=64, eps=0.2, no_history=no_history)
    one = spark.createDataFrame(spectra(5, 60), SCHEMA)
    new = one.withColumn("bucket", F.lit(1)).unionByName(one.select("spectrum_id", "precursor_charge", F.lit(2).alias("bucket"), "precursor_mz", "hv").withColumn("spectrum_id", F.col("spectrum_id") + 10_000))
    new = new.unionByName(one.withColumn("bucket", F.lit(3)).withColumn("spectrum_id", F.col("spectrum_id") + 20_000)).cache()
    old = new.where("bucket < 3").withColumn("spectrum_id", -F.col("spectrum_id") - 1).withColumn("cluster", F.col("spectrum_id")).withColumn("is_representative", F.col("bucket") == 2).cache()
    span = old.agg(F.min("precursor_mz").alias("_low"), F.max("precursor_mz").alias("_high"))
    cols = ["spectrum_id", "best_rep", "best_dist", "anomaly_eps", "cluster", "is_representative", "anomaly"]
    want = []
    for b in (2, 3):  # each group on its own
        part = new.where(F.col("bucket") == b).crossJoin(span)
        if b == 3 and no_history == "cluster":
            got = anomaly.afresh(part.drop("_low", "_high"), p, 64)
        else:
            got = anomaly.assign_to(part, anomaly.representatives(old.where("bucket = 2")), p, 64)
        want += rows(got, *cols)
    want += rows(anomaly.afresh(new.where("bucket = 1"), p, 64), *cols)
    seen = []
    near, plain = anomaly.tiles.nearest, distances.nearest_rep
    monkeypatch.setattr(anomaly.tiles, "nearest", lambda df, *a: seen.append(df) or near(df, *a))
    monkeypatch.setattr(distances, "nearest_rep", lambda df, reps, *a: seen.extend([df, reps]) or plain(df, reps, *a))
    got = anomaly.assign(new, old, p, 64)
    assert got.columns == [*new.columns, *cols[1:]]
    assert sorted(map(str, rows(got, *cols))) == sorted(map(str, want))
    assert seen and not any(df.where("bucket = 1").count() for df in seen)
    assert new.where("bucket = 1").join(got, "spectrum_id").where("is_representative").count() > 1
