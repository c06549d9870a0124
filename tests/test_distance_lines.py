import os

import pytest
from peakgrid.operators import distances, strips
from peakgrid.sources import files

from tests.test_tiles import SCHEMA, spectra


@pytest.mark.parametrize("line", [7, strips.LINE])
@pytest.mark.parametrize("mode, tol", [("ppm", 20), ("Da", 0.01)])
def test_lines_of_distances_hold_the_pairs(spark, tmp_path, mode, tol, line, monkeypatch):
    df = spark.createDataFrame(spectra(6, 200), SCHEMA).cache()
    monkeypatch.setattr(strips, "LINE", line)
    files.write_distances(distances.masked_pairs(df, tol, 64, mode), f"{tmp_path}/rows")
    files.write_distance_lines(df, f"{tmp_path}/lines", tol, 64, mode)
    want = sorted(map(tuple, files.read_distances(spark, f"{tmp_path}/rows").collect()))
    got = files.read_distance_lines(spark, f"{tmp_path}/lines", 64)
    assert got.columns == ["id_a", "id_b", "dist"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5_000


def test_a_pair_takes_about_a_byte(spark, tmp_path):
    df = spark.createDataFrame([(k, 1, 4, 500.0, [k * 2654435761 % (1 << 32), k * 40503 % 65536]) for k in range(3_000)], SCHEMA)
    files.write_distance_lines(df, f"{tmp_path}/lines", 20, 64)
    size = sum(os.path.getsize(f"{tmp_path}/lines/{f}") for f in os.listdir(f"{tmp_path}/lines"))
    assert files.read_distance_lines(spark, f"{tmp_path}/lines", 64).count() == 3_000 * 2_999 // 2
    assert size < 3_000 * 2_999 // 2


def test_numbers_of_two_digits(spark):
    df = spark.createDataFrame([(k, 1, 4, 500.0, [(1 << k % 32) - 1] * 4) for k in range(33)], SCHEMA)
    got = sorted(map(tuple, strips.pairs_of(strips.lines(df, 20, 128), 128).collect()))
    assert strips.digits(128) == 2
    assert got == sorted(tuple(r)[2:] for r in distances.masked_pairs(df, 20, 128).collect())
