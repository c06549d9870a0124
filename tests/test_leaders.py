"""Assignment in order against a loop over the rows."""

import numpy as np
import pytest
from peakgrid.operators import leaders

NEW = "spectrum_id long, precursor_charge int, bucket int, precursor_mz double, hv array<long>"
REPS = "rep_id long, precursor_charge int, bucket int, precursor_mz double, hv array<long>, cluster long"


def made(seed, first, n):
    r = np.random.default_rng(seed)
    kinds = np.random.default_rng(5).integers(0, 1 << 32, (6, 2))
    out = []
    for i in range(n):
        hv = kinds[r.integers(0, 6)].copy()
        for b in r.choice(64, r.integers(0, 16), replace=False):
            hv[b // 32] ^= 1 << b % 32
        out.append((first + 2 * i, 1, int(r.integers(0, 2)), 400.0 + int(r.integers(0, 4)) * 0.005, hv.tolist()))
    return out


def loop(new, reps, eps, tol):
    known = [(r[0], r[2], r[3], r[4], r[5]) for r in reps]
    out = {}
    for i, _, bucket, mz, hv in sorted(new):
        near = []
        for rid, b, rmz, rhv, c in known:
            if b == bucket:
                d = sum(bin(x ^ y).count("1") for x, y in zip(hv, rhv, strict=True)) / 64
                near.append((d if abs(rmz - mz) / mz < tol * 1e-6 else 1.0, rid, c))
        if near and min(near)[0] <= eps:
            out[i] = (min(near)[2], False)
        else:
            out[i] = (i, True)
            known.append((i, bucket, mz, hv, i))
    return out


@pytest.mark.parametrize("n_reps", [0, 6])
@pytest.mark.parametrize("eps", [0.05, 0.2, 0.31])
def test_order_is_kept(spark, n_reps, eps):
    reps = [(*r, 900 + r[0] % 3) for r in made(1, 1, n_reps)]
    new = made(2, 1000, 160)
    got = leaders.assign_in_order(spark.createDataFrame(new, NEW), spark.createDataFrame(reps, REPS), eps, 20, 64)
    assert {r.spectrum_id: (r.cluster, r.founded) for r in got.collect()} == loop(new, reps, eps, 20)


def test_nothing_new(spark):
    assert leaders.assign_in_order(spark.createDataFrame([], NEW), spark.createDataFrame([], REPS), 0.3, 20, 64).count() == 0
