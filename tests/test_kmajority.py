"""k-majority against numpy."""

import numpy as np
import pytest
from peakgrid.operators import kmajority

SCHEMA = "spectrum_id long, hv array<long>"


def planted(seed, kinds=5, each=30):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 32, (kinds, 4))
    rows = []
    for i in range(kinds * each):
        hv = base[i % kinds].copy()
        for b in r.choice(128, r.integers(0, 20), replace=False):
            hv[b // 32] ^= 1 << b % 32
        rows.append((i, hv.tolist()))
    return base, rows


def plain(x, centres, rounds):
    bits = ((x[:, :, None] >> np.arange(32)) & 1).reshape(len(x), -1)
    costs = []
    while True:
        d = np.array([[sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(v, c, strict=True)) for c in centres] for v in x])
        best = d.argmin(1)
        costs.append(int(d.min(1).sum()))
        if len(costs) > rounds or len(costs) > 1 and costs[-1] >= costs[-2]:
            return best, costs
        centres = centres.copy()
        for c in set(best):
            up = bits[best == c].sum(0) > (best == c).sum() // 2
            centres[c] = (up.reshape(-1, 32) * (1 << np.arange(32))).sum(1)


def test_rounds_are_those_of_numpy(spark):
    _, rows = planted(3)
    x = np.array([r[1] for r in rows], np.int64)
    start = x[[0, 1, 2, 5, 6]]
    got, _, costs = kmajority.cluster(spark.createDataFrame(rows, SCHEMA), 5, 128, start=start)
    best, want = plain(x, start, 20)
    assert costs == want and costs == sorted(costs, reverse=True) and len(costs) > 2
    assert [r.centre for r in got.orderBy("spectrum_id").collect()] == best.tolist()


def test_seeding_finds_planted_kinds(spark):
    base, rows = planted(8)
    got, centres, costs = kmajority.cluster(spark.createDataFrame([*rows, (1000, None)], SCHEMA), 5, 128)
    kinds = {}
    for r in got.collect():
        kinds.setdefault(r.spectrum_id % 5, set()).add(r.centre)
    assert got.count() == 150 and all(len(v) == 1 for v in kinds.values()) and len(set.union(*kinds.values())) == 5
    assert sorted(map(tuple, centres.tolist())) == sorted(map(tuple, base.tolist()))
    assert costs[-1] <= costs[0]


def test_few_rows_and_none(spark):
    same = spark.createDataFrame([(i, [7, 7, 7, 7]) for i in range(4)], SCHEMA)
    got, centres, costs = kmajority.cluster(same, 3, 128)
    assert len(centres) == 1 and costs[-1] == 0 and got.count() == 4
    assert kmajority.cluster(same.limit(0), 3, 128)[0].count() == 0
    with pytest.raises(ValueError):
        kmajority.cluster(same, 0, 128)
