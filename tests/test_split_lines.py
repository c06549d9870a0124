"""Lines split all at once are those split one by one."""

import time

import numpy as np
import pytest
from peakgrid.operators.clustering import split_1d, split_lines


@pytest.mark.parametrize("mode, tol", [("ppm", 20.0), (None, 0.01)])
@pytest.mark.parametrize("rounds", [100, 2])
def test_lines_at_once(mode, tol, rounds):
    r = np.random.default_rng(3)
    size = r.integers(1, 40, 300)
    group = np.repeat(np.arange(300), size)
    values = np.round(400 + r.random(len(group)) * r.choice([0.005, 0.05, 0.5], 300)[group], r.integers(2, 5))
    got = split_lines(values, group, tol, mode, rounds)
    for g in range(300):
        want, own = split_1d(values[group == g], tol, mode), got[group == g]
        assert len(np.unique(np.stack([want, own], 1), axis=0)) == len(np.unique(want)) == len(np.unique(own))
    assert len(np.unique(np.stack([group, got], 1), axis=0)) == len(np.unique(got))


def test_a_long_chain_and_no_rows():
    gaps = np.arange(1, 3000) * 1e-5
    values = 400 + np.r_[0, gaps.cumsum()]
    assert (split_lines(values, np.zeros(3000, int), 50.0) == split_1d(values, 50.0)).all()
    assert not len(split_lines(np.zeros(0), np.zeros(0, int), 1.0))


def test_many_small_lines_take_no_turn_each():
    began = time.process_time()
    assert len(np.unique(split_lines(np.tile([400.0, 400.001, 400.1], 200_000), np.repeat(np.arange(200_000), 3), 20, "ppm"))) == 400_000
    assert time.process_time() - began < 10
