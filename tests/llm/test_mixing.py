"""The schedule of a mix against the exact weights."""

import math

import numpy as np
import pytest

from cohortry.llm.mixing import schedule


@pytest.mark.parametrize("weights", [[1.0, math.sqrt(2), math.pi, 0.0002], [math.sqrt(n) for n in (900, 77, 13, 5, 2)], [3.0, 1.0]])
def test_many_periods_stay_within_a_block_of_the_exact_weights(weights):
    slots = 30_000  # 30 of the periods of 1000 slots that weights used to be rounded to
    total = sum(weights)
    found = schedule([math.ceil(2 * slots * w / total) for w in weights], weights)
    after = np.arange(1, slots + 1)
    for rows, w in zip(found, weights, strict=True):
        taken = np.cumsum(np.bincount(rows[rows[:, 0] < slots, 0], minlength=slots))
        assert np.abs(taken - after * w / total).max() < 1 + 1e-9
    assert sorted(np.concatenate([rows[:, 0] for rows in found])) == list(range(sum(map(len, found))))


def test_a_short_table_keeps_to_its_weights_and_the_rest_goes_on():
    blocks, weights = [14, 5, 2, 3], [3.0, 2.0, 1.0, 0.0]
    found = schedule(blocks, weights)
    assert all(((r[:, 1] <= r[:, 0]) & (r[:, 0] < r[:, 2])).all() and (np.diff(r[:, 0]) > 0).all() for r in found)
    assert [sum(r[:, 0] < 6) for r in found] == [3, 2, 1, 0] and [sum(r[:, 0] < 12) for r in found] == [6, 4, 2, 0]
    assert found[3][:, 0].tolist() == [21, 22, 23]
    with pytest.raises(ValueError):
        schedule([1], [-1.0])
