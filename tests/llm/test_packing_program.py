from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortflow.llm import packing


def optimum(pieces, capacity):
    """Fewest sequences, by trying every open sequence for every piece."""
    pieces = sorted(pieces, reverse=True)

    @lru_cache(None)
    def fewest(at, rooms):
        if at == len(pieces):
            return len(rooms)
        out = [fewest(at + 1, tuple(sorted([*rooms, capacity - pieces[at]])))]
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[at]}.values():
            out.append(fewest(at + 1, tuple(sorted([*rooms[:k], rooms[k] - pieces[at], *rooms[k + 1 :]]))))
        return min(out)

    return fewest(0, ())


def histogram(sizes):
    return {k: sizes.count(k) for k in set(sizes)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_near_the_optimum_of_small_histograms(sizes):
    groups, bound = packing.plan(histogram(sizes), 20)
    best = optimum(sizes, 20)
    assert bound <= best + 1e-6 and best <= sum(m for _, m in groups) <= best + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), min_size=1, max_size=20))
def test_every_length_is_covered_exactly(hist):
    x, bound = packing.solve(hist, 40)
    covered = dict.fromkeys(hist, 0.0)
    for config, m in x.items():
        assert m > 0 and sum(k * a for k, a in config) <= 40
        for k, a in config:
            covered[k] += m * a
    assert covered == pytest.approx(hist) and len(x) <= len(hist)
    assert bound <= sum(x.values()) + 1e-6


def test_many_lengths_come_from_rounded_configurations(monkeypatch):
    rng = np.random.default_rng(3)
    hist = histogram(np.minimum(2048, rng.lognormal(6, 1, 10000).astype(int) + 1).tolist())
    assert len(hist) > 1000
    filled = []
    plain = packing.best_fit_decreasing
    monkeypatch.setattr(packing, "best_fit_decreasing", lambda h, c, started=(): filled.append((sum(h.values()), len(started))) or plain(h, c, started))
    groups, _ = packing.plan(hist)
    (everything, none), (rest, started) = filled
    assert not none and started and rest * packing.SHARE <= everything
    assert sum(m for _, m in groups) <= sum(m for _, m in plain(hist, 2048))


def test_the_knapsack_table_is_the_best_of_all_multisets():
    value = np.full(13, -np.inf)
    value[[3, 4, 7]] = [2.0, 3.5, 6.1]
    best, last = packing.knapsack(value, 12)
    for c in range(13):
        assert best[c] == max(2.0 * i + 3.5 * j + 6.1 * k for i in range(5) for j in range(4) for k in range(2) if 3 * i + 4 * j + 7 * k <= c)
        config = packing.trace(last, c)
        assert sum(value[k] * a for k, a in config.items()) == pytest.approx(best[c]) and sum(k * a for k, a in config.items()) <= c
