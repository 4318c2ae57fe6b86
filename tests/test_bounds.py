"""Scores of near duplicates are bounded from above, and few pairs are scored."""

import random

import numpy as np
import pytest

from tessella.operators import contamination as C


def texts(n, length=300):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    weights = [1 / (k + 2) for k in range(len(words))]
    out = [" ".join(r.choices(words, weights, k=r.choice([1, length, length, 2 * length]))) for _ in range(n)]
    for k in range(3, n, 7):  # near copies
        own = out[k - 3].split()
        own[r.randrange(len(own))] = "changed"
        out[k] = " ".join(own)
    return out + [None, "", " ", "ab", "abcd", "abcd" * 9000]


@pytest.mark.parametrize("floor", [0.0, 0.5, 0.8])
def test_bounds_hold_and_few_pairs_are_scored(monkeypatch, floor):
    every = texts(700)
    bench, train, scored = list(enumerate(every[:150] + every[-6:])), every[150:], []

    def rows(least):
        monkeypatch.setattr(C, "_FEWEST", least)
        best = C.Best(C.Index(bench, 4), 5, floor)
        for k in range(0, len(train), 200):
            best.take(train[k : k + 200], list(range(k, min(len(train), k + 200))))
        return best, list(zip(*(x if isinstance(x, list) else x.tolist() for x in best.rows()), strict=True))

    dots = C.Best._dots
    monkeypatch.setattr(C.Best, "_dots", lambda self, begin, place, count, r, b: scored.append(len(r)) or dots(self, begin, place, count, r, b))
    best, got = rows(1 << 8)
    few = sum(scored)
    by_lookups, want = rows(1 << 30)
    assert got == want and best.bounds is not None and by_lookups.bounds is None and sum(scored) == few
    assert 0 < few < 0.25 * len(bench) * len(train)
    # The bound of each score among the block's own texts, with their grams in very few columns too.
    for columns in (1 << 8, C._COLUMNS):
        monkeypatch.setattr(C, "_COLUMNS", columns)
        monkeypatch.setattr(C, "_FEWEST", 1 << 8)
        best = C.Best(C.Index(bench, 4), 5)
        i, own = best.index, best._part(0, len(bench))
        worth = best.bounds @ best.bounds.T
        counts = np.zeros((len(bench), len(i.grams)))
        counts[own[0], own[1]] = own[2] / i.norms[own[0]]
        assert (worth >= (counts @ counts.T) * (1 - C._SLACK)).all()
