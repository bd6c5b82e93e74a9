"""Packing and the subsequence kernel against plain versions written from their definitions."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import packing, toxicity


def plain_packing(lengths, permitted):
    """Cost of best fit decreasing for each choice of bin sizes that holds the longest, bins downsized, the cheapest choice."""
    outcomes = []
    for k in range(len(permitted)):
        for less in combinations(sorted(permitted)[:-1], k):
            sizes, bins, rest = sorted((*less, max(permitted))), [], sum(lengths)
            for n in sorted(lengths, reverse=True):
                fits = [x for x in bins if x[0] - sum(x[1]) >= n]
                if fits:
                    min(fits, key=lambda x: x[0] - sum(x[1]))[1].append(n)
                else:
                    bins.append((min((c for c in sizes if c >= n), key=lambda c: (packing.cost(c) / min(c, rest), c)), [n]))
                rest -= n
            outcomes.append(sum(packing.cost(min(c for c in permitted if c >= sum(held))) for _, held in bins))
    return min(outcomes)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40), st.sampled_from([(8, 16, 32, 64), (64,), (20, 64), (16, 48, 64)]))
def test_packing_costs_what_plain_best_fit_costs(lengths, permitted):
    lengths = sorted(lengths, reverse=True)
    put, final = packing.best_pack(lengths, permitted)
    held = defaultdict(int)
    for (b, offset), n in zip(put, lengths):
        assert offset == held[b]
        held[b] += n
    assert sorted(held) == list(range(len(final))) and all(held[b] <= c and c in permitted for b, c in enumerate(final))
    assert sum(map(packing.cost, final)) == pytest.approx(plain_packing(lengths, permitted))


def plain_kernel(x, y):
    """Sum over subsequences of four letters of the products of their weights in x and y, from the definition."""

    def weights(word):
        codes = [int(c) for c in toxicity.encode([word])[0]][: toxicity.WINDOW]
        out = defaultdict(float)
        for at in combinations(range(toxicity.WINDOW), toxicity.LENGTH):
            if at[0] < toxicity.STARTS and at[-1] - at[0] < toxicity.SPAN and all(codes[i] for i in at):
                out[tuple(codes[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.LENGTH)
        return out

    a, b = weights(x), weights(y)
    return sum(v * b[k] for k, v in a.items() if k in b)


@pytest.mark.parametrize("x, y", [("idiot", "idiot"), ("idiot", "id*iot"), ("idiot", "i.d.i.o.t"), ("banana", "bandana"), ("clown", "crown"), ("abcd", "dcba"), ("1diot", "idiot"), ("aaaaaaa", "aaaa")])
def test_features_are_the_subsequence_kernel(x, y):
    m = toxicity.Machine(["idiot", "banana", "clown", "aaaaaaaa", "abcdefgh", x, y])
    dense = m._dense(*toxicity.features(toxicity.word_windows([x, y])))
    assert float(dense[0] @ dense[1]) == pytest.approx(plain_kernel(x, y), rel=1e-4)
    assert plain_kernel(x, x) >= 0 and np.isfinite(dense).all()
