"""Buckets that stay large at the last level lose no pair."""

from __future__ import annotations

import numpy as np

from shelfwise.llm import ngram_join as op


def shared_path() -> int:
    """A path that sets go down together if they share the first 32 tokens."""
    sig = np.zeros((2, op.POSITIONS), np.uint16)
    sig[1, 32:] = 1
    for key in range(1, 1000):
        keys, rows = np.array([key, key], np.uint64), np.arange(2)
        for _ in range(op.LEVELS - 2):
            keys, parent = op.descend(keys, sig[rows])
            rows = rows[parent]
        if len(np.intersect1d(keys[rows == 0], keys[rows == 1])):
            return key
    raise AssertionError


def test_pairs_of_a_large_bucket(spark):
    """1200 sets in one bucket, every two of which are near copies, none of which is near others."""
    rng, n, path = np.random.default_rng(7), 1200, shared_path()
    sig = rng.integers(1, 60000, (n, op.POSITIONS)).astype(np.uint16)
    sig[:, :32] = 0
    sig[1::2, 32:48] = sig[::2, 32:48]
    sets = spark.createDataFrame([(k, bytearray(sig[k].tobytes()), [path]) for k in range(n)], "sid bigint, sig binary, paths array<bigint>")
    got = {r.sid: r.cluster for r in op.clusters(sets).collect()}
    assert got == {k: k - k % 2 for k in range(n)}
