"""Blocks lose no pair of alike strings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.text import char_similarity
from shelfwise.operators import blocking


def words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ABCDE ", k=rng.randint(1, 14))).strip() or "A" for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w)) if w else 0
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "XB"])
        out.add("".join(w) or "B")
    return sorted(out)


@pytest.mark.parametrize("low", [0.79, 0.87])
def test_alike_strings_meet(spark, low):
    left, right = (spark.createDataFrame([(w,) for w in words(s, 150)], f"{c} string") for s, c in ((1, "s"), (1, "t")))
    got = {(r.s, r.t) for r in blocking.can_be_alike(left, right, low).collect()}
    want = {(r.s, r.t) for r in left.join(right, F.lit(True)).where(char_similarity(F.col("s"), F.col("t")) >= low).collect()}
    assert want <= got and len(want) > 150 and len(got) < 150 * 150 / 3


def test_held_strings_meet(spark):
    a, b = ["ROSE", "ROSES", "TEA", "OILROSE X", "BUTTER"], ["ROSE", "BUTTERROSES", "STEAM", "BUT"]
    left, right = spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "t string")
    got = {(r.s, r.t) for r in blocking.holds(left, right).collect()}
    assert got == {(x, y) for x in a for y in b if (x in y and len(x) >= 4) or (y in x and len(y) >= 4)}
