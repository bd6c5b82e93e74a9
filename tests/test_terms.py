"""Hits of terms: the automaton and the join against a plain search."""

from __future__ import annotations

import random

import pytest

from shelfwise.functions import terms

TERMS = [("a", "LOT"), ("a", "LOTE"), ("b", "LOTE"), ("a", "MADE IN"), ("b", "MADE IN BRAZIL"), ("a", "AUT. FUNC"), ("a", "S/A"), ("c", "A"), ("c", "A A"), ("a", "WWW.")]


def plain(text: str, table) -> list[tuple]:
    out = []
    for kind, term in set(table):
        at = text.find(term)
        while at >= 0:
            stop = at + len(term)
            if (at == 0 or not text[at - 1].isalnum()) and (stop == len(text) or not text[stop].isalnum()):
                out.append((at, -stop, kind, term))
            at = text.find(term, at + 1)
    return [(k, t, a, -s) for a, s, k, t in sorted(out)]


@pytest.mark.parametrize("most", [1000, 1])
def test_against_a_plain_search(spark, most):
    rng = random.Random(2)
    pieces = ["LOT", "LOTE", "MADE IN", "BRAZIL", " ", " ", "A", "A A A", ".", "/", "S/A", "AUT. FUNC", "É", "WWW.", "WWW.X", "9", "-", "LOT1"]
    texts = ["", "LOTE", "A A A A", "ÉLOTE LOTEÉ É LOTE", "A" * 30_000, "A " * 3000] + ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    table = spark.createDataFrame(TERMS, "kind string, term string")
    got = {r["id"]: [tuple(h) for h in r["hits"]] for r in terms.with_hits(df, table, ["id"], "text", most).collect()}
    assert got.pop(-1) == []
    assert all(got[i] == plain(t, TERMS) for i, t in enumerate(texts))
    assert sum(len(h) for h in got.values()) > 1000


def test_no_terms(spark):
    assert terms.with_hits(spark.createDataFrame([("LOTE",)], "text string"), [], ["text"], "text").first()["hits"] == []
