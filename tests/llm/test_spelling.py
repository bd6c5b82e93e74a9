"""Near words, forms and roots against comparing all words with all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from shelfwise.llm import spelling

from .helpers import DOCS, corpus, duck, rows_of


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts: dict[str, int]) -> list[tuple]:
    """(form, form_n, n, n_near, root, word): columns in the order of their names."""
    forms, near = {}, {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((forms[w], counts.get(forms[w]), n, len(near[w]), root, w))
    return sorted(out, key=str)


def counted(rows) -> dict[str, int]:
    n: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


@pytest.fixture
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choices("abé", k=rng.randint(6, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaab", "ÀÉÎÕÜßÿ", "Straßenname", "abcdefgh"]
    texts = [" ".join(rng.choices(base, [1000 // (i + 1) for i in range(len(base))], k=rng.randint(1, 400))) for _ in range(40)]
    texts += ["Abcdefgh,ABCDEFGH;abcdefgX1abcdefgi_abcdefgj-abcdefgjĀabcdefgk̀x", "x" * 50_000, "Abcdefg " * 3000, "abcdefq " * 200 + "abcqefq " * 5, "", None, "short words only"]
    return corpus(3, 20) + [(i * 7, t, None, None, None, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], *[None] * 6)] * 2


def test_against_all_pairs(spark, rows):
    out = rows_of(spelling.variants(spelling.vocabulary(spark.createDataFrame(rows, DOCS))))
    want = expected(counted(rows))
    assert out == want
    assert sum(r[0] is not None for r in want) > 10 and any(r[0] not in (None, r[4]) for r in want)


def test_ties_go_by_code_points_and_chains_are_followed(spark):
    words = {"abcdefg": 1000, "abcdefé": 1000, "abcdefh": 100, "abcdxfh": 10, "bcdxfh": 1, "lonely": 7}
    out = {r["word"]: tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert out["abcdefh"] == ("abcdefh", "abcdefg", "abcdefg", 100, 3, 1000)
    assert out["abcdxfh"][1:3] == ("abcdefh", "abcdefg")
    assert out["bcdxfh"][1:3] == ("abcdxfh", "abcdefg")
    assert out["abcdefg"][1:4] == (None, "abcdefg", 1000) and out["lonely"] == ("lonely", None, "lonely", 7, 0, None)


def test_a_large_group_of_one_wildcard_makes_no_pairs(spark):
    words = [("abcdef" + chr(c), i + 2) for i, c in enumerate(range(0x100, 0x100 + 3000))]
    out = spelling.near(spark.createDataFrame(words, "word string, n bigint")).collect()
    assert len(out) == 3000 and all(r["n_near"] == 2999 for r in out)


def test_sql_and_empty(spark, rows, tmp_path):
    schema = "doc_id bigint, text string"
    for name, some in (("a", [r[:2] for r in rows]), ("b", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert rows_of(spelling.op11_spelling_variants(spark, f"{tmp_path}/{name}")) == duck(spelling.OP11_SQL, documents=(schema, some))
