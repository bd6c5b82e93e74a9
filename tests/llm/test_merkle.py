"""The manifest against a plain tree of hashlib, over ties, nulls, wide ids, other fan-outs and several steps of the trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from shelfwise.llm import merkle

from .helpers import DOCS, corpus, duck, rows_of


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(level: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and each leaf's siblings left and right, level by level."""
    paths, own = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for at, leaves in enumerate(own):
            run, k = runs[at // fanout], at % fanout
            for i in leaves:
                paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        own = [sum(own[i : i + fanout], []) for i in range(0, len(own), fanout)]
        level = [h(*run) for run in runs]
    return level[0], paths


def expected(rows, fanout: int = 2) -> list[tuple]:
    """Rows of the query, in the order of its columns."""
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r[:5])
    names, subs, out = sorted(langs, key=key), [], []
    for lang in names:
        own = sorted(langs[lang], key=lambda r: (key(r[0]), leaf(*r)))
        subs.append((own, *tree([leaf(*r) for r in own], fanout)))
    root, tops = tree([s[1] for s in subs], fanout) if subs else (None, [])
    for (own, sub, paths), top in zip(subs, tops):
        for r, path in zip(own, paths):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            fold = leaf(*r[:4], r[4] + 1) if chosen else leaf(*r)
            for a, b in path + top:
                fold = h(a, fold, b)
            proof = h(*[a + b for a, b in path + top])
            out.append((r[0], leaf(*r), sub, root, proof, fold, fold == root))
    return out


def run(spark, rows, schema=DOCS, fanout=2):
    docs = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    chosen = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    out = merkle.verified(merkle.manifest(docs, {"n_chars": F.when(chosen, docs["n_chars"] + 1).otherwise(docs["n_chars"])}, fanout))
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out.collect()), key=str)


@pytest.fixture
def rows():
    rng = random.Random(3)
    base = corpus(2, 20)
    tied = [(5, f"other text {i}", "fr", None, i, "rk", 1, 2) for i in range(30)] + [(5, "same", "fr", "s", 4, "rk", 1, 2)] * 25
    wide = [(rng.choice([-(2**63), 2**63 - 1, -1, 0, 2**40 + 3, -(2**35)]) if i % 3 else rng.randint(-(2**63), 2**63 - 1), f"w{i}", rng.choice(["", "é", "zz", "a"]), "s", None, "rk", 1, 2) for i in range(70)]
    return base + tied + wide


def test_against_a_plain_tree(spark, rows):
    got = run(spark, rows)
    assert got == sorted(expected([r[:5] for r in rows]), key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("fanout", [2, 3])
def test_several_steps_and_other_fanouts(spark, rows, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "BITS", 3)
    assert run(spark, rows, fanout=fanout) == sorted(expected([r[:5] for r in rows], fanout), key=str)


def test_ids_that_are_text(spark):
    rows = [(i, t, lang, "s", 1) for i, t, lang in [("b", "x", "en"), ("a", "y", "en"), (None, "z", "en"), ("", "z", "en"), ("a\x00", "q", "en"), ("abcdefgh", "1", "en"), ("abcdefgi", "1", "en"), ("é", "1", None), ("ÿ", "2", None)]]
    assert run(spark, rows, "doc_id string, text string, lang string, source string, n_chars bigint") == sorted(expected(rows), key=str)


def test_one_row_and_none(spark):
    one = [(1, "t", "en", "s", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert run(spark, one, schema) == expected(one)
    assert run(spark, [], schema) == []


def test_a_changed_row_fails_and_no_other(spark, rows):
    got = run(spark, rows)
    changed = {r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert {r[0] for r in got if not r[-1]} <= changed
    assert all(r[2] != r[3] and len(r[3]) == 64 for r in got)


def test_sql(spark, rows, tmp_path):
    plain = [r[:5] for r in rows]
    spark.createDataFrame(plain, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(merkle.op13_merkle_manifest(spark, str(tmp_path)))
    assert got == duck(merkle.OP13_SQL, documents=("doc_id bigint, text string, lang string, source string, n_chars bigint", plain))
