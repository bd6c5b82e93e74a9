"""Base spans against Python's re, terms against the SQL and planted associations, texts after sanitising."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from shelfwise.llm import pii

from .helpers import DOCS, corpus, duck, prose, rows_of

SCHEMA = "doc_id bigint, text string"
ODD = [
    "a@b.c@d.e a@b.c.@d.e .@x.y %@-.- a@b a@b. ü@b.cé ßa@b.c_d+e@f-g.h.i",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0255 01.02.03.04 1.2.3 999999999999.1.1.1 1..2.3.4 x9.9.9.9y é1.1.1.1é 0000.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111 378282246310005 1 4111111111111111 41111111111111110000000 0000000000000000000",
    "4111111111111111, 4111 1111 1111 1111; 4111-1111 1111-1111. 6304000000000000000, 4222222222222, 4111111111111112x5500005555555559",
    "+1 (743) 555-3824 +1234567 +12345678. +1--------2 +49 30 1234567890123456 ++123 456 789 +1 555 555 5555 +1 555",
    "+4111111111111111 4111.1111.1111.1111 x+4111 1111 1111 1111@b.c 1.2.3.4@b.cc",
    "İstanbul İ@b.c Ǆ 𝔘𝔫@x.y áb@c.d\n\ttel:+1 212 555 0100,x@y.zz;10.0.0.1",
    "a" * 40_000 + "@" + "b" * 1000, "9" * 40_000, "1 " * 20_000, "a.b@c" + ".d" * 20_000, "1." * 20_000, "+1" + " " * 20_000,
]


def luhn(d: str) -> bool:
    return sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text: str | None) -> tuple:
    text, out = text or "", []
    for kind, pattern in pii.PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return (*[sum(x.startswith(k + ":") for x in out) for k in pii.BASE], hashlib.sha256(",".join(out).encode()).hexdigest(), out)


def planted() -> list[tuple]:
    """A rare word beside one address in five texts, common words around it, and a second address that no word is bound to."""
    rng = random.Random(9)
    texts = [f"Ask or write mail to the {prose(rng, 40, 40)} and more" for _ in range(400)]
    texts += [f"{prose(rng, 30, 30)} write to Quartzbeam the {i}, mail ann@corp.example and more {prose(rng, 20, 20)} and the quartzbeam" for i in range(5)]
    texts += [f"{prose(rng, 30, 30)} ask bob{i % 2}@corp.example or {prose(rng, 3, 3)}" for i in range(20)]
    texts += ["there is no address beside quartzbeams here"] + ["Written once, written by the one of us, more or less"] * 3
    return list(enumerate(texts + texts[400:402]))


@pytest.fixture(scope="module")
def rows():
    return [r[:2] for r in corpus(6, 20)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, ODD[0]), (None, ODD[1])]


def test_base_spans_are_those_of_re(spark, rows):
    began = time.time()
    got = pii.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert time.time() - began < 120
    assert len(got) == len(rows)
    want = sorted(((r[0], *base(r[1])[:5]) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=str) == want
    held = {r[0]: base(r[1])[5] for r in rows}
    for r in got:
        assert r["doc_id"] is None or [x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE] == held[r["doc_id"]]
    assert all(sum(w[i] for w in want) >= 4 for i in (1, 2, 3, 4))


def test_a_term_bound_to_an_entity_is_found_and_no_common_one(spark):
    rows = planted()
    out = {r["doc_id"]: r for r in pii.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, text in rows:
        terms = [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in out[doc_id]["spans"].split(",") if x) if k not in pii.BASE]
        if "ann@" in text:
            assert terms and {t.lower() for t in terms} == {"quartzbeam"} and len(terms) == 2
        else:
            assert not terms
    assert any("name:" in r["spans"] for r in out.values())


@pytest.mark.parametrize("hidden", [0.1, 0.45])
def test_sql(spark, rows, hidden, monkeypatch, tmp_path):
    # without the very long texts, which the test against re holds
    some = [r for r in rows if len(r[1] or "") < 5000] + planted()
    sql = pii.OP12_SQL.replace(f"{pii.HIDDEN}::DOUBLE", f"{hidden}::DOUBLE")
    got = pii.judged(spark.createDataFrame(some, SCHEMA), hidden=hidden)
    assert rows_of(got) == duck(sql, documents=(SCHEMA, some))


def test_sanitised_texts(spark):
    rows = [(i, t, "en", "s", len(t), "rk", 1, 2) for i, t in planted()] + [(-1, "+4111111111111111 é a@b.cc", "en", "s", 1, "rk", 1, 2), (-2, None, None, None, None, "rk", 1, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {(r["doc_id"]): r for r in pii.sanitised(docs).collect()}
    assert len(out) == len({r[0] for r in rows}) and pii.sanitised(docs).columns == docs.columns
    for doc_id, text, *_ in rows:
        new = out[doc_id]["text"]
        if text and "ann@" in text:
            assert new == re.sub("quartzbeam", "[word]", text.replace("Quartzbeam", "[name]").replace("ann@corp.example", "[email]")) and out[doc_id]["n_chars"] == len(new)
        elif doc_id not in (-1,) and (text is None or "@" not in text):
            assert new == text
    assert out[-1]["text"] == "+[card] é [email]" and out[-2]["text"] is None


def test_empty(spark):
    assert pii.judged(spark.createDataFrame([], DOCS)).collect() == []
    assert pii.sanitised(spark.createDataFrame([], DOCS)).collect() == []
