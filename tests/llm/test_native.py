"""Quality rules, decontamination and URL filters against their SQL on small tables with every odd case."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import decontamination, quality_rules, url_filters

from .helpers import DOCS, corpus, duck, edited, prose, rows_of

ITEMS = "item_id bigint, text string, n_item int"
PAGES = "page_id bigint, url string, html string, host string, rule string"
LABELS = "doc_id bigint, quality int, toxic int, host string"


def common_line_corpus():
    rng = random.Random(3)
    menu = "home about contact all rights reserved"
    rows = corpus()
    rows += [(500 + i, f"{menu}\n{prose(rng, 40 if i % 2 else 2)}\n{menu.upper()} ", "en", "hosted", 9, "", 1, 1) for i in range(40)]
    return rows


@pytest.mark.parametrize("rows", [common_line_corpus(), []], ids=["odd", "none"])
def test_quality_rules(spark, rows):
    got = quality_rules.judged(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows_of(got) == duck(quality_rules.OP7_SQL, documents=(DOCS, rows))
    if rows:
        depleted = got.where("not base_failed and not kept").count()
        assert depleted > 0


def test_quality_rules_take_common_lines_out(spark):
    rows = common_line_corpus()
    docs = spark.createDataFrame(rows, DOCS)
    out = quality_rules.filter_documents(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None and r.doc_id >= 500}
    texts = {r[0]: r[1] for r in rows}
    assert set(kept) == {500 + i for i in range(1, 40, 2)}
    assert all(t == "\n".join(x for x in texts[d].split("\n") if not x.strip().lower().startswith("home about")) for d, t in kept.items())


def test_repeat_words(spark):
    w = F.split(F.col("t"), " ")
    df = spark.createDataFrame([("a b c d e a b c d e",), ("a a a a a a a",), ("a b c",), ("a b c d e f a b c d e x",)], "t string")
    assert [r[0] for r in df.select(quality_rules.repeat_words(w)).collect()] == [10, 7, 0, 10]


def leaks():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(1, 50))) for i in range(25)] + [(90, None), (91, ""), (92, " .. ")]
    items += [items[4]]
    rows = corpus()
    for i, (_, t) in enumerate(items[:20]):
        rows.append((700 + i, f"{prose(rng, 400 * (i % 4))} {edited(rng, t, i % 3).upper()} {prose(rng, 30)}", "en", "s", 1, "", 1, 1))
    return rows, [(*x, 1) for x in items]


def test_decontamination(spark):
    rows, items = leaks()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    got = decontamination.found(docs, bench).select("doc_id", "item_id", "n_shared", F.col("n_item").cast("long"))
    want = duck(decontamination.OP8_SQL, documents=(DOCS, rows), benchmark=(ITEMS, items))
    assert rows_of(got) == want and len(want) > 8
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    hit = {r[0] for r in want}
    assert sorted(r.doc_id for r in clean.where("doc_id is not null").collect()) == sorted(r[0] for r in rows if r[0] is not None and r[0] not in hit)


def test_decontamination_of_nothing(spark):
    rows, items = leaks()
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontamination.found(none_d, spark.createDataFrame(items, ITEMS)).count() == 0
    assert decontamination.decontaminate(spark.createDataFrame(rows, DOCS), none_i).count() == len(rows)


def test_sketch_recall(spark):
    """Items of ten shingles, eight of them inside documents of any length, are met by the sketch."""
    rng = random.Random(2)
    rows, items = [], []
    for i in range(150):
        t = prose(rng, 14, 14).split()
        items.append((i, " ".join(t), 1))
        rows.append((i, " ".join([*prose(rng, 10 ** (i % 4)).split(), *t[:-2], *prose(rng, 20).split()]), "en", "s", 1, "", 1, 1))
    found = decontamination.found(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).where("doc_id = item_id").count()
    assert found >= 149


def test_url_filters(spark):
    rng = random.Random(6)
    urls = [None, "", "no-scheme.com/a", "http://", "http://COM/x", "https://WWW.Example.com/en/a?b", "http://a.www.example.com/en/", "http://x.example.com/en", "http://net/es/1#f", "http://a.net/fr/2", "http://a.net?x=/es/", "http://É.com/en/", "//example.com/en/", "ftp://h:80/p"]
    urls += [f"http://h{i % 9}.d{i % 4}.s{i % 3}/p/{i}" for i in range(400)]
    urls += ["http://co.uk/", "http://www.shop.co.uk/", "http://shop.co.uk/", "http://a.shop.com/"]
    pages = [(i, u, "", "clash", "clash") for i, u in enumerate(urls)] + [(3, urls[3], "", "", ""), (None, urls[5], None, None, None)]
    labels = [(i, int(rng.random() > (0.9 if (i - 14) % 9 == 2 else 0.1)), 0, "x") for i in range(414)] + [(4, None, None, None), (8, 0, 1, None), (8, 1, 0, None), (None, 0, 0, None)]
    got = url_filters.judged(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS))
    want = duck(url_filters.OP6_SQL, pages=(PAGES, pages), labels=(LABELS, labels))
    assert rows_of(got) == want
    # columns in order of name: host, page_id, path, rule, verdict
    poor = [r[4] for r in want if r[0].startswith("h2.")]
    assert poor.count("block") > len(poor) / 2 and {r[4] for r in want if r[0].startswith("h5.")} == {"allow"}
    for p, x in (([], labels), (pages, []), ([], [])):
        out = url_filters.judged(spark.createDataFrame(p, PAGES), spark.createDataFrame(x, LABELS))
        assert rows_of(out) == duck(url_filters.OP6_SQL, pages=(PAGES, p), labels=(LABELS, x))
