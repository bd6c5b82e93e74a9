"""Pipeline stages on documents whose extra columns have the names that the operators use inside, and whose ids are texts."""

from __future__ import annotations

import random

import pytest

from shelfwise.llm import decontamination, line_dedup, ngram_join, packing, quality_rules

from .helpers import edited, prose

NAMES = "row rk gone removed first class digest sid nid norm h n lines keep kept a b c key doc_no __rk __gone __removed text.x host document need item_id".split()
SCHEMA = "doc_id {0}, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` int" for n in NAMES)


def rows(kind):
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(8)]
    texts = base + [edited(rng, base[0], 1), base[1], f"{prose(rng, 30)}\n{base[2]}", None, ""]
    name = (lambda i: f"d{i:03}") if kind == "string" else (lambda i: i)
    return [(name(i), t, "en", "s", len(t or ""), *range(len(NAMES))) for i, t in enumerate(texts)] + [(None, base[3], None, None, 1, *range(len(NAMES)))]


STAGES = [
    quality_rules.filter_documents,
    line_dedup.dedup_lines,
    ngram_join.dedup,
    lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "none of these words stands in the texts at all")], "item_id int, text string")),
]


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("stage", STAGES, ids=["quality", "lines", "ngrams", "leaks"])
def test_extra_columns_stay_as_they_are(spark, stage, kind):
    docs = spark.createDataFrame(rows(kind), SCHEMA.format(kind))
    out = stage(docs)
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = out.collect()
    assert got and all(tuple(r[5:]) == tuple(range(len(NAMES))) for r in got)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_packing_of_any_ids(spark, kind):
    docs = spark.createDataFrame(rows(kind), SCHEMA.format(kind))
    assert packing.packed(docs).count() == len(rows(kind))
