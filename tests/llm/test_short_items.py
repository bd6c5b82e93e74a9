"""Short benchmark items inside long documents."""

from __future__ import annotations

import random

from shelfwise.llm import decontamination

from .helpers import DOCS, prose


def test_short_items_in_long_documents(spark):
    """Items of 5 to 13 words are all met inside documents of some thousand shingles, next to longer items."""
    rng = random.Random(4)
    rows, items = [], []
    for i in range(180):
        t = prose(rng, 5 + i % 9, 13)
        items.append((i, t, 1))
        rows.append((i, f"{prose(rng, 500)} {t} {prose(rng, 515 - i % 9)}", "en", "s", 1, "", 1, 1))
    items.append((999, prose(rng, 40), 1))
    found = decontamination.found(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string, n_item int"))
    assert {r.doc_id for r in found.where("doc_id = item_id").collect()} == set(range(180))
