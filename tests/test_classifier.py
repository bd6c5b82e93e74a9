"""Cosmetic labels: terms met, near words, screens and other goods, and scores by worked examples."""

from __future__ import annotations

from shelfwise.operators import classifier

LABELS = "scan_id int, text string, has_brand boolean, has_product boolean, has_presentation boolean, has_capacity boolean"


def classes(spark, *labels):
    rows = [(i, t, *(flags + (False,) * (4 - len(flags)))) for i, (t, *flags) in enumerate((x if isinstance(x, tuple) else (x,)) for x in labels) for flags in [tuple(flags)]]
    out = classifier.classified(spark.createDataFrame(rows, LABELS), classifier.known_terms(spark)).orderBy("scan_id").collect()
    return [(r.status, r.score) for r in out]


def test_classes(spark):
    got = classes(
        spark, "", "DESODORANTE", ("Desodorante Nivea 150", True, True), "Desodrante para pele", "Detergente", "Detergente para cabelo", "android logcat desodorante", "SHAMPOO AQUA PARFUM", None, ("cosmético facial", False, True)
    )
    assert got == [
        ("UNCERTAIN", 0.0), ("COSMETIC_CONFIRMED", 0.70), ("COSMETIC_CONFIRMED", 0.83), ("COSMETIC_CONFIRMED", 0.77), ("NON_COSMETIC", 0.98), ("UNCERTAIN", 0.3), ("UNCERTAIN", 0.1), ("COSMETIC_CONFIRMED", 0.74), ("UNCERTAIN", 0.0),
        ("UNCERTAIN", 0.18),
    ]


def test_near_words(spark):
    """One edit for seven letters or more, two beyond twelve, none for short words."""
    rows = [(0, "DESODORANTI", *[False] * 4), (1, "ANTITRANSPRANT", *[False] * 4), (2, "ANTITRNSPRANT", *[False] * 4), (3, "PELI", *[False] * 4), (4, "SHAMPO", *[False] * 4), (5, "XDESODORANTEX", *[False] * 4)]
    got = classifier.met(spark.createDataFrame(rows, LABELS), classifier.known_terms(spark), ("CATEGORY", "CONTEXT")).collect()
    assert {(r.scan_id, r.name) for r in got} == {(0, "DESODORANTE"), (1, "ANTITRANSPIRANTE"), (2, "ANTITRANSPIRANTE"), (4, "SHAMPOO")}


def test_own_terms(spark):
    terms = spark.createDataFrame([("CATEGORY", "WAX", True, "hair wax".upper())], "kind string, name string, precise boolean, alias string")
    rows = [(1, "best hair-wax ever", False, False, False, False)]
    assert classifier.classified(spark.createDataFrame(rows, LABELS), terms).collect()[0].status == "COSMETIC_CONFIRMED"
