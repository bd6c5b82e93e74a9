"""Front labels: brands, products and noise by worked examples."""

from __future__ import annotations

from shelfwise.operators import front_reader as reader
from shelfwise.operators import online


def front(spark, *texts, known=reader.BRANDS, references=()):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "scan_id int, line int, text string")
    return reader.front(lines, known, references).collect()[0]


def test_front(spark):
    r = front(spark, "REXONA", "MEN", "Antitranspirant", "48 horas", "spray 150 ml")
    assert r.brands == ["REXONA"] and r.capacity == "150 ML" and r.forms == ["SPRAY"]
    assert "ANTITRANSPIRANTE" in r.products and "REXONA" in r.products and "MEN" in r.products


def test_brands_go_on_over_lines(spark):
    assert front(spark, "VICTORIA", "SECRET").brands[0] == "VICTORIA SECRET"
    assert front(spark, "TODAY", "BODY", "SHOP", "PARIS").brands[0] == "TODAY BODY SHOP"
    assert front(spark, "ACME", "BODY 50 ml", "SHOP").brands[0] == "ACME"
    assert front(spark, "ACME", "BODY SHOP LAB").brands[0] == "ACME"


def test_what_is_no_brand(spark):
    assert front(spark, "modo de uso: agitar bem", "123", "AB", "novo", "spray men").brands == []
    assert front(spark, *["x" * 60], "linha boa").brands == ["LINHA BOA"]
    assert front(spark, *[f"{i}" for i in range(12)], "TARDE").brands == []
    assert front(spark, "shampoo acme", references=("SHAMPOO",)).brands == []
    assert front(spark, "first", "nivea", known=("NIVEA",)).brands[0] == "NIVEA"


def test_products(spark):
    assert front(spark, "creme de maos E pes", "100g A50", "FPS30 protege", "creme").products == ["CREME", "MAOS", "PES", "CREME DE MAOS E PES", "FPS30", "PROTEGE", "FPS30 PROTEGE"]


def test_labels_of_known_brands(spark):
    r = front(
        spark, "aixa", "F 2a sér", "20 Goog", "Veriu,", "NOVA/NUEVA FORMULA", "drogaraia.com.br/_next/image?url=https%3A%2F%2Fproduct-data.rai", "Rexona", "CONTROLE", "INTELIGENTE", "DE ODORE SUOR", "INVISIBLE",
        "72h", "ANTITRANSPIRANTE AEROSOL MEN", "150 ml",
    )
    assert r.brands[0] == "REXONA" and "AIXA" in r.brands
    dove = front(spark, "DOVE", "GO FRESH", "CREME HIDRATANTE", "AROMA FLOR DE LOTUS", "150 ML")
    assert dove.brands[0] == "DOVE" and "AROMA FLOR DE LOTUS" in dove.products and any("FRESH" in p for p in dove.products)
    rexona = front(spark, "REXONA", "CLINICAL", "CLEAN MEN", "ANTITRANSPIRANTE", "58 G")
    assert rexona.brands[0] == "REXONA" and "CLINICAL" in rexona.products and "CLEAN MEN" in rexona.products
    cerave = front(spark, "CeraVe", "ESPUMA CREMOSA", "LIMPEZA HIDRATANTE", "236 ML")
    assert "CERAVE" in cerave.brands and "LIMPEZA HIDRATANTE" in cerave.products
    clinical = front(
        spark, "MEN", "Rexona", "clinical", "3x", "MÁS PROTECCIÓN* /", "MAIS PROTEÇÃO*", "CLEAN", "96H", "ANTITRANSPIRANTE", "EN CREMA/EM CREME", "CONT. NETO /", "PESO LÍQ. 58 G"
    )
    assert clinical.brands[0] == "REXONA" and {"CLINICAL", "CLEAN", "MEN"} <= set(clinical.products) and clinical.capacity == "58 G"


def test_fixed_tables():
    assert len(reader.BRANDS) == len(set(reader.BRANDS)) == 60 and len(reader.GENERIC) == 24


def test_online(spark):
    names = [(1, 1, " AQUA "), (1, 2, "WATER"), (1, 3, "NONE"), (1, 4, "SAC 12"), (2, 1, "SECRET"), (2, 2, "AQUA"), (3, 1, "OLD")]
    by_name = [("AQUA", 200, 1, "AQUA"), ("SECRET", 401, None, None), ("OLD", 404, None, None)]
    got = online.online(
        spark.createDataFrame(names, "scan_id int, position int, raw string"), spark.createDataFrame(by_name, "name string, code int, id int, inci string"),
        spark.createDataFrame([("WATER", 200, 1), ("OLD", 503, None)], "name string, code int, id int"), spark.createDataFrame([(1, 200, "AQUA")], "id int, code int, inci string"),
    ).collect()
    out = {(r.scan_id, r.position): (r.status, r.method, r.confidence, r.error, r.inci, r.refused) for r in got}
    assert out[1, 1] == ("KNOWN", "EXACT_INCI", 1.0, None, "AQUA", False) and out[1, 2] == ("ALIAS", "EXACT_ALIAS", 0.99, None, "AQUA", False)
    assert out[1, 3][0] == "NOT_FOUND" and out[1, 4][0] == "ADMINISTRATIVE_NOISE" and out[2, 1][0] == "LOOKUP_ERROR" and out[2, 2][5] and out[3, 1][3] == 503
