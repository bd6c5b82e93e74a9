"""Lists of ingredients: worked examples of headings, stops, interruptions, names without commas and columns."""

from __future__ import annotations

import pytest

from shelfwise.operators import ingredient_list as reader


@pytest.fixture(scope="module")
def many(spark):
    """(lists, names) of several labels at once."""

    def of(labels):
        rows = [(k, i, t) for k, lines in enumerate(labels) for i, t in enumerate(lines)]
        found = reader.section(spark.createDataFrame(rows, "scan_id int, line int, text string"))
        lists = {r.scan_id: r for r in found.collect()}
        names: dict = {k: [] for k in range(len(labels))}
        for r in reader.ingredients(found).orderBy("scan_id", "position").collect():
            names[r.scan_id].append((r.name, r.status))
        return lists, {k: [n for n, _ in v] for k, v in names.items()}, names

    return of


TWO = ["AQUA", "PARFUM"]
HEAD = "INGREDIENTES: AQUA, PARFUM"
EXACT = [
    ((["INGREDIENTS: AQUA, PARFUM", "QUESTIONS SUPPORT@MYSPRAYGROUP OR CALL 0800 123 4567"]), TWO, "QUESTIONS"),
    (["INGREDIENTS: AQUA, PARFUM", "LOT: ABC123"], TWO, "LOT"),
    ([HEAD, "PROCURAR ORIENTAÇÃO MEDICA", "OUTRA FRASE"], TWO, "SAFETY_OR_MARKETING"),
    ([HEAD, "SE OCORRER ALERGIA, SUSPENDER", "OUTRA FRASE"], TWO, "SAFETY_OR_MARKETING"),
    ([HEAD, "NÃO CONTÉM CFC", "OUTRA FRASE"], TWO, "SAFETY_OR_MARKETING"),
    ([HEAD, "SSO DE 15OM S WS VENDIDO DO MERCADO DE DESODORANTES NO BRASL", "OUTRA FRASE"], TWO, "SAFETY_OR_MARKETING"),
    ([HEAD + ". PROCURAR ORIENTAÇÃO MEDICA", "OUTRA FRASE"], TWO, "SAFETY_OR_MARKETING"),
    (["PROCURAR ORIENTAÇÃO MEDICA", "KiREDIENTES: BUTANE, ISOBUTANE, PROPANE,", "DIMETHICONOL, LIMONENE.", "80133324 G"], ["BUTANE", "ISOBUTANE", "PROPANE", "DIMETHICONOL", "LIMONENE"], "PACKAGING_TAIL"),
    (["INGREDIENTES", "AQUA PARFUM", "BUTANE PROPANE"], ["AQUA", "PARFUM", "BUTANE", "PROPANE"], "END_OF_TEXT"),
    ([HEAD, "LIMONENE"], ["AQUA", "PARFUM", "LIMONENE"], "END_OF_TEXT"),
    (["INGREDIENTES: AQUA, AUIOATE, 0CTYLDODECAN"], ["AQUA", "AUIOATE", "0CTYLDODECAN"], "END_OF_TEXT"),
    ([HEAD, "CONTEUDO: 150 ML", "TEL: 33334444"], TWO, "CONTEUDO"),
    ([HEAD, "DIMETHICONOL, LIMONENE. SITE: www.example.com.br", "TEXTO ADMINISTRATIVO"], [*TWO, "DIMETHICONOL", "LIMONENE"], "URL"),
    (["INGREDIENTES: AQUA, PARFUM. www.example.com", "TEXTO ADMINISTRATIVO"], TWO, "URL"),
    ([HEAD, "Rua das Flores 12"], TWO, "RUA"),
    ([HEAD, "TALC, ACME COSMETICOS LTDA"], [*TWO, "TALC"], "COMPANY_INLINE"),
    ([HEAD, "MICA SAO PAULO / SP"], TWO, "CITY_STATE"),
    (["INGREDIENTES", "LOTE 12", "AQUA"], [], "LOTE"),
    (["marca", "AQUA, GLYCERIN, PARFUM", "CNPJ 12.345.678/0001-90"], ["AQUA", "GLYCERIN", "PARFUM"], "CNPJ"),
    (["marca", "x AQUA", "GLYCERIN", "mais nada aqui"], ["AQUA", "GLYCERIN MAIS NADA AQUI"], "END_OF_TEXT"),
    (["INGREDIENTES: AQUA; CI, 77891 • Mica | SODIUM", "CHLORIDE"], ["AQUA", "CI 77891", "MICA", "SODIUM CHLORIDE"], "END_OF_TEXT"),
    (["INGREDIENTES: AQUA (AGUA PARFUM) GLYCERIN"], ["AQUA (AGUA PARFUM)", "GLYCERIN"], "END_OF_TEXT"),
    (["INGREDIENTES: SODIUM CHLORIDE SODIUM PCA AQUA"], ["SODIUM CHLORIDE", "SODIUM PCA", "AQUA"], "END_OF_TEXT"),
    (["1NGREDI3NTES AQUA", "GLYCERIN"], ["AQUA", "GLYCERIN"], "END_OF_TEXT"),
    (["Antes", "Composição:", "Aqua, Sodium", "Chloride; CI, 77891 • Mica", "Rua X 12"], ["AQUA", "SODIUM CHLORIDE", "CI 77891", "MICA"], "RUA"),
    (["INGREDIENTES: XANTHAN AQUA PARFUM, TALC"], ["XANTHAN AQUA PARFUM", "TALC"], "END_OF_TEXT"),
] + [([HEAD, site, "TEXTO ADMINISTRATIVO"], TWO, "URL") for site in ("www.example.com.br", "https://example.beauty/info", "http://example.org", "example.com", "example.com.br", "example.net", "www.example.beauty")]


def test_lists_with_known_answers(many):
    lists, names, _ = many([x[0] for x in EXACT])
    for k, (lines, want, stop) in enumerate(EXACT):
        assert (names[k], lists[k].stop) == (want, stop), lines


LONG = [
    [
        "INGREDIENTES: BUTANE, ISOBUTANE, PROPANE, PPG-14 BUTL ETE,", "CYCLOPENTASILOXANE.ALUMINUM SESQUICHLOROHYDRATE, PARFUM,", "GLYCINE, AQUA, CALCIUM CHLORIDE,",
        "DIMETHICONOL, HEXYL CINNAMAL, LIMONENE.", "www.example.com.br", "TEXTO ADMINISTRATIVO",
    ],
    ["INGREDIENTES: AQUA, XANTHAM.GUN, AUIOATE.OCTYLDODECAN,", "PARFUM, LIMONENE"],
    [
        "NGREOIENTES: BUTANE, ISOBUTANE, PROPANE, PPG-14 BUTL ETE", "DO.OPENTASILOXANE, ALUMINUM SESQUICHLOROHYDRATE, PARIN", "EJANTHUS ANNUUS SEED OIL. DISTEARDIMONIUM HECTORITE CI2494",
        "tOATE, GLYCINE, AQUA, CALCIUM CHLORIDE, 0CTYLDODECANO, MI", "ROPYLENE CARBONATE, DIMETHICONOL, ALPHA-ISOMETHYL ONN", "INIO, HEXYL CINNAMAL, LIMONENE.", "Y33824C", "WOFENSNO", "Onilevew", "69657381",
    ],
    [
        "WPLENE DIMETHICONOL, ALPHA-ISOMETNY", "CARBONATE,", "NREDENTES: BUTANE, ISOBUTANE, PROPANE, PPG-14 BUTN E", "DPENTASILOXANE, ALUMINUM SESQUICHLOROHYDRATE,",
        "HELANTHUS ANNUUS SEED OIL, AQUA, CALCIUM CHLORIDE,", "HEXyl CINNAMAL, LIMONENE.", "Unilever",
    ],
    [
        "INGREDIENTES: BUTANE, ISOBUTANE, PROPANE, PPG-14 BUTL ETE", "WAS VENDIDO DO MERCADO DE DESODORANTES NO BRASIL", "DO.OPENTASILOXANE, ALUMINUM SESQUICHLOROHYDRATE, PARIN",
        "EJANTHUS ANNUUS SEED OIL, GLYCINE, AQUA, CALCIUM CHLORIDE", "DIMETHICONOL, ALPHA-ISOMETHYL IONONE, HEXYL CINNAMAL, LIMONENE.", "Y33824C",
    ],
    [
        "NGREDIENTES: BUTANE, ISOBUTANE, PROPANE, PPG-14 BUTM ETR", "troLOPENTASILOXANE, ALUMINUM SESQUICHLOROHYDRATE.", "EJANTHUS ANNUUS SEED OIL, DISTEARDIMONIUM HECTORITE, C84",
        "aOATE, GLYCINE, AQUA, CALCIUM CHLORIDE, 0CTYL DODECUWL,M", "OPYLENE CARBONATE, DIMETHICONOL, ALPHA-ISOMETHY ON", "ANOL HEYXYL CINNAMAL, LIMONENE.", "T3382 4G", "LA CM E M", "Unilever", "6965732",
    ],
]


def test_misread_labels(many):
    lists, names, whole = many(LONG)
    raw = {k: r.raw for k, r in lists.items()}
    assert "CYCLOPENTASILOXANE.ALUMINUM" in raw[0] and "EXAMPLE" not in raw[0] and "ADMINISTRATIVO" not in raw[0]
    assert "XANTHAM.GUN" in raw[1] and "AUIOATE.OCTYLDODECAN" in raw[1] and any("XANTHAM" in n for n in names[1]) and any("AUIOATE" in n for n in names[1])
    assert "DO.OPENTASILOXANE" in raw[2] and "ALPHA-ISOMETHYL ONN" in raw[2] and {s for _, s in whole[2]} == {"UNRESOLVED"}
    assert 0 <= raw[3].index("DIMETHICONOL") < raw[3].index("BUTANE") and "CARBONATE" in raw[3] and "UNILEVER" not in raw[3] and lists[3].start == 0
    assert "DO.OPENTASILOXANE" in raw[4] and "MERCADO DE DESODORANTES" not in raw[4] and lists[4].stop in ("RECOVERED_AFTER_SAFETY_OR_MARKETING", "PACKAGING_TAIL")
    assert not any(x in raw[5] for x in ("T3382", "UNILEVER", "6965732"))
    for k in (0, 2, 4, 5):
        assert {"GLYCINE", "LIMONENE"} <= set(names[k]) and len(names[k]) > 4
    for k in (1, 3):
        assert "LIMONENE" in names[k]


def test_an_interrupted_list_goes_on_twice_at_most(many):
    gap = "EVITE OS OLHOS. ALERGIA"
    lists, names, _ = many([
        ["INGREDIENTES: AQUA,", gap, "nada", "TALC, MICA", gap, "SILICA, KAOLIN", gap, "ALUMINA, LECITHIN"],
        ["INGREDIENTES: AQUA,", gap] + ["nada"] * 30 + ["TALC, MICA"],
        ["INGREDIENTES: AQUA", *["TALC,"] * 70],
    ])
    assert names[0] == ["AQUA", "TALC", "MICA", "SILICA", "KAOLIN"] and lists[0].stop == "SAFETY_OR_MARKETING"
    assert names[1] == ["AQUA"]
    assert lists[2].stop == "MAX_INGREDIENT_SECTION_LINES" and lists[2].end == 64 and len(names[2]) == 65


def test_labels_without_a_list_and_empty_ones(many, spark):
    lists, names, _ = many([["nada", "aqui"], ["", " "], ["AQUA"]])
    assert not lists and not any(names.values())
    assert reader.section(spark.createDataFrame([], "scan_id int, line int, text string")).collect() == []


def test_status_of_names(many):
    _, _, whole = many([["INGREDIENTES: AQUA, 12-3, X, SACO DE AGUA, WWW AQUA"]])
    assert whole[0] == [("AQUA", "UNRESOLVED"), ("12-3", "TRUNCATED_TOKEN"), ("X", "TRUNCATED_TOKEN"), ("SACO DE AGUA", "UNRESOLVED"), ("WWW AQUA", "ADMINISTRATIVE_NOISE")]


def test_terms_of_the_caller(many, spark):
    lines = spark.createDataFrame([(1, 0, "ZUTATEN: WASSER KREIDE"), (1, 1, "Nur fuer aussen")], "scan_id int, line int, text string")
    table = spark.createDataFrame([("head", "ZUTATEN"), ("name", "WASSER"), ("name", "KREIDE"), ("stop", "NUR FUER")], "kind string, term string")
    found = reader.section(lines, table)
    assert [(r.raw, r.stop) for r in found.collect()] == [("WASSER KREIDE", "NUR FUER")]
    assert [r.name for r in reader.ingredients(found, terms=table).orderBy("position").collect()] == ["WASSER", "KREIDE"]


def words(*rows):
    return [(k, row, text, left, top, right, bottom) for k, tokens in enumerate(rows) for text, left, top, right, bottom, row in tokens]


def test_two_columns(spark):
    two = [
        ("INGREDIENTS", 0, 0, 130, 20, 0), ("ALOE", 0, 30, 55, 50, 1), ("EXTRATO", 300, 30, 380, 50, 1), ("BARBADENSIS", 0, 55, 115, 75, 2), ("LEAF", 120, 55, 160, 75, 2), ("EXTRACT", 165, 55, 235, 75, 2),
        ("DA", 300, 55, 325, 75, 2), ("FOLHA", 330, 55, 390, 75, 2), ("AQUA", 0, 80, 55, 100, 3), ("AGUA", 300, 80, 355, 100, 3), ("QUESTIONS SUPPORT@MYSPRAYGROUP", 0, 120, 390, 140, 4),
    ]
    wide = [("INGREDIENTES", 0, 0, 150, 20, 0), ("AQUA", 0, 30, 60, 50, 1), ("PARFUM", 300, 30, 390, 50, 1), ("BUTANE", 0, 60, 80, 80, 2), ("PROPANE", 300, 60, 400, 80, 2)]
    apart = [(t, x, y if r < 2 else y + 100, x2, y2 if r < 2 else y2 + 100, r) for t, x, y, x2, y2, r in two]
    drifting = [(t, x + 200 * (r == 3 and x > 0), y, x2 + 200 * (r == 3 and x > 0), y2, r) for t, x, y, x2, y2, r in two]
    comma = [(t + "," if t == "AGUA" else t, *rest) for t, *rest in two]
    df = spark.createDataFrame(words(two, wide, apart, drifting, comma), "scan_id int, row int, text string, left int, top int, right int, bottom int")
    found = reader.ingredient_columns(df)
    got = {r.scan_id: r for r in found.collect()}
    assert got[0].raw == "ALOE BARBADENSIS LEAF EXTRACT (EXTRATO DA FOLHA), AQUA (AGUA)" and [got[k]["columns"] for k in range(5)] == [True, False, False, False, False]
    names = [(r.name, r.status) for r in reader.ingredients(found.where("scan_id = 0")).orderBy("position").collect()]
    assert names == [("ALOE BARBADENSIS LEAF EXTRACT (EXTRATO DA FOLHA)", "UNRESOLVED"), ("AQUA (AGUA)", "UNRESOLVED")]
    assert [r.name for r in reader.ingredients(found.where("scan_id = 1")).orderBy("position").collect()] == ["AQUA", "PARFUM", "BUTANE", "PROPANE"]


def test_columns_are_not_sent_through_the_driver(spark):
    from shelfwise.plans import library

    plan = library.QUERIES["ext_ingredient_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_columns_are_read_once_and_dealt_twice(spark):
    from shelfwise.plans import library

    df = library.QUERIES["ext_ingredient_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    # the labels are dealt before their words are made and once more behind the term finder; nothing is joined
    assert df.executedPlan().toString().count("Exchange ") == 2 and "Join" not in df.optimizedPlan().toString()


def test_columns_of_labels_with_the_same_texts(spark):
    rows = [("INGREDIENTS", 0, 0, 130, 20, 0), ("AQUA", 0, 30, 55, 50, 1), ("AGUA", 300, 30, 355, 50, 1), ("TALC", 0, 60, 50, 80, 2), ("TALCO", 300, 60, 360, 80, 2)]
    near = [(t, min(x, 60), y, min(x, 60) + 50, y2, r) for t, x, y, x2, y2, r in rows]
    df = spark.createDataFrame(words(rows, near, rows), "scan_id int, row int, text string, left int, top int, right int, bottom int")
    two, one = (True, "AQUA (AGUA), TALC (TALCO)"), (False, "AQUA AGUA TALC TALCO")
    assert {r.scan_id: (r["columns"], r.raw) for r in reader.ingredient_columns(df, parts=3).collect()} == {0: two, 1: one, 2: two}
