"""Operators on small inputs with expectations worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalars, text
from shelfwise.operators import catalog, extract, match, products, projections, reconcile, resolve, reviews
from shelfwise.streaming import decisions

ITEMS = "id bigint, name string, brand_name string, score int, category_id bigint, category_name string, brand_id bigint, is_brazilian boolean, ord bigint"


def items(spark, rows):
    return spark.createDataFrame([(i, n, b, s, c, t, bi, z, o) for o, (i, n, b, s, c, t, bi, z) in enumerate(rows)], ITEMS)


STANDARD = [
    (1, "Creme Hidratante Nivea", "Nivea", 85, 1, "Hidratante", 1, False), (2, "Locao Corporal", "Nivea", 45, 1, "Hidratante", 1, False), (3, "Balm Labial", "Nivea", None, 1, "Hidratante", 1, False),
    (4, "Shampoo Anticaspa", "Cliniq", 70, 2, "Shampoo", 2, None), (5, "Condicionador", "Cliniq", 20, 2, "Shampoo", 2, None), (6, "Sabonete Ekos", "Natura", 90, 1, "Hidratante", 3, True),
]


def ids(df):
    return [r.id for r in df.orderBy("ord").collect()]


def test_filters_and_search(spark):
    df = items(spark, STANDARD)
    assert ids(catalog.filtered(df, brands=(2,))) == [4, 5]
    assert ids(catalog.filtered(df, bands=("BOA",))) == [1, 4, 6]
    assert ids(catalog.filtered(df, bands=("RUIM", "MEDIA"), categories=(1,))) == [2]
    assert ids(catalog.filtered(df, brazilian_only=True)) == [6]
    assert ids(catalog.searched(df, " NIVEA ")) == [1, 2, 3]
    assert ids(catalog.searched(df, "%")) == [] and ids(catalog.searched(df, "  ")) == []
    assert [r.id for r in catalog.suggestions(df, 3).orderBy("pos").collect()] == [6, 1, 4]


def test_sections(spark):
    df = items(spark, [(1, "Zeta", "", 90, 1, "Hidratante", 1, None), (2, "Alfa", "", 90, 1, "Hidratante", 1, None), (3, "Beta", "", 20, 1, "Hidratante", 1, None), (4, "Shampoo", "", 80, 2, "Shampoo", 1, None), (5, "Sem", "", 100, None, None, 1, None)])
    got = catalog.sections(df).orderBy("section", "place").collect()
    assert [(r.title, r.id) for r in got] == [("Hidratante", 2), ("Hidratante", 1), ("Hidratante", 3), ("Shampoo", 4), ("", 5)]
    df = items(spark, [(1, "A", "", None, 1, "A", 1, None), (1, "A repetido", "", None, 2, "B", 1, None), (2, "B", "", 80, 2, "B", 1, None), (3, "C", "", 70, 2, "B", 1, None)])
    assert [(r.title, r.id) for r in catalog.sections(df).orderBy("section", "place").collect()] == [("B", 2), ("B", 3), ("A", 1)]


def test_assembly_keeps_last_entries_and_unknowns(spark):
    product = spark.createDataFrame([(1, 7, 1, "x", None, 0), (2, 8, 9, "y", True, 1), (3, 7, 1, "z", False, 2), (None, 7, 1, "n", True, 3)], "id bigint, brand_id bigint, category_id bigint, name string, is_active boolean, ord bigint")
    brand = spark.createDataFrame([(7, "old", True, 0), (7, "new", None, 1)], "id bigint, name string, is_brazilian boolean, ord bigint")
    category = spark.createDataFrame([(1, "c")], "id bigint, name string")
    version = spark.createDataFrame([(10, 1, True, 0), (11, 1, None, 1), (12, 2, True, 2)], "id bigint, product_id bigint, is_current boolean, ord bigint")
    score = spark.createDataFrame([(10, 1, 50, 0), (10, 2, 60, 1), (11, 1, 70, 2)], "version_id bigint, model bigint, overall int, ord bigint")
    model = spark.createDataFrame([(1, True), (2, False)], "id bigint, is_active boolean")
    got = {r.id: r for r in catalog.assemble(product, brand, category, version, score, model).collect()}
    assert set(got) == {1, 2} and got[1].brand_name == "new" and got[1].is_brazilian is None and got[1].score == 50
    assert got[2].brand_name == "" and got[2].category_id is None and got[2].score is None
    none = catalog.assemble(product, brand, category, version, score, model.where("id = 2"))
    assert {r.score for r in none.collect()} == {None}


def test_review_summary(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 4.0), ("a", 4.0), ("a", 1.4), ("b", 4.0), ("b", 8.0), ("c", None), ("c", float("nan"))], "k string, rating double")
    got = {r.k: r for r in reviews.summary(df, "k").collect()}
    assert (got["a"]["mean"], got["a"].total, got["a"].stars_1, got["a"].stars_3, got["a"].stars_4, got["a"].stars_5) == (3.6, 4, 1, 0, 2, 1)
    assert (got["b"].total, got["b"]["mean"]) == (1, 4.0) and (got["c"].total, got["c"]["mean"]) == (0, None)
    assert spark.range(1).select(reviews.stars(F.lit(0.0)), reviews.stars(F.lit(4.5))).first()[:] == (1, 5)


EFFECTS = "person string, ord int, name string, slug string, category string, effect string, tags array<string>"


def matched(spark, rows):
    e = spark.createDataFrame(rows, EFFECTS).withColumn("wanted", F.coalesce(F.array_contains("tags", F.col("slug")), F.lit(False)))
    found = match.points(e)
    return {(r.kind, r.slug): r.names for r in found.collect()}, [r.mark for r in match.highlights(e, found).collect()]


def test_match(spark):
    both = [("p", 1, "SODIUM LAURYL SULFATE", "sem-sulfato", "WARNING", "w", ["sem-sulfato"]), ("p", 2, "AMMONIUM LAURYL SULFATE", "sem-sulfato", "WARNING", "w", ["sem-sulfato"])]
    assert matched(spark, both) == ({("ALERTA", "sem-sulfato"): ["SODIUM LAURYL SULFATE", "AMMONIUM LAURYL SULFATE"]}, [])
    assert matched(spark, [("p", 1, "SODIUM", "sem-sulfato", "WARNING", "w", ["hidratacao"])]) == ({}, ["sem-sulfato"])
    got, _ = matched(spark, [("p", 1, "GLYCERIN", "hidratacao", "BENEFIT", "b", ["hidratacao", "gravidez"]), ("p", 2, "RETINOL", "gravidez", "CONTRAINDICATION", "c", ["hidratacao", "gravidez"])])
    assert set(got) == {("BENEFICIO", "hidratacao"), ("GRAVE", "gravidez")}
    kinds = lambda *k: spark.range(1).select(match.verdict(F.array(*map(F.lit, k)) if k else F.array().cast("array<string>"), F.lit(False))).first()[0]
    assert [kinds("GRAVE", "BENEFICIO"), kinds("ALERTA"), kinds("BENEFICIO"), kinds("AUSENCIA"), kinds()] == ["NAO_RECOMENDADO", "ATENCAO", "COMBINA", "SEM_ALERTAS", "SEM_ALERTAS"]


def test_reason_groups(spark):
    rows = [("muito-seca", 12.0, False), ("caspa", 20.0, False), ("eczema", 6.0, False), ("melasma", 2.0, False), ("controle-de-oleosidade", -8.0, True), ("gravidez", 0.0, True)]
    df = spark.createDataFrame([("d", i, s, "x", v, w) for i, (s, v, w) in enumerate(rows)], "doc string, ord int, slug string, ingredient string, impact double, warning boolean")
    got = match.reason_groups(df).orderBy("pos").collect()
    assert [r.slug for r in got] == ["gravidez", "controle-de-oleosidade", "melasma", "eczema", "caspa", "muito-seca"]
    assert [r.percent for r in got] == [0, 0, 10, 30, 100, 60]


def test_ingredient_resolution(spark):
    ingredients = spark.createDataFrame([(2, "AQUA", "WATER"), (3, "GLYCINE", None)], "id bigint, inci string, common string")
    aliases = spark.createDataFrame([(3, "AMINOACETIC ACID")], "id bigint, alias string")
    names = spark.createDataFrame([("s", i, n) for i, n in enumerate(["AQUA", "WATER", "AMINOACETIC ACID", "QLYCINE", "UNKNOWN", "aqua.", "CEP 0"])], "scan_id string, position int, raw string")
    got = resolve.resolved(names, ingredients, aliases)
    assert [r.status for r in got.orderBy("position").collect()] == ["KNOWN", "COMMON_NAME", "ALIAS", "KNOWN", "NOT_FOUND", "KNOWN", "ADMINISTRATIVE_NOISE"]
    r = resolve.report(got).first()
    assert (r.resolved, r.unresolved, r.validation) == (5, 2, "NEEDS_REVIEW")


def test_ambiguous_names(spark):
    ingredients = spark.createDataFrame([(1, "ALPHABETIC OIL", None), (2, "ALPHABETID OIL", None)], "id bigint, inci string, common string")
    aliases = spark.createDataFrame([], "id bigint, alias string")
    names = spark.createDataFrame([("s", 1, "ALPHABETIX OIL")], "scan_id string, position int, raw string")
    r = resolve.resolved(names, ingredients, aliases).first()
    assert (r.status, r.method, r.ids) == ("AMBIGUOUS", "FUZZY_AMBIGUOUS", "1,2")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, text.slug(lit("  Ação & Reação! "))) == "acao-reacao"
    assert one(spark, text.norm_field(lit("Loção (48 H) 1,5%"))) == "LOCAO 48 H 1 5"
    assert one(spark, text.norm_front(lit("protege 48 h já"))) == "PROTEGE 48H JA"
    assert one(spark, text.norm_back(lit("Água, 1.5 L; café"))) == "AGUA 1.5 L CAFE"
    assert one(spark, text.norm_ingredient_key(lit(" ;Álcool – “X”. "))) == 'ALCOOL - "X"'
    assert one(spark, text.similarity(lit("CLEAN"), lit("CLEAN MEN"))) == 0.84 + 5 / 9 * 0.13
    assert one(spark, text.ocr_similarity(lit("REX0NA"), lit("REXONA"))) == 1.0
    assert one(spark, text.ocr_similarity(lit("NlV"), lit("NIV"), brand=True)) == 0.0
    assert one(spark, text.strip_brand(lit("Rexona Men"), lit("REXONA"))) == "MEN" and one(spark, text.strip_brand(lit("re xona"), lit("RE XONA"))) == ""
    assert one(spark, text.identity_tokens(lit("REXONA CREME DE MEN 150 ML"))) == ["REXONA", "MEN"]
    assert one(spark, text.ngrams(lit("a b c"))) == ["A B C", "A B", "B C"]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.ean_ok(lit("7891000100103"))) is True and one(spark, scalars.ean_ok(lit("7891000100104"))) is False and one(spark, scalars.ean_ok(lit("1"))) is False
    assert one(spark, scalars.capacity(lit("creme 1,5 m1"))) == "1,5 ML" and one(spark, scalars.capacity(lit("O150 ml"))) == "150 ML" and one(spark, scalars.capacity(lit("x"))) == ""
    assert one(spark, scalars.concentration(lit("2.5 % acid"))) == "2.5%"
    assert one(spark, scalars.error_code(lit("{nope"))) is None
    assert one(spark, scalars.is_due(lit(None).cast("bigint"), lit(1))) is True
    assert one(spark, projections.block_reason(lit(0.2), lit(0.99))) == "TOO_BRIGHT"
    assert one(spark, projections.stale(lit(False), lit("2024-01-01T00:00:00-03:00"), lit(1704078000001))) is True
    assert one(spark, projections.stale(lit(False), lit("soon"), lit(1))) is False


def test_extraction(spark):
    lit = F.lit
    assert one(spark, extract.net_content(lit("80133324 G"))) == ""
    assert one(spark, extract.net_content(lit("90 G\nCONTEUDO: 150 ML"))) == "150 ML" and one(spark, extract.net_content(lit("90 G"))) == "90 G"
    assert one(spark, extract.contacts(lit("sac@x.com ou (11) 4004-1234, sac@x.com"))) == "(11) 4004-1234 | sac@x.com"
    assert one(spark, extract.barcode(lit("99999999 7891000100103 1"))) == "7891000100103"


def test_likes(spark):
    rows = [(1, 10, True, 1), (1, 11, True, 2), (1, 10, True, 3), (1, 11, False, 4), (1, 12, False, 5), (1, 11, True, 6)]
    df = spark.createDataFrame(rows, "uid int, product_id int, liked boolean, ord int")
    assert [(r.product_id, r.since) for r in reconcile.like_state(df).orderBy("pos").collect()] == [(11, 6), (10, 1)]
    assert {r.product_id: r.send for r in reconcile.queues(df).collect()} == {10: "like", 11: "like", 12: "unlike"}


def test_polls_over_a_stream(spark, tmp_path):
    """The first poll tells nothing, the second what was decided since; a decision that is taken back and comes again is told again."""
    schema = "uid int, scan_id int, status string, ord int"
    polls = [[(1, 1, "APPROVED", 1), (1, 2, "PENDING", 2)], [(1, 2, "REJECTED", 3), (2, 9, "APPROVED", 4)], [(1, 1, "PENDING", 5)], [(1, 1, "APPROVED", 6)]]
    for k, rows in enumerate(polls):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        decisions.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    news = [sorted((r.uid, r.scan_id) for r in spark.read.parquet(str(tmp_path / "out" / "news" / str(k))).collect()) for k in range(4)]
    assert news == [[], [(1, 2)], [], [(1, 1)]]


def fronts(spark, brands, seen, listed, brand="REXONA"):
    front = spark.createDataFrame([("s", brands, seen)], "scan_id string, brand_candidates array<string>, product_candidates array<string>")
    items = spark.createDataFrame([(i, n, brand, o) for o, (i, n) in enumerate(listed)], "id bigint, name string, brand_name string, ord bigint")
    return products.resolved(front, items).first()


def test_product_resolution(spark):
    r = fronts(spark, ["REXONA"], ["ANTITRANSPIRANTE", "ORIGINAL", "150 ML"], [(8, "Rexona Invisible 150 ML"), (7, "Rexona Original 150 ML")])
    assert (r.status, r.id) == ("RESOLVED", 7)
    r = fronts(spark, ["REXONA"], ["CLINICAL"], [(11, "Rexona Clinical"), (12, "Rexona Clinical")])
    assert (r.status, r.id, r.gap) == ("AMBIGUOUS", None, 0.0)
    r = fronts(spark, ["REX0NA"], ["CLINICAL", "CLEAN", "MEN", "ANTITRANSPIRANTE", "58 G"], [(108, "Rexona Clinical Clean"), (109, "Rexona Clinical Clean Men")])
    assert (r.status, r.id) == ("RESOLVED", 109)
    r = fronts(spark, ["REXONA"], ["INVISIBLE", "MEN", "AEROSOL", "150 ML"], [(201, "Rexona Men Original 150 ML"), (202, "Rexona Men Invisible 150 ML")])
    assert (r.status, r.id) == ("RESOLVED", 202)
    assert fronts(spark, [], [], [(1, "Rexona")]).status == "NO_MATCH"
    assert fronts(spark, ["ZZZZZZ"], ["QQQQQQ"], [(1, "Rexona Clean")]).status == "NO_MATCH"


def test_folds_keep_an_earlier_best_as_second(spark):
    rows = F.array(*[F.struct(F.lit(b).alias("brand"), F.lit("c").alias("cand"), F.lit(s).alias("score")) for b, s in (("X", 0.9), ("X", 0.95), ("Y", 0.85))])
    m = one(spark, products.best_brand(rows))
    assert (m.brand, m.score, m.second) == ("X", 0.95, 0.9)
