"""Is a label a cosmetic's? Terms are met by equi-joins of a label's word runs with a table of terms, then weighed.

`labels` is (scan_id, text, has_brand, has_product, has_presentation, has_capacity); `terms` is (kind, name, precise, alias), a
small table that the caller may replace: kinds are CATEGORY, CONTEXT, STRUCTURE, SUPPORT, FORMULA, OTHER (no cosmetic), UI (a
screen, no label: callers add the names of their own app), BRAND and FORM. An alias is met as whole words; one word of seven letters or more also by a word within
one edit (two beyond twelve letters), found through the words that both become by leaving letters out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.text import norm_field
from ..plans.registry import query
from ..sources import bindings as b
from .front_reader import BRANDS

#: Terms of where a product is used, by name.
CONTEXT = {
    "pele": ("PELE", "SKIN", "SKINCARE", "SKIN CARE", "CUIDADO DA PELE", "CUIDADOS COM A PELE", "CUIDADO FACIAL", "FACIAL CARE", "FACE CARE", "ROSTO", "FACIAL", "FACE"),
    "cabelo": ("CABELO", "CABELOS", "HAIR", "HAIRCARE", "HAIR CARE", "CUIDADO DOS CABELOS", "CUIDADOS COM O CABELO", "COURO CABELUDO", "SCALP"),
    "corpo": ("CORPO", "BODY", "BODY CARE", "BODYCARE", "CUIDADO CORPORAL", "CUIDADOS COM O CORPO"),
    "axilas": ("AXILA", "AXILAS", "ARMPIT", "UNDERARM"),
    "barba/barbear": ("BARBA", "BARBEAR", "BEARD", "SHAVE", "SHAVING"),
    "labios": ("LABIOS", "LIPS", "LIP CARE"),
    "olhos": ("OLHOS", "EYES", "EYE AREA", "EYE CONTOUR"),
    "unhas": ("UNHAS", "NAILS", "NAIL CARE"),
    "higiene pessoal": ("HIGIENE PESSOAL", "PERSONAL CARE", "PERSONAL HYGIENE", "CUIDADO PESSOAL"),
    "perfumaria": ("FRAGRANCE", "FRAGRANCIA", "PERFUMERY", "PERFUMARIA"),
    "maquiagem": ("BEAUTY", "BELEZA", "MAKEUP", "MAKE UP", "MAQUILLAGE", "MAQUILLAJE"),
}
#: Terms of a label's parts, of support, of formulas, of screens, and of the form of a product.
STRUCTURE = {
    "composition": ("INGREDIENTES", "INCI", "COMPOSICAO", "INGREDIENTS"),
    "usage": ("MODO DE USO", "HOW TO USE", "DIRECTIONS", "INSTRUCOES DE USO"),
    "warning": ("ADVERTENCIA", "ADVERTENCIAS", "PRECAUCOES", "PRECAUTIONS"),
    "service": ("SAC", "SERVICO DE ATENDIMENTO", "CUSTOMER SERVICE"),
}
SUPPORT = {
    "composition": ("INGREDIENTES", "INGREDIENTE", "INGREDIENT", "INGREDIENTS", "COMPOSICAO", "COMPOSITION", "INCI"),
    "claim": (
        "VEGAN", "VEGANO", "VEGANA", "CRUELTY FREE", "DERMATOLOGICAMENTE TESTADO", "DERMATOLOGICALLY TESTED", "HIPOALERGENICO", "HYPOALLERGENIC", "SEM PARABENOS", "PARABEN FREE", "SEM SULFATOS",
        "SULFATE FREE", "SEM SILICONE", "SILICONE FREE", "SEM ALCOOL", "ALCOHOL FREE", "OIL FREE", "WATERPROOF", "VEGAN FRIENDLY", "NATURAL COSMETICS",
    ),
    "benefit": (
        "HIDRATANTE", "MOISTURIZING", "HYDRATING", "NOURISHING", "NUTRITIVO", "NUTRICAO", "REPAIR", "REPARACAO", "REPARADOR", "ANTI AGING", "ANTIOXIDANTE", "ANTIOXIDANT", "CALMANTE", "SOOTHING",
        "PROTETOR", "PROTECTION", "MATTIFYING", "MATIFICANTE",
    ),
}
FORMULA = ("AQUA", "PARFUM", "GLYCERIN", "GLYCERINE", "DIMETHICONOL", "LIMONENE", "LINALOOL", "CITRIC ACID", "SODIUM BENZOATE", "TOCOPHEROL", "BUTANE", "ISOBUTANE", "PROPANE")
UI = {
    "android": ("ANDROID", "ANDROID V"), "logcat": ("LOGCAT",), "login": ("LOGINACTIVITY",), "menu": ("MENUACTIVITY",),
    "wifi": ("WIFISTAIFACEHIDLIMPL",), "surface": ("SURFACEFLINGER",), "source": ("SRC MAIN JAVA",), "server": ("SYSTEM SERVER",),
    "device": ("SAMSUNG", "SM S911B"), "keys": ("CTRL", "CTRL I", "CTRL TL"),
}
FORM = {"cream": ("CREME", "CREAM"), "lotion": ("LOCAO", "LOTION"), "gel": ("GEL",), "oil": ("OLEO", "OIL"), "soap": ("SOAP",)}
#: The forms that count as context of their own where one of these contexts is met.
FORM_AREAS = {"cream": ("pele", "corpo"), "lotion": ("corpo",), "gel": ("pele", "cabelo", "corpo"), "oil": ("cabelo", "barba/barbear", "pele", "corpo"), "soap": ("higiene pessoal", "corpo", "pele")}
#: A beginning of the tables that callers give whole: groups of categories (precise or not), other goods, and brands.
CATEGORY = {
    "DESODORANTE": (True, ("DESODORANTE", "DEODORANT", "DEODOR")),
    "ANTITRANSPIRANTE": (True, ("ANTITRANSPIRANTE", "ANTIPERSPIRANTE", "ANTITRANSPIRANT", "ANTIPERSPIRANT")),
    "SABONETE": (True, ("SABONETE", "SABONET", "BODY SOAP", "TOILET SOAP", "FACIAL SOAP", "HAND SOAP")),
    "SHAMPOO": (True, ("SHAMPOO",)),
    "COSMETICO": (False, ("COSMETICO", "COSMETIC")),
}
OTHER = {
    "medicine": ("REMEDIO", "MEDICAL", "MEDICINAL", "COMPRIMIDO", "TABLET", "CAPSULA", "CAPSULE", "XAROPE", "SYRUP", "DOSAGEM"),
    "food": ("ALIMENTO", "FOOD", "BEBIDA", "BEVERAGE", "SUCO", "JUICE", "CHOCOLATE", "BISCOITO", "CEREAL", "QUEIJO", "CHEESE"),
    "cleaner": ("DETERGENTE", "DETERGENT", "DESINFETANTE", "DISINFECTANT", "AMACIANTE", "ALVEJANTE", "BLEACH"),
}
#: What each sign adds to the score, and the scores that decide.
PRECISE, PLAIN, MORE_CATEGORIES, CONTEXTS, MORE_CONTEXTS, HAS_BRAND, HAS_PRODUCT, HAS_PRESENTATION, HAS_CAPACITY = 0.70, 0.62, 0.06, 0.07, 0.05, 0.04, 0.04, 0.02, 0.02
PARTS, KNOWN_BRAND, SUPPORTED, MORE_SUPPORT, EXPLICIT = 0.04, 0.05, 0.04, 0.03, 0.07
CONFIRMED, CONFIRMED_PRECISE, UNCERTAIN, FLOOR, CONFLICT, SCREEN, NO_COSMETIC = 0.78, 0.70, 0.77, 0.20, 0.30, 0.10, 0.98
KINDS = ("CATEGORY", "CONTEXT", "STRUCTURE", "SUPPORT", "FORMULA", "OTHER", "UI", "BRAND", "FORM")
WORDS, NEAR_FROM, FAR_FROM = 5, 7, 12


def known_terms(spark) -> DataFrame:
    """The default table of terms."""
    named = {"CONTEXT": CONTEXT, "STRUCTURE": STRUCTURE, "SUPPORT": SUPPORT, "OTHER": OTHER, "UI": UI, "FORM": FORM, "FORMULA": {w: (w,) for w in FORMULA}, "BRAND": {w: (w,) for w in BRANDS}}
    rows = [(kind, name, False, a) for kind, groups in named.items() for name, aliases in groups.items() for a in aliases]
    rows += [("CATEGORY", name, precise, a) for name, (precise, aliases) in CATEGORY.items() for a in aliases]
    return spark.createDataFrame(rows, "kind string, name string, precise boolean, alias string")


def without_letters(word: Column) -> Column:
    """A word and what is left of it without any one letter, or any two beyond FAR_FROM letters."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substr(w, i + 1)))
    first = one(word)
    return F.array_distinct(F.concat(F.array(word), first, F.when(F.length(word) >= FAR_FROM, F.flatten(F.transform(first, one))).otherwise(F.array().cast("array<string>"))))


def met(labels: DataFrame, terms: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(scan_id, kind, name, precise): the terms that each label holds, each once."""
    wanted = terms.where(F.col("kind").isin(*kinds))
    said = labels.select("scan_id", F.filter(F.split(norm_field(F.col("text")), " +"), lambda t: t != "").alias("w"))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda k: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - k)), lambda i: F.array_join(F.slice("w", i + 1, k), " ")))))
    exact = said.where(F.size("w") > 0).select("scan_id", F.explode(runs).alias("alias")).join(small(wanted), "alias").select("scan_id", "kind", "name", "precise")
    # the parts of screens and forms of products are met as they are written
    loose = wanted.where(~F.col("kind").isin("UI", "FORM", "BRAND") & (F.length("alias") >= NEAR_FROM) & ~F.col("alias").contains(" "))
    words = said.select(F.explode(F.array_distinct("w")).alias("word")).distinct().where(F.length("word") >= NEAR_FROM - 1)
    pairs = words.withColumn("v", F.explode(without_letters(F.col("word")))).join(small(loose.select("kind", "name", "precise", "alias", F.explode(without_letters(F.col("alias"))).alias("v"))), "v")
    most = F.when(F.length("alias") <= FAR_FROM, 1).otherwise(2)
    near = pairs.where(F.levenshtein("word", "alias") <= most).select("word", "kind", "name", "precise").distinct()
    by_word = said.select("scan_id", F.explode(F.array_distinct("w")).alias("word")).join(near, "word").select("scan_id", "kind", "name", "precise")
    return exact.unionByName(by_word).distinct()


def evidence(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(scan_id, a set of names for each kind, precise): what each label shows, contexts with forms that go with them."""
    signs = met(labels, terms)
    sets = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(k.lower()) for k in KINDS]
    held = labels.join(signs.groupBy("scan_id").agg(*sets, F.bool_or((F.col("kind") == "CATEGORY") & F.col("precise")).alias("precise")), "scan_id", "left")
    held = held.withColumns({k.lower(): F.coalesce(k.lower(), F.array().cast("array<string>")) for k in KINDS}).withColumn("precise", F.coalesce("precise", F.lit(False)))
    with_form = [F.when(F.array_contains("form", f) & F.arrays_overlap("context", F.array(*map(F.lit, areas))), F.lit(f"{f} there")) for f, areas in FORM_AREAS.items()]
    hair = F.when(F.array_contains("form", "cream") & F.array_contains("context", "cabelo"), F.lit("cream in hair"))
    out = held.withColumn("context", F.concat("context", F.array_compact(F.array(*with_form, hair))))
    return out.withColumn("support", F.when(F.size("formula") >= 2, F.concat("support", F.array(F.lit("formula")))).otherwise(F.col("support")))


def classified(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(scan_id, status, score) of every label."""
    e = evidence(labels, terms)
    n = {k.lower(): F.size(k.lower()) for k in KINDS}
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    explicit = F.array_contains("category", "COSMETICO")
    real = n["category"] - F.when(explicit, 1).otherwise(0) > 0
    precise, parts, brand = F.col("precise"), has("has_product") | has("has_brand") | has("has_presentation") | has("has_capacity"), n["brand"] > 0
    context, contexts, support = n["context"] >= 1, n["context"] >= 2, n["support"] >= 1
    gains = [
        (real & precise, PRECISE), (real & ~precise, PLAIN), (n["category"] >= 2, MORE_CATEGORIES), (context, CONTEXTS), (contexts, MORE_CONTEXTS), (has("has_brand"), HAS_BRAND), (has("has_product"), HAS_PRODUCT),
        (has("has_presentation"), HAS_PRESENTATION), (has("has_capacity"), HAS_CAPACITY), (n["structure"] > 0, PARTS), (brand, KNOWN_BRAND), (support, SUPPORTED), (n["support"] >= 2, MORE_SUPPORT), (explicit & parts, EXPLICIT),
    ]
    # hundredths, so that sums are exact
    score = F.least(F.lit(100), sum([F.when(g, round(v * 100)).otherwise(0) for g, v in gains], F.lit(0))) / 100
    cream, lotion = F.array_contains("form", "cream"), F.array_contains("form", "lotion")
    paths = precise | (real & (context | parts | support)) | (contexts & parts & (support | brand)) | (brand & (cream | (lotion & F.array_contains("context", "corpo")) | real))
    sure = F.when(explicit & ~real, parts & (context | support | brand)).otherwise(paths)
    enough = (score >= CONFIRMED) | (precise & (score >= CONFIRMED_PRECISE)) | (brand & (real | (cream & context)) & (score >= CONFIRMED_PRECISE))
    cosmetic = (n["category"] > 0) | context | support | brand
    cases = [(n["ui"] >= 2, "UNCERTAIN", F.lit(SCREEN)), ((n["other"] > 0) & cosmetic, "UNCERTAIN", F.lit(CONFLICT)), (n["other"] > 0, "NON_COSMETIC", F.lit(NO_COSMETIC)), (sure & enough, "COSMETIC_CONFIRMED", score)]
    low = F.least(F.lit(UNCERTAIN), score)
    status, value = F.lit("UNCERTAIN"), F.when((low <= 0) & (context | (n["structure"] > 0) | support), F.lit(FLOOR)).otherwise(low)
    for cond, name, points in reversed(cases):
        status, value = F.when(cond, F.lit(name)).otherwise(status), F.when(cond, points).otherwise(value)
    return e.select("scan_id", status.alias("status"), value.alias("score"))


def opens_new_product(in_catalogue: Column, status: Column) -> Column:
    """A new product is asked for only if the catalogue lacks it and the label is a cosmetic's for sure."""
    return ~F.coalesce(in_catalogue, F.lit(False)) & F.coalesce(status == "COSMETIC_CONFIRMED", F.lit(False))


# -- queries: labels of parts, one of ten texts each

_TEXTS = (
    "'Desodorante ' || p_name", "'Desodrante ' || p_name || ' pele'", "'Creme corpo ' || p_name || ' vegano'", "'Chocolate ' || p_size", "'Chocolate pele'", "'Android logcat ' || p_name", "p_name",
    "'Cosmetico ' || p_name || ' pele'", "'Modo de uso ' || p_name", "'Nivea creme pele aqua parfum'",
)
_SQL_TEXT = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END"


def labels(spark, sf_dir) -> DataFrame:
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 10
    return p.select(F.col("p_partkey").alias("scan_id"), F.expr(_SQL_TEXT).alias("text"), (k != 6).alias("has_brand"), (k == 7).alias("has_product"), F.lit(False).alias("has_presentation"), (k == 2).alias("has_capacity"))


def _sets(column: str, cases: dict[int, tuple[str, ...]]) -> str:
    return "SELECT p_partkey AS scan_id, CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{','.join(v)}'" for k, v in cases.items()) + f" ELSE '' END AS {column} FROM part"


def _shown(spark, sf_dir, column: str) -> DataFrame:
    return evidence(labels(spark, sf_dir), known_terms(spark)).select("scan_id", F.array_join(column, ",").alias(column))


query(_sets("category", {0: ("DESODORANTE",), 1: ("DESODORANTE",), 7: ("COSMETICO",)}), "cls_categories")(lambda s, d: _shown(s, d, "category"))
query(_sets("context", {1: ("pele",), 2: ("corpo", "cream there"), 4: ("pele",), 7: ("pele",), 9: ("pele", "cream there")}), "cls_context")(lambda s, d: _shown(s, d, "context"))
query(_sets("structure", {8: ("usage",)}), "cls_structure")(lambda s, d: _shown(s, d, "structure"))
query(_sets("support", {2: ("claim",), 9: ("formula",)}), "cls_support")(lambda s, d: _shown(s, d, "support"))
query(_sets("ui", {5: ("android", "logcat")}), "cls_ui")(lambda s, d: _shown(s, d, "ui"))

_STATUS = {0: ("COSMETIC_CONFIRMED", 0.74), 1: ("COSMETIC_CONFIRMED", 0.81), 2: ("UNCERTAIN", 0.22), 3: ("NON_COSMETIC", 0.98), 4: ("UNCERTAIN", 0.3), 5: ("UNCERTAIN", 0.1), 6: ("UNCERTAIN", 0.0), 7: ("UNCERTAIN", 0.22), 8: ("UNCERTAIN", 0.08), 9: ("UNCERTAIN", 0.25)}
_CASE = " ".join(f"WHEN {k} THEN '{s}'" for k, (s, _) in _STATUS.items())
_POINTS = " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, (_, v) in _STATUS.items())


@query(f"SELECT p_partkey AS scan_id, CASE p_partkey % 10 {_CASE} END AS status, CASE p_partkey % 10 {_POINTS} END AS score FROM part")
def cls_cosmetic(spark, sf_dir):
    return classified(labels(spark, sf_dir), known_terms(spark))


@query("SELECT p_partkey AS scan_id, p_partkey % 10 IN (0, 1) AND p_partkey % 3 <> 0 AS opens FROM part")
def cls_gate(spark, sf_dir):
    c = classified(labels(spark, sf_dir), known_terms(spark))
    return c.select("scan_id", opens_new_product(F.col("scan_id") % 3 == 0, F.col("status")).alias("opens"))
