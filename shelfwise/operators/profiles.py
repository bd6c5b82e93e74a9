"""Profiles: answers to a service's record and back, chosen tags and allergies, labels, and front candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..plans.registry import query
from ..sources import bindings as b

#: What the service accepts of each answer.
ACCEPTED = {
    "gender": ("FEMALE", "MALE", "NON_BINARY", "OTHER", "PREFER_NOT_SAY"),
    "skin": ("NORMAL", "DRY", "OILY", "COMBINATION", "SENSITIVE", "ACNEIC", "OTHER"),
    "phototype": ("I", "II", "III", "IV", "V", "VI"),
    "hair": ("TYPE_1A", "TYPE_1B", "TYPE_1C", "TYPE_2A", "TYPE_2B", "TYPE_2C", "TYPE_3A", "TYPE_3B", "TYPE_3C", "TYPE_4A", "TYPE_4B", "TYPE_4C"),
    "scalp": ("NORMAL", "DRY", "OILY", "SENSITIVE", "DANDRUFF", "OTHER"),
    "sensitivity": ("LOW", "MEDIUM", "HIGH", "VERY_HIGH"),
    "age": ("AGE_18_24", "AGE_25_34", "AGE_35_44", "AGE_45_54", "AGE_55_PLUS"),
}
#: What the device shows of them where that differs.
SHOWN = ACCEPTED | {"skin": ("NORMAL", "DRY", "OILY", "COMBINATION", "SENSITIVE"), "sensitivity": ("LOW", "MEDIUM", "HIGH"), "age": ("AGE_13_17", *ACCEPTED["age"])}
CONDITIONS = ("acneProne", "hasRosacea", "hasEczema", "hasHyperpigmentation", "hasMelasma")
#: Tags that an option stands for.
OPTION_TAGS = {"sem-alcool": ("sem-alcool",), "sem-oleo": ("sem-oleo",), "natural": ("natural", "ingredientes-naturais"), "organico": ("organico",), "hipoalergenico": ("hipoalergenico",)}
#: Words on a label's front that say little.
GENERIC = (
    "CREME", "LOCAO", "GEL", "SPRAY", "AEROSOL", "FRESH", "ORIGINAL", "PROTECAO", "ANTITRANSPIRANTE", "ANTIPERSPIRANTE", "PERFUME", "MASCULINO", "FEMININO", "INFANTIL", "DESODORANTE",
    "HIDRATANTE", "NOVO", "NOVA", "SHAMPOO", "CONDICIONADOR", "SABONETE", "LOÇÃO", "BODY", "LOTION", "DEODORANT", "KIT", "PRODUTO", "CUIDADO", "CUIDADOS", "CONTROLE", "INTELIGENTE", "ODOR",
    "ODORE", "SUOR", "INVISIBLE",
)


def to_service(answers: dict[str, Column]) -> Column:
    """A struct of the answers; null as a whole if any of them is missing or not accepted."""
    hair = F.when(answers["hair"] == "TYPE_1", "TYPE_1A").otherwise(answers["hair"])
    fields = answers | {"hair": hair}
    every = F.lit(True)
    for k, c in fields.items():
        every = every & F.coalesce(c.isin(*ACCEPTED[k]), F.lit(False))
    return F.when(every, F.struct(*[c.alias(k) for k, c in fields.items()]))


def marked(flags: dict[str, Column]) -> Column:
    """Names of the true flags; NONE if flags were answered and none is true; empty if none was answered."""
    true = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    answered = F.coalesce(*flags.values()).isNotNull()
    return F.when((F.size(true) == 0) & answered, F.array(F.lit("NONE"))).otherwise(true)


def chosen_tags(people: DataFrame, tags: DataFrame) -> DataFrame:
    """(person, id): tags whose slug or name is one that a person's options stand for."""
    stands = F.create_map(*[x for k, v in OPTION_TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wanted = people.select("person", F.explode("options").alias("o")).select("person", F.explode(stands[slug(F.col("o"))]).alias("key")).distinct()
    keys = tags.where("id is not null").select("id", F.explode(F.array_distinct(F.array(slug(F.col("slug")), slug(F.col("name"))))).alias("key"))
    return wanted.join(keys, "key").select("person", "id").distinct()


def chosen_allergies(people: DataFrame, allergies: DataFrame) -> DataFrame:
    wanted = people.select("person", F.explode("options").alias("o")).select("person", slug(F.col("o")).alias("key")).distinct()
    return wanted.join(allergies.where("id is not null").select("id", slug(F.col("name")).alias("key")), "key").select("person", "id").distinct()


def labels(tags: Column, allergies: Column) -> Column:
    """What to show of tags and allergies: distinct, in order of characters."""
    said = F.concat(F.transform(tags, lambda t: F.replace(t, F.lit("-"), F.lit(" "))), F.transform(allergies, lambda a: F.concat(F.lit("alergia a "), F.replace(a, F.lit("-"), F.lit(" ")))))
    return F.array_sort(F.array_distinct(said))


def informative(value: Column) -> Column:
    clean = F.transform(F.split(F.upper(F.trim(value)), "\\s+"), lambda t: F.regexp_replace(t, "[^A-ZÀ-ÿ]", ""))
    return (F.length(F.trim(value)) >= 2) & F.exists(clean, lambda t: (t != "") & ~t.isin(*GENERIC))


def front_candidate(values: Column) -> Column:
    """The candidate that names a product best: early, of some words, short, without digits and generic words."""
    some = F.exists(values, lambda v: F.coalesce(informative(v), F.lit(False)))

    def scored(v: Column, i: Column) -> Column:
        t = F.regexp_replace(F.trim(v), "\\s+", " ")
        words = F.split(F.upper(t), " ")
        score = 100 - i * 3 + F.least(F.size(words), F.lit(3)) * 4 + F.when(F.length(t) <= 40, 5).otherwise(0) - F.when(t.rlike("\\d"), 12).otherwise(0) - F.size(F.filter(words, lambda w: w.isin(*GENERIC))) * 18
        fits = F.length(t).between(2, 80) & t.rlike("[A-Za-zÀ-ÿ]") & (~some | informative(t))
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(score.alias("s"), (-i).alias("i"), t.alias("t")))

    return F.array_max(F.transform(values, scored))["t"]


@query("SELECT c_custkey, c_nationkey <> 3 AND c_mktsegment <> 'FURNITURE' AS whole, CASE WHEN c_nationkey <> 3 AND c_mktsegment <> 'FURNITURE' THEN 'TYPE_1A' END AS hair FROM customer")
def prj_profile_to_api(spark, sf_dir):
    skin = F.when(F.col("c_mktsegment") == "FURNITURE", "GLASS").otherwise("DRY")
    answers = {"gender": F.when(F.col("c_nationkey") != 3, "OTHER"), "skin": skin, "phototype": F.lit("IV"), "hair": F.lit("TYPE_1"), "scalp": F.lit("DRY"), "sensitivity": F.lit("LOW"), "age": F.lit("AGE_18_24")}
    r = to_service(answers)
    return b.table(spark, sf_dir, "customer").select("c_custkey", r.isNotNull().alias("whole"), r["hair"].alias("hair"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'NONE' WHEN c_nationkey % 4 = 3 THEN '' ELSE 'acneProne' || CASE WHEN c_nationkey % 4 = 2 THEN ',hasMelasma' ELSE '' END END AS conditions,
CASE WHEN c_custkey % 2 = 0 THEN 'DRY' END AS skin FROM customer"""
)
def prj_profile_from_api(spark, sf_dir):
    k = F.col("c_nationkey") % 4
    answered = lambda c: F.when(k != 3, c)
    flags = {c: answered(F.lit(False)) for c in CONDITIONS} | {"acneProne": answered(k > 0), "hasMelasma": answered(k == 2)}
    skin = F.when(F.col("c_custkey") % 2 == 0, "DRY").otherwise("ACNEIC")
    return b.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(marked(flags), ",").alias("conditions"), F.when(skin.isin(*SHOWN["skin"]), skin).alias("skin"))


def _people(spark, sf_dir) -> DataFrame:
    options = F.array(F.when(F.col("c_custkey") % 2 == 0, "Natural"), F.when(F.col("c_custkey") % 3 == 0, "Sem álcool"), F.lit("Outra"))
    return b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.array_compact(options).alias("options"))


@query("SELECT c_custkey AS person, id FROM customer, (VALUES (1::BIGINT, 2), (2::BIGINT, 2), (4::BIGINT, 3)) t(id, m) WHERE c_custkey % m = 0")
def join_tag_choice(spark, sf_dir):
    tags = spark.createDataFrame([(1, "natural", "x"), (2, "y", "Ingredientes Naturais"), (3, "z", "w"), (4, "sem-alcool", "Sem álcool"), (None, "natural", "n")], "id bigint, slug string, name string")
    return chosen_tags(_people(spark, sf_dir), tags)


@query("SELECT c_custkey AS person, id FROM customer, (VALUES (7::BIGINT, 2), (8::BIGINT, 1)) t(id, m) WHERE c_custkey % m = 0")
def join_allergy_choice(spark, sf_dir):
    return chosen_allergies(_people(spark, sf_dir), spark.createDataFrame([(7, "NATURAL"), (8, "outra"), (9, "nada"), (None, "outra")], "id bigint, name string"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'alergia a ' || lower(n_name) || ',' ELSE '' END || 'sem ' || lower(n_name) AS labels FROM nation")
def sort_labels(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation")
    name = F.lower("n_name")
    return n.select("n_nationkey", F.array_join(labels(F.array(F.concat(F.lit("sem-"), name), F.concat(F.lit("sem-"), name)), F.when(F.col("n_nationkey") % 2 == 0, F.array(name)).otherwise(F.array().cast("array<string>"))), ",").alias("labels"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' plus' ELSE upper(p_name) END AS best FROM part")
def pick_front_candidate(spark, sf_dir):
    values = F.array(F.lit("SHAMPOO"), F.lit(None), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("  plus "))).otherwise(F.upper("p_name")), F.concat(F.lit("KIT 3 "), "p_name"))
    return b.table(spark, sf_dir, "part").select("p_partkey", front_candidate(values).alias("best"))
