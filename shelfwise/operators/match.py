"""Personal match: effects of ingredients against a person's tags and allergies, score reasons, and their merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slug
from ..plans.registry import query
from ..sources import bindings as b

#: Kinds of points in their order, and tags whose absence is worth telling.
KINDS = ("GRAVE", "ALERTA", "BENEFICIO", "AUSENCIA")
WARNING_TAGS = ("sem-silicone", "sem-sulfato", "gravidez")
TAGS = ("sem-silicone", "sem-sulfato", "reparo-da-barreira", "hidratacao", "gravidez", "muito-seca")
#: The impact of a full question, and the percentage from which an answer matches.
FULL_IMPACT, MATCH_FROM = 20.0, 50
#: Parts (a key and a name) up to so many are sent to all tasks.
MOST_PARTS = 2_000_000


def kind_of(category: Column) -> Column:
    return F.when(category == "CONTRAINDICATION", "GRAVE").when(category == "WARNING", "ALERTA").when(category == "BENEFIT", "BENEFICIO")


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def allergic(ingredient: Column, allergies: Column) -> Column:
    """Whether an allergy's slug is a run of whole words of the ingredient's slug."""
    inside = F.concat(F.lit("-"), slug(ingredient), F.lit("-"))
    return F.exists(allergies, lambda a: (a != "") & inside.contains(F.concat(F.lit("-"), a, F.lit("-"))))


def points(effects: DataFrame) -> DataFrame:
    """(person, kind, slug, effect, ingredients) of the effects that concern a person, ingredients in order; with absences.

    `effects`: person, ord, name, slug (null if unknown), category, effect, wanted (the person has the tag), tags.
    """
    own = effects.withColumn("kind", F.when(F.col("slug").isNotNull() & F.col("wanted"), kind_of(F.col("category"))))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]))
    found = own.where("kind is not null").groupBy("person", "kind", "slug", "effect").agg(names.alias("names"))
    covered = effects.groupBy("person").agg(F.first("tags").alias("tags"))
    missing = covered.select("person", F.explode(F.array_intersect("tags", F.array(*map(F.lit, WARNING_TAGS)))).alias("slug"))
    warned = found.where(F.col("kind").isin("GRAVE", "ALERTA")).select("person", "slug").distinct()
    absent = missing.join(warned, ["person", "slug"], "left_anti").select("person", F.lit("AUSENCIA").alias("kind"), "slug", F.lit("").alias("effect"), F.array().cast("array<string>").alias("names"))
    return found.unionByName(absent)


def highlights(effects: DataFrame, found: DataFrame) -> DataFrame:
    """(person, mark, effect): other effects, the first of each tag, without tags that are points already."""
    own = effects.withColumn("kind", F.when(F.col("slug").isNotNull() & F.col("wanted"), kind_of(F.col("category"))))
    other = own.where(F.col("kind").isNull() & (F.col("effect") != "")).withColumn("mark", F.coalesce("slug", "effect"))
    w = Window.partitionBy("person", "mark").orderBy("ord")
    first = other.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.join(found.select("person", F.col("slug").alias("mark")).distinct(), ["person", "mark"], "left_anti").select("person", "mark", "effect")


def verdict(kinds: Column, any_allergy: Column) -> Column:
    has = lambda k: F.array_contains(kinds, k)
    return F.when(any_allergy | has("GRAVE"), "NAO_RECOMENDADO").when(has("ALERTA"), "ATENCAO").when(has("BENEFICIO"), "COMBINA").otherwise("SEM_ALERTAS")


def reason_groups(reasons: DataFrame) -> DataFrame:
    """(doc, slug, effect, percent, names, pos) of a score's reasons by tag, worst first.

    `reasons`: doc, ord, slug, ingredient, impact (null if unknown), warning.
    """
    block = F.col("warning") & (F.col("impact") == 0)
    bare = F.col("warning") & F.col("impact").isNull()
    moved = F.coalesce(F.col("impact") != 0, F.lit(False))
    kept = reasons.where((F.trim("slug") != "") & (F.coalesce(block, F.lit(False)) | bare | moved)).withColumn("slug", F.trim("slug"))
    named = F.when(F.trim("ingredient") != "", F.struct("ord", F.trim("ingredient").alias("name")))
    g = kept.groupBy("doc", "slug").agg(
        F.bool_or(F.coalesce(block, F.lit(False))).alias("blocked"),
        F.bool_or(bare).alias("bare"),
        F.coalesce(F.sum(F.when(moved, F.col("impact"))), F.lit(0.0)).alias("total"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"])).alias("names"),
        F.min("ord").alias("ord"),
    )
    percent = F.when(F.col("blocked") | F.col("bare") | (F.col("total") <= 0), 0).otherwise(F.floor(F.least(F.lit(1.0), F.col("total") / FULL_IMPACT) * 100 + 0.5).cast("int"))
    effect = F.when(F.col("blocked"), "BLOQUEOU").when((F.col("total") < 0) | F.col("bare"), "TIROU").when(F.col("total") > 0, F.when(F.col("percent") < MATCH_FROM, "COMBINOU_POUCO").otherwise("COMBINOU"))
    out = g.withColumn("percent", percent).withColumn("effect", effect).where("effect is not null")
    rank = F.array_position(F.array(*map(F.lit, ("BLOQUEOU", "TIROU", "COMBINOU_POUCO", "COMBINOU"))), F.col("effect"))
    order = Window.partitionBy("doc").orderBy(rank, F.when(F.col("effect") == "COMBINOU", -F.col("percent")).otherwise(F.col("percent")), "ord", "slug")
    return out.select("doc", "slug", "effect", "percent", F.array_join("names", "|").alias("names"), F.row_number().over(order).alias("pos"))


def effects(spark, sf_dir, most: int = MOST_PARTS) -> DataFrame:
    """Effects of what is in an order, for its customer: a person is an order, an ingredient a line. Dealt by person: up to `most` parts are sent to all tasks, beyond it the rows are dealt again after the join."""
    li = b.dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    few = p.count() <= most
    tag = F.get(F.array(*map(F.lit, TAGS)), (F.col("l_suppkey") % 7).cast("int"))
    tags = F.filter(F.array(*map(F.lit, TAGS)), lambda t: (F.length(t) + F.col("l_orderkey")) % 3 != 0)
    category = F.element_at(F.array(*map(F.lit, ("WARNING", "BENEFIT", "CONTRAINDICATION", "NEUTRAL"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    out = li.join(F.broadcast(p) if few else p.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("person"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("p_name").alias("name"), tag.alias("slug"), category.alias("category"),
        F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("e"), (F.col("l_partkey") % 3).cast("string"))).alias("effect"), tags.alias("tags"),
    )
    out = out if few else out.repartition(b.tasks(spark, sf_dir, "lineitem"), "person")
    return out.withColumn("wanted", F.coalesce(F.array_contains("tags", F.col("slug")), F.lit(False)))


_TAGS = "['" + "', '".join(TAGS) + "']"
_EFFECTS = f"""WITH li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
e0 AS (SELECT l_orderkey AS person, l_linenumber * 1000000 + l_partkey AS ord, p_name AS name, ({_TAGS})[l_suppkey % 7 + 1] AS slug, (['WARNING', 'BENEFIT', 'CONTRAINDICATION', 'NEUTRAL'])[l_partkey % 4 + 1] AS category,
  CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'e' || (l_partkey % 3) END AS effect FROM li JOIN part ON l_partkey = p_partkey),
effects AS (SELECT *, coalesce((length(slug) + person) % 3 <> 0, false) AS wanted FROM e0),
own AS (SELECT *, CASE WHEN wanted THEN CASE category WHEN 'CONTRAINDICATION' THEN 'GRAVE' WHEN 'WARNING' THEN 'ALERTA' WHEN 'BENEFIT' THEN 'BENEFICIO' END END AS kind FROM effects),
fd AS (SELECT person, kind, slug, effect, name, min(ord) AS ord FROM own WHERE kind IS NOT NULL GROUP BY ALL),
points AS (SELECT person, kind, slug, effect, string_agg(name, '|' ORDER BY ord) AS names FROM fd GROUP BY ALL
  UNION ALL SELECT p.person, 'AUSENCIA', t, '', '' FROM (SELECT DISTINCT person FROM effects) p, (VALUES ('sem-silicone'), ('sem-sulfato'), ('gravidez')) v(t)
    WHERE (length(t) + person) % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.person = p.person AND o.slug = t AND o.kind IN ('GRAVE', 'ALERTA')))
"""


@query(_EFFECTS + "SELECT person, kind, slug, effect, names FROM points")
def agg_match(spark, sf_dir):
    return points(effects(spark, sf_dir)).select("person", "kind", "slug", "effect", F.array_join("names", "|").alias("names"))


@query(
    _EFFECTS
    + """SELECT person, mark, h.effect FROM (SELECT person, coalesce(slug, effect) AS mark, arg_min(effect, ord) AS effect FROM own WHERE kind IS NULL AND effect <> '' GROUP BY person, coalesce(slug, effect)) h
WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.person = h.person AND p.slug = h.mark)"""
)
def join_effect_tag(spark, sf_dir):
    e = effects(spark, sf_dir)
    return highlights(e, points(e))


@query(
    _EFFECTS
    + """, a AS (SELECT person, bool_or(contains('-' || replace(name, ' ', '-') || '-', '-ring-') AND person % 2 = 0) AS allergy FROM effects GROUP BY person),
k AS (SELECT person, list(DISTINCT kind) AS kinds FROM points GROUP BY person)
SELECT person, CASE WHEN allergy OR list_contains(coalesce(kinds, []), 'GRAVE') THEN 'NAO_RECOMENDADO' WHEN list_contains(coalesce(kinds, []), 'ALERTA') THEN 'ATENCAO'
  WHEN list_contains(coalesce(kinds, []), 'BENEFICIO') THEN 'COMBINA' ELSE 'SEM_ALERTAS' END AS verdict FROM a LEFT JOIN k USING (person)"""
)
def agg_verdict(spark, sf_dir):
    e = effects(spark, sf_dir)
    allergies = F.when(F.col("person") % 2 == 0, F.array(F.lit("ring"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    hit = e.groupBy("person").agg(F.bool_or(allergic(F.col("name"), allergies)).alias("allergy"))
    kinds = points(e).groupBy("person").agg(F.collect_set("kind").alias("kinds"))
    return hit.join(kinds, "person", "left").select("person", verdict(F.coalesce("kinds", F.array().cast("array<string>")), F.col("allergy")).alias("verdict"))


@query("SELECT p_partkey, contains('-' || replace(p_name, ' ', '-') || '-', '-plate-') OR contains('-' || replace(p_name, ' ', '-') || '-', '-hot-ring-') AS hit FROM part")
def join_allergy(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", allergic(F.col("p_name"), F.array(F.lit("plate"), F.lit("hot-ring"), F.lit(""))).alias("hit"))


def reasons(spark, sf_dir) -> DataFrame:
    li = b.dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    return li.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"),
        F.when(F.col("l_suppkey") % 8 == 7, " ").otherwise(F.element_at(F.array(*map(F.lit, TAGS)), (F.col("l_suppkey") % 6 + 1).cast("int"))).alias("slug"),
        F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit(" i"), (F.col("l_partkey") % 5).cast("string"))).alias("ingredient"),
        F.when(F.col("l_partkey") % 6 != 0, F.floor((F.col("l_quantity") % 19)) - 7.0).alias("impact"), (F.col("l_partkey") % 3 == 0).alias("warning"),
    )


_REASONS = f"""WITH li AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem),
r AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS ord, CASE WHEN l_suppkey % 8 = 7 THEN ' ' ELSE ({_TAGS})[l_suppkey % 6 + 1] END AS slug,
  CASE WHEN l_partkey % 4 <> 0 THEN 'i' || (l_partkey % 5) END AS ingredient, CASE WHEN l_partkey % 6 <> 0 THEN floor(l_quantity % 19) - 7.0::DOUBLE END AS impact, l_partkey % 3 = 0 AS warning FROM li),
k AS (SELECT *, coalesce(warning AND impact = 0, false) AS block, warning AND impact IS NULL AS bare, coalesce(impact <> 0, false) AS moved FROM r WHERE trim(slug) <> ''),
nm AS (SELECT doc, slug, ingredient, min(ord) AS ord FROM k WHERE (block OR bare OR moved) AND ingredient IS NOT NULL GROUP BY ALL),
nl AS (SELECT doc, slug, string_agg(ingredient, '|' ORDER BY ord) AS names FROM nm GROUP BY ALL),
g AS (SELECT doc, slug, bool_or(block) AS blocked, bool_or(bare) AS bare, coalesce(sum(impact) FILTER (moved), 0.0::DOUBLE) AS total, min(ord) AS ord FROM k WHERE block OR bare OR moved GROUP BY ALL),
p AS (SELECT *, CASE WHEN blocked OR bare OR total <= 0 THEN 0 ELSE floor(least(1.0::DOUBLE, total / 20.0::DOUBLE) * 100 + 0.5::DOUBLE)::INT END AS percent FROM g),
x AS (SELECT *, CASE WHEN blocked THEN 'BLOQUEOU' WHEN total < 0 OR bare THEN 'TIROU' WHEN total > 0 THEN CASE WHEN percent < 50 THEN 'COMBINOU_POUCO' ELSE 'COMBINOU' END END AS effect FROM p),
groups AS (SELECT doc, slug, effect, percent, coalesce(names, '') AS names, row_number() OVER (PARTITION BY doc ORDER BY list_position(['BLOQUEOU', 'TIROU', 'COMBINOU_POUCO', 'COMBINOU'], effect), CASE WHEN effect = 'COMBINOU' THEN -percent ELSE percent END, ord, slug)::INT AS pos
  FROM x LEFT JOIN nl USING (doc, slug) WHERE effect IS NOT NULL)
"""


@query(_REASONS + "SELECT * FROM groups")
def agg_reason_groups(spark, sf_dir):
    return reason_groups(reasons(spark, sf_dir))


@query(_REASONS + ", f AS (SELECT doc, sum(percent) AS parts FROM groups GROUP BY doc) SELECT doc, parts::BIGINT AS parts, (doc % 150)::BIGINT AS final, doc % 150 < parts - 1.5::DOUBLE AS limited FROM f")
def agg_score_account(spark, sf_dir):
    """Sum of the parts, and whether the final score is limited below it."""
    parts = reason_groups(reasons(spark, sf_dir)).groupBy("doc").agg(F.sum("percent").alias("parts"))
    return parts.select("doc", "parts", (F.col("doc") % 150).alias("final"), (F.col("doc") % 150 < F.col("parts") - 1.5).alias("limited"))


@query(
    _EFFECTS
    + """, c AS (SELECT DISTINCT person, slug FROM effects WHERE category = 'NEUTRAL' AND slug IS NOT NULL), cc AS (SELECT * FROM c UNION SELECT person, 'hidratacao' FROM c WHERE slug = 'muito-seca')
SELECT person, kind, slug, effect FROM points p WHERE NOT (kind IN ('ALERTA', 'BENEFICIO') AND EXISTS (SELECT 1 FROM cc WHERE cc.person = p.person AND cc.slug = p.slug))"""
)
def agg_drop_explained(spark, sf_dir):
    """Warnings and benefits go whose tag, or a tag of the same meaning, a reason explains already."""
    e = effects(spark, sf_dir)
    told = e.where("category = 'NEUTRAL' and slug is not null").select("person", "slug").distinct()
    told = told.unionByName(told.where("slug = 'muito-seca'").select("person", F.lit("hidratacao").alias("slug"))).distinct().withColumn("explained", F.lit(True))
    out = points(e).join(told, ["person", "slug"], "left")
    return out.where(~(F.col("kind").isin("ALERTA", "BENEFICIO") & F.coalesce("explained", F.lit(False)))).select("person", "kind", "slug", "effect")


@query(
    "SELECT l_orderkey, slug, arg_min(name, k) AS name FROM (SELECT l_orderkey, replace(p_name, ' ', '-') AS slug, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, (l_linenumber % 2) * 10000000000 + l_linenumber * 1000000 + l_partkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey, slug"
)
def agg_merge_allergies(spark, sf_dir):
    """Names by slug, the service's (even lines) before the device's, the first of each."""
    rows = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    k = (F.col("l_linenumber") % 2) * F.lit(10000000000) + F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    return rows.select("l_orderkey", slug(name).alias("slug"), name.alias("name"), k.alias("k")).groupBy("l_orderkey", "slug").agg(F.min_by("name", "k").alias("name"))


@query(
    _EFFECTS
    + """, s AS (SELECT DISTINCT person, slug, category = 'CONTRAINDICATION' AS warn FROM effects WHERE category IN ('CONTRAINDICATION', 'NEUTRAL') AND slug IS NOT NULL AND NOT wanted),
l AS (SELECT person, kind, slug FROM points p WHERE NOT (kind = 'AUSENCIA' AND EXISTS (SELECT 1 FROM s WHERE s.person = p.person AND s.slug = p.slug AND warn)))
SELECT person, kind, slug FROM l UNION ALL SELECT person, CASE WHEN warn THEN 'ALERTA' ELSE 'BENEFICIO' END, slug FROM s
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.person = s.person AND l.slug = s.slug AND l.kind <> 'AUSENCIA' AND (l.kind IN ('GRAVE', 'ALERTA')) = s.warn)"""
)
def agg_merge_points(spark, sf_dir):
    """Local points with the service's reasons: absences that a reason contradicts go, and what is there isn't repeated."""
    e = effects(spark, sf_dir)
    served = e.where(F.col("category").isin("CONTRAINDICATION", "NEUTRAL") & F.col("slug").isNotNull() & ~F.col("wanted")).select("person", "slug", (F.col("category") == "CONTRAINDICATION").alias("warn")).distinct()
    local = points(e).select("person", "kind", "slug")
    denied = served.where("warn").select("person", "slug", F.lit("AUSENCIA").alias("kind"))
    local = local.join(denied, ["person", "slug", "kind"], "left_anti")
    there = local.where("kind != 'AUSENCIA'").select("person", "slug", F.col("kind").isin("GRAVE", "ALERTA").alias("warn")).distinct()
    more = served.join(there, ["person", "slug", "warn"], "left_anti").select("person", F.when(F.col("warn"), "ALERTA").otherwise("BENEFICIO").alias("kind"), "slug")
    return local.select("person", "kind", "slug").unionByName(more)
