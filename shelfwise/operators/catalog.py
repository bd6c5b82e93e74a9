"""The searchable catalogue: assembly, filters, search, facets and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from ..sources import bindings as b


def active_products(product: DataFrame) -> DataFrame:
    """Products with an id that aren't switched off; an unknown switch counts as on."""
    return product.where(F.col("id").isNotNull() & F.coalesce("is_active", F.lit(True)))


def current_versions(version: DataFrame) -> DataFrame:
    return version.where(F.coalesce("is_current", F.lit(False)) & F.col("id").isNotNull() & F.col("product_id").isNotNull())


def active_model_scores(score: DataFrame, model: DataFrame) -> DataFrame:
    """Scores under the active model; none where no model is active."""
    active = model.where(F.coalesce("is_active", F.lit(False))).agg(F.min("id").alias("model"))
    return score.join(F.broadcast(active), "model", "left_semi")


def last_of(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row a key, that of the greatest `ord`."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), "ord").alias("v")).select(key, "v.*")


def assemble(product, brand, category, version, score, model) -> DataFrame:
    """Active products with brand, category and the current version's score; whatever is missing stays null but for the brand's name."""
    brands = last_of(brand, "id", "name", "is_brazilian").select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name"), "is_brazilian")
    categories = category.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    versions = last_of(current_versions(version), "product_id", "id").select(F.col("product_id").alias("id"), F.col("id").alias("version_id"))
    scores = last_of(active_model_scores(score, model), "version_id", "overall").withColumnRenamed("overall", "score")
    out = active_products(product).join(brands, "brand_id", "left").join(categories, "category_id", "left").join(versions, "id", "left").join(scores, "version_id", "left")
    known = F.when(F.col("category_name").isNotNull(), F.col("category_id"))
    return out.select("id", "name", F.coalesce("brand_name", F.lit("")).alias("brand_name"), "score", known.alias("category_id"), "category_name", "brand_id", "is_brazilian", "ord")


def catalog(spark, sf_dir) -> DataFrame:
    return assemble(*(f(spark, sf_dir) for f in (b.product, b.brand, b.category, b.version, b.score, b.scoring_model)))


def band(score: Column) -> Column:
    return F.when(score >= 70, "BOA").when(score >= 40, "MEDIA").when(score.isNotNull(), "RUIM")


def filtered(items: DataFrame, brands=(), categories=(), bands=(), brazilian_only=False) -> DataFrame:
    """All groups must hold, any option within one; empty groups hold always, and nulls are in no option."""
    if brands:
        items = items.where(F.col("brand_id").isin(*brands))
    if categories:
        items = items.where(F.col("category_id").isin(*categories))
    if bands:
        items = items.where(band(F.col("score")).isin(*bands))
    return items.where(F.coalesce("is_brazilian", F.lit(False))) if brazilian_only else items


def searched(items: DataFrame, term: str) -> DataFrame:
    """Items whose name or brand holds the term, in either case; a blank term finds nothing."""
    t = (term or "").strip().lower()
    if not t:
        return items.where(F.lit(False))
    return items.where(F.lower("name").contains(t) | F.lower("brand_name").contains(t))


def first_of(items: DataFrame, key: str = "id") -> DataFrame:
    """One row a key, that of the least `ord`."""
    w = Window.partitionBy(key).orderBy("ord")
    return items.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def suggestions(items: DataFrame, most: int) -> DataFrame:
    """The best-scored items, scoreless last, in catalogue order within a score; pos counts from 1."""
    top = first_of(items).orderBy(F.desc_nulls_last("score"), "ord").limit(most)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "ord")))


def category_facets(items: DataFrame, least: int = 3) -> DataFrame:
    named = items.where(F.col("category_id").isNotNull() & (F.trim("category_name") != ""))
    return named.groupBy("category_id").agg(F.count("*").alias("n"), F.max_by("category_name", "ord").alias("name")).where(F.col("n") >= least)


def brand_facets(items: DataFrame) -> DataFrame:
    named = items.where(F.col("brand_id").isNotNull() & (F.trim("brand_name") != ""))
    return named.groupBy("brand_id").agg(F.max_by("brand_name", "ord").alias("name"))


def sections(items: DataFrame, each: int | None = None) -> DataFrame:
    """Items by category: sections with a category first, larger before smaller, then by name; items by score, then name.

    section and place count from 1. Places are counted within a category by a window of that category; the number of
    sections is the number of categories.
    """
    key = F.coalesce(F.concat(F.lit("#"), F.col("category_id").cast("string")), F.concat(F.lit("n:"), F.lower("category_name")), F.lit("none"))
    kept = first_of(items).withColumn("key", key)
    sized = kept.groupBy("key").agg(F.count("*").alias("n"), F.min_by("category_name", "ord").alias("title"))
    order = Window.orderBy((F.col("key") == "none").cast("int"), F.desc("n"), F.lower("title"), "key")
    numbered = sized.withColumn("section", F.row_number().over(order))
    inner = Window.partitionBy("key").orderBy(F.desc_nulls_last("score"), F.lower("name").asc_nulls_last(), "ord")
    placed = kept.withColumn("place", F.row_number().over(inner))
    placed = placed if each is None else placed.where(F.col("place") <= each)
    return placed.join(numbered, "key").select("section", F.coalesce("title", F.lit("")).alias("title"), "n", "place", "id")


@query(b.ctes(*b.CATALOG) + "SELECT * EXCLUDE (ord) FROM catalog")
def join_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).drop("ord")


@query(b.ctes("product") + "SELECT id, name, is_active FROM product WHERE id IS NOT NULL AND coalesce(is_active, true)")
def flt_active_product(spark, sf_dir):
    return active_products(b.product(spark, sf_dir)).select("id", "name", "is_active")


@query(b.ctes("version") + "SELECT id, product_id FROM version WHERE is_current")
def flt_current_version(spark, sf_dir):
    return current_versions(b.version(spark, sf_dir)).select("id", "product_id")


@query(b.ctes("version", "score") + "SELECT version_id, overall FROM score WHERE model = 1")
def flt_active_model_score(spark, sf_dir):
    return active_model_scores(b.score(spark, sf_dir), b.scoring_model(spark, sf_dir)).select("version_id", "overall")


@query(b.ctes(*b.CATALOG) + "SELECT id, name, score FROM catalog WHERE category_id IN (1, 3, 5) AND is_brazilian AND CASE WHEN score >= 70 THEN 'BOA' WHEN score >= 40 THEN 'MEDIA' WHEN score IS NOT NULL THEN 'RUIM' END IN ('BOA', 'MEDIA')")
def flt_catalog(spark, sf_dir):
    return filtered(catalog(spark, sf_dir), categories=(1, 3, 5), bands=("BOA", "MEDIA"), brazilian_only=True).select("id", "name", "score")


@query("SELECT p_partkey AS id, (p_size > 25 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS active FROM part")
def flt_active_flag(spark, sf_dir):
    """Whether a stored filter has any option: here each product stands for one stored filter."""
    p = b.table(spark, sf_dir, "part")
    groups = [F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand")), F.when(F.col("p_partkey") % 5 == 0, F.array("p_type")), F.when(F.col("p_size") > 25, F.array(F.lit("BOA")))]
    return p.select(F.col("p_partkey").alias("id"), F.exists(F.array(*groups), lambda g: F.coalesce(F.size(g), F.lit(0)) > 0).alias("active"))


@query("SELECT user_id AS uid, string_agg(o, ',' ORDER BY o) AS options FROM (SELECT user_id, (event_id % 12)::VARCHAR AS o FROM events GROUP BY user_id, event_id % 12 HAVING count(*) % 2 = 1) GROUP BY user_id")
def flt_toggle(spark, sf_dir):
    """Options left after each event switched one on or off: those that were switched an odd number of times."""
    e = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uid"), (F.col("event_id") % 12).cast("string").alias("o")).count()
    return e.where("count % 2 = 1").groupBy("uid").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias("options"))


@query(b.ctes(*b.CATALOG) + "SELECT id, CASE WHEN score >= 70 THEN 'BOA' WHEN score >= 40 THEN 'MEDIA' WHEN score IS NOT NULL THEN 'RUIM' END AS band FROM catalog")
def prj_score_band(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", band(F.col("score")).alias("band"))


@query(b.ctes(*b.CATALOG) + "SELECT id, name, brand_name FROM catalog WHERE contains(lower(name), 'ring') OR contains(lower(brand_name), 'ring')")
def flt_text_search(spark, sf_dir):
    return searched(catalog(spark, sf_dir), "  RING ").select("id", "name", "brand_name")


@query(b.ctes(*b.CATALOG) + "SELECT id, name, brand_name FROM catalog WHERE id = 42 ORDER BY ord LIMIT 1")
def flt_cache_lookup(spark, sf_dir):
    return catalog(spark, sf_dir).where("id = 42").orderBy("ord").limit(1).select("id", "name", "brand_name")


@query(b.ctes(*b.CATALOG) + "SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, ord)::INT AS pos FROM catalog QUALIFY pos <= 50")
def sort_suggestions(spark, sf_dir):
    return suggestions(catalog(spark, sf_dir), 50).select("id", "score", "pos")


@query(b.ctes(*b.CATALOG) + "SELECT category_id, count(*) AS n, arg_max(category_name, ord) AS name FROM catalog WHERE category_id IS NOT NULL AND trim(category_name) <> '' GROUP BY category_id HAVING count(*) >= 3")
def agg_category_facets(spark, sf_dir):
    return category_facets(catalog(spark, sf_dir))


@query(b.ctes(*b.CATALOG) + "SELECT brand_id, arg_max(brand_name, ord) AS name FROM catalog WHERE trim(brand_name) <> '' GROUP BY brand_id")
def agg_brand_facets(spark, sf_dir):
    return brand_facets(catalog(spark, sf_dir))


@query(b.ctes(*b.CATALOG) + "SELECT bool_or(coalesce(is_brazilian, false)) AS any_brazilian FROM catalog")
def agg_any_brazilian(spark, sf_dir):
    return catalog(spark, sf_dir).agg(F.bool_or(F.coalesce("is_brazilian", F.lit(False))).alias("any_brazilian"))


@query(
    b.ctes(*b.CATALOG)
    + """, k AS (SELECT *, coalesce('#' || category_id, 'none') AS key FROM catalog),
s AS (SELECT key, count(*) AS n, arg_min(category_name, ord) AS title FROM k GROUP BY key),
t AS (SELECT *, row_number() OVER (ORDER BY (key = 'none')::INT, n DESC, lower(title), key)::INT AS section FROM s)
SELECT section, coalesce(title, '') AS title, n, row_number() OVER (PARTITION BY key ORDER BY score DESC NULLS LAST, lower(name) NULLS LAST, ord)::INT AS place, id FROM k JOIN t USING (key)"""
)
def agg_sections(spark, sf_dir):
    return sections(catalog(spark, sf_dir))


@query(b.ctes(*b.CATALOG) + "SELECT id, name FROM catalog WHERE brand_name IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_nationkey % 6 = 1)")
def semi_brand_products(spark, sf_dir):
    """The products of matched brands only."""
    matched = b.table(spark, sf_dir, "nation").where("n_nationkey % 6 = 1").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("brand_name"))
    return catalog(spark, sf_dir).join(matched, "brand_name", "left_semi").select("id", "name")


@query(b.ctes(*b.CATALOG) + "SELECT id, name, score FROM catalog WHERE brand_id IN (1, 2, 3, 4, 5) AND score >= 40 AND contains(lower(name), 'ate')")
def str_recompute(spark, sf_dir):
    """Filter and search over the latest catalogue: a view that is read again after each change."""
    return searched(filtered(catalog(spark, sf_dir), brands=(1, 2, 3, 4, 5), bands=("BOA", "MEDIA")), "ate").where("name like '%ate%'").select("id", "name", "score")
