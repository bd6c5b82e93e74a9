"""Reviews: validity, summaries, paging and form rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from ..sources import bindings as b

PAGES, PAGE = 4, 50


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds as floor(x * 10**digits + 0.5), on the binary double."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def stars(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor(x + 0.5), F.lit(1)), F.lit(5)).cast("int"))


def in_range(rating: Column) -> Column:
    return F.coalesce(~F.isnan(rating) & rating.between(1, 5), F.lit(False))


def valid(reviews: DataFrame) -> DataFrame:
    """Reviews with an id and a rating from 1 to 5; texts trimmed, negative votes are 0."""
    kept = reviews.where(F.col("id").isNotNull() & in_range(F.col("rating")))
    return kept.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).withColumn("votes", F.greatest(F.lit(0), F.coalesce("votes", F.lit(0))))


def summary(reviews: DataFrame, *keys: str) -> DataFrame:
    """Mean to one decimal, total and the count of each star; invalid ratings don't count, and no rating gives no mean.

    Ratings are added in whole millionths, so that the mean doesn't depend on the order in which rows meet.
    """
    r = F.when(in_range(F.col("rating")), F.col("rating"))
    counts = [F.count_if(stars(r) == i).alias(f"stars_{i}") for i in range(1, 6)]
    added = reviews.groupBy(*keys).agg(F.sum(F.round(r * 1e6).cast("bigint")).alias("units"), F.count(r).alias("total"), *counts)
    tenths = F.expr("(20 * units + 1000000 * total) div (2000000 * total)")
    return added.withColumn("mean", F.when(F.col("total") > 0, tenths / 10.0)).drop("units")


def first_pages(reviews: DataFrame, key: str, pages: int = PAGES, size: int = PAGE) -> DataFrame:
    """The newest pages * size reviews of each key, and whether more were left out."""
    w = Window.partitionBy(key).orderBy(F.desc("created"), F.desc("id"))
    numbered = reviews.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= pages * size + 1)
    cut = numbered.groupBy(key).agg((F.max("pos") > pages * size).alias("truncated"))
    return numbered.where(F.col("pos") <= pages * size).join(cut, key)


def form_error(rating: Column, title: Column, comment: Column) -> Column:
    """The first rule that a review form breaks, null if none."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(comment, F.lit("")))
    return (
        F.when(~in_range(rating), "RATING").when(t == "", "TITLE_MISSING").when(F.length(t) > 100, "TITLE_LONG").when(c == "", "COMMENT_MISSING").when(F.length(c) > 500, "COMMENT_LONG")
    )


_VALID = "rating BETWEEN 1 AND 5"


@query(b.ctes("review") + f"SELECT id, product_id, rating, trim(title) AS title, greatest(0, votes) AS votes FROM review WHERE {_VALID} AND coalesce(version_id % 7 <> 2, true)")
def flt_review_valid(spark, sf_dir):
    """Reviews of any version but those of another: a review without a version fits every one."""
    r = b.review(spark, sf_dir).where(F.coalesce(F.col("version_id") % 7 != 2, F.lit(True)))
    return valid(r).select("id", "product_id", "rating", "title", "votes")


_STAR = "least(greatest(floor(rating + 0.5::DOUBLE), 1), 5)"


@query(
    b.ctes("review")
    + f"SELECT product_id, count(*) FILTER ({_VALID}) AS total, ((20 * sum(round(rating * 1000000.0::DOUBLE)::BIGINT) FILTER ({_VALID}) + 1000000 * count(*) FILTER ({_VALID})) // nullif(2000000 * count(*) FILTER ({_VALID}), 0))::DOUBLE / 10.0::DOUBLE AS mean, "
    + ", ".join(f"count(*) FILTER ({_VALID} AND {_STAR} = {i}) AS stars_{i}" for i in range(1, 6))
    + " FROM review GROUP BY product_id"
)
def agg_reviews_summary(spark, sf_dir):
    return summary(b.review(spark, sf_dir), "product_id")


@query(
    b.ctes("review")
    + "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id DESC)::INT AS pos, count(*) OVER (PARTITION BY user_id) > 200 AS truncated FROM (SELECT DISTINCT user_id, id, created FROM review) QUALIFY pos <= 200"
)
def lim_review_pages(spark, sf_dir):
    r = b.review(spark, sf_dir).select("user_id", "id", "created").distinct()
    return first_pages(r, "user_id").select("user_id", "id", "pos", "truncated")


@query(
    """SELECT conv_id, turn, CASE WHEN NOT (length(text) % 7)::DOUBLE BETWEEN 1 AND 5 THEN 'RATING' WHEN trim(role) = '' THEN 'TITLE_MISSING' WHEN length(trim(role)) > 100 THEN 'TITLE_LONG'
WHEN trim(text) = '' THEN 'COMMENT_MISSING' WHEN length(trim(text)) > 500 THEN 'COMMENT_LONG' END AS error FROM conversations"""
)
def chk_review_form(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", form_error((F.length("text") % 7).cast("double"), F.col("role"), F.col("text")).alias("error"))


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, {_STAR.replace('rating', 'l_quantity / 7.0::DOUBLE')}::INT AS stars FROM lineitem")
def fn_stars(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", stars(F.col("l_quantity") / 7.0).alias("stars"))


@query("SELECT o_orderkey, floor(o_totalprice / 7.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rounded FROM orders")
def fn_round2(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", half_up(F.col("o_totalprice") / 7.0, 2).alias("rounded"))


@query("SELECT o_orderkey, greatest(date_diff('day', o_orderdate::DATE, DATE '1999-01-01'), 0)::INT AS days FROM orders")
def fn_days_since(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.greatest(F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")), F.lit(0)).alias("days"))
