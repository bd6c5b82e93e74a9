"""The domain's relations, derived from the supplied tables. SQL holds the same relations as named subqueries.

Each relation carries `ord` where the order of a list matters: several rows of a key stand for several list entries, of
which an index keeps the last and a dedup the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories are fixed names of a small dimension, numbered in order of name.
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


#: Rows that are dealt by bucket are in one of so many, by their key.
BUCKETS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, rows: int = 10_000, key: str | None = None) -> DataFrame:
    """A table dealt over tasks of about so many rows: for costly work on rows of few bytes, of which one split holds a million.

    Dealt by `key`, whatever is grouped by it needs no further shuffle and keeps as few rows in a task, however large the table.
    """
    t, n = table(spark, sf_dir, name), tasks(spark, sf_dir, name, rows)
    return t.repartition(n, key) if key else t.repartition(n)


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str, rows: int = 250_000) -> DataFrame:
    """Columns of a table, dealt by `key` over tasks of about so many rows: what is grouped by it and more keeps few rows in a task, however large the table or its splits."""
    return table(spark, sf_dir, name).select(*columns).repartition(tasks(spark, sf_dir, name, rows), key)


def bucketed(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows with `bucket`, one of BUCKETS by their key, and dealt by it: what is grouped by bucket and more needs no further shuffle, and a group holds at most a bucket's rows."""
    known = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return known.repartition(parts, "bucket") if parts else known.repartition("bucket")


def tasks(spark: SparkSession, sf_dir: str, name: str, rows: int = 250_000) -> int:
    """How many tasks hold about so many rows of a table each."""
    return max(1, -(-table(spark, sf_dir, name).count() // rows))


def product(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rest = F.col("p_partkey") % 11
    return p.select(
        F.when(F.col("p_partkey") % 97 != 5, F.col("p_partkey")).alias("id"),
        F.regexp_extract("p_brand", "(\\d+)", 1).cast("bigint").alias("brand_id"),
        F.when(F.col("p_partkey") % 13 != 0, F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("p_type"))).alias("category_id"),
        F.col("p_name").alias("name"),
        F.when(rest == 0, False).when(rest != 1, True).alias("is_active"),
        F.col("p_size").alias("size"),
        F.col("p_partkey").alias("ord"),
    )


def brand(spark, sf_dir) -> DataFrame:
    """Every fifth brand is listed twice, first under an old name: the last entry counts."""
    names = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", "(\\d+)", 1).cast("bigint").alias("id"), F.col("p_brand").alias("name")).distinct()
    three = F.col("id") % 3
    now = names.select("id", "name", F.when(three == 1, True).when(three == 2, False).alias("is_brazilian"), (F.col("id") + 1000).alias("ord"))
    old = names.where("id % 5 = 0").select("id", F.concat(F.lit("old "), "name").alias("name"), F.lit(None).cast("boolean").alias("is_brazilian"), F.col("id").alias("ord"))
    return old.unionByName(now)


def category(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(i + 1, c.title() if c != "PROMO" else " ") for i, c in enumerate(CATEGORIES)], "id bigint, name string")


def version(spark, sf_dir) -> DataFrame:
    """One row for each order of a product; the latest order's is current, except where the order key ends in 9 (unknown)."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    dated = sold.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    last = dated.groupBy("l_partkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last"))
    return dated.join(last, "l_partkey").select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("id"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_orderkey") % 10 != 9, F.col("l_orderkey") == F.col("last")).alias("is_current"),
        F.col("o_orderkey").alias("ord"),
    )


def scoring_model(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(1, True), (2, False), (3, None)], "id bigint, is_active boolean")


def score(spark, sf_dir) -> DataFrame:
    """Scores of current versions under the active and an inactive model."""
    v = version(spark, sf_dir).where("is_current").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), "p_size"), "product_id")
    models = F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    both = v.select("id", "p_size", models.alias("model"))
    overall = F.when(F.col("p_size") % 10 == 0, F.lit(None)).when(F.col("model") == 1, F.col("p_size") * 2).otherwise(100 - F.col("p_size") * 2)
    return both.select(F.col("id").alias("version_id"), "model", overall.cast("int").alias("overall"), F.col("id").alias("ord"))


def review(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate").distinct()
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_orderkey") % 4 != 0, F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("version_id"),
        F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_suppkey") % 17 != 3, F.col("l_quantity") / 9.0).alias("rating"),
        F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("title"),
        (F.col("l_linenumber") - 3).cast("bigint").alias("votes"),
        F.col("l_shipdate").alias("created"),
    )


def access(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.col("user_id").alias("uid"), (F.col("event_id") % 300).alias("product_id"), F.col("ts").alias("moment"), F.col("event_id").alias("ord"))


def like(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    return e.select(F.col("user_id").alias("uid"), (F.col("event_id") % 40).alias("product_id"), (F.col("event_type") == "click").alias("liked"), F.col("event_id").alias("ord"))


def decision(spark, sf_dir) -> DataFrame:
    """Scan sessions with a decision (or none yet), before and after the middle of the month."""
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    status = F.when(F.col("event_id") % 3 == 0, "APPROVED").when(F.col("event_id") % 3 == 1, "REJECTED").otherwise("PENDING")
    return e.select(
        F.col("user_id").alias("uid"), (F.col("event_id") % 500).alias("scan_id"), status.alias("status"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("seen"), F.col("ts").alias("moment"), F.col("event_id").alias("ord")
    )


def favourite(spark, sf_dir) -> DataFrame:
    """The account's favourites on the device (side local) and on the server (remote), with positions."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    side = F.when(F.col("event_type") == "view", "local").otherwise("remote")
    return e.select(F.col("user_id").alias("uid"), side.alias("side"), (F.col("event_id") % 60).alias("product_id"), F.col("event_id").alias("id"))


SQL = {
    "product": """product AS (SELECT CASE WHEN p_partkey % 97 <> 5 THEN p_partkey END AS id, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS brand_id,
  CASE WHEN p_partkey % 13 <> 0 THEN list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type)::BIGINT END AS category_id, p_name AS name,
  CASE p_partkey % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_active, p_size AS size, p_partkey AS ord FROM part)""",
    "brand": """brand_names AS (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS id, p_brand AS name FROM part),
brand AS (SELECT id, 'old ' || name AS name, NULL::BOOLEAN AS is_brazilian, id AS ord FROM brand_names WHERE id % 5 = 0
  UNION ALL SELECT id, name, CASE id % 3 WHEN 1 THEN true WHEN 2 THEN false END, id + 1000 FROM brand_names)""",
    "category": "category(id, name) AS (VALUES (1::BIGINT, 'Economy'), (2, 'Large'), (3, 'Medium'), (4, ' '), (5, 'Small'), (6, 'Standard'))",
    "version": """sold AS (SELECT DISTINCT l_partkey, o_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
version AS (SELECT o_orderkey * 1000000 + l_partkey AS id, l_partkey AS product_id, o_orderkey AS ord,
  CASE WHEN o_orderkey % 10 <> 9 THEN row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 END AS is_current FROM sold)""",
    "score": """score AS (SELECT v.id AS version_id, model, v.id AS ord, CASE WHEN p_size % 10 = 0 THEN NULL WHEN model = 1 THEN p_size * 2 ELSE 100 - p_size * 2 END AS overall
  FROM version v JOIN part ON p_partkey = product_id, (VALUES (1::BIGINT), (2)) m(model) WHERE is_current)""",
    "catalog": """catalog AS (SELECT p.id, p.name, coalesce(b.name, '') AS brand_name, s.overall AS score, c.id AS category_id, c.name AS category_name, p.brand_id, b.is_brazilian, p.ord
  FROM product p
  LEFT JOIN (SELECT * FROM brand QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1) b ON b.id = p.brand_id
  LEFT JOIN category c ON c.id = p.category_id
  LEFT JOIN version v ON v.product_id = p.id AND v.is_current
  LEFT JOIN score s ON s.version_id = v.id AND s.model = 1
  WHERE p.id IS NOT NULL AND coalesce(p.is_active, true))""",
    "review": """review AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id, CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey * 1000000 + l_partkey END AS version_id, l_suppkey AS user_id,
  CASE WHEN l_suppkey % 17 <> 3 THEN l_quantity / 9.0::DOUBLE END AS rating, '  ' || l_returnflag || ' ' AS title, (l_linenumber - 3)::BIGINT AS votes, l_shipdate AS created
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem))""",
    "access": "access AS (SELECT user_id AS uid, event_id % 300 AS product_id, ts AS moment, event_id AS ord FROM events WHERE event_type = 'view')",
    "likes": "likes AS (SELECT user_id AS uid, event_id % 40 AS product_id, event_type = 'click' AS liked, event_id AS ord FROM events WHERE event_type IN ('click', 'error'))",
    "decision": """decision AS (SELECT user_id AS uid, event_id % 500 AS scan_id, CASE event_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END AS status,
  ts < TIMESTAMP '2024-01-16' AS seen, ts AS moment, event_id AS ord FROM events WHERE event_type IN ('signup', 'purchase'))""",
    "favourite": """favourite AS (SELECT user_id AS uid, CASE WHEN event_type = 'view' THEN 'local' ELSE 'remote' END AS side, event_id % 60 AS product_id, event_id AS id
  FROM events WHERE event_type IN ('view', 'purchase'))""",
}
CATALOG = ("product", "brand", "category", "version", "score", "catalog")


def ctes(*names: str) -> str:
    """WITH and the named subqueries, ready for a further one after a comma or a SELECT."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
