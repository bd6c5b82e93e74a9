"""Reading what a service hands out page by page, from stored pages, and what devices keep as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from . import bindings as b

CAP, SIZE = 20, 5
DAY_MS = 86_400_000


def stop_page(pages: DataFrame, stop: Column, cap: int = CAP) -> DataFrame:
    """(key, stop): the first page at which a reader stops, null if none is below the cap."""
    return pages.where(F.col("page") < cap).groupBy("key").agg(F.min(F.when(stop, F.col("page"))).alias("stop"))


def read_rows(rows: DataFrame, pages: DataFrame, stop: Column, inclusive: bool = True, cap: int = CAP) -> DataFrame:
    """Rows of the pages up to the one that stops the reader (with it or not), or up to the cap."""
    at = stop_page(pages, stop, cap)
    limit = F.coalesce(F.col("stop") + (1 if inclusive else 0), F.lit(cap))
    return rows.where(F.col("page") < cap).join(at, "key").where(F.col("page") < limit).drop("stop")


def json_list(text: Column, kind: str = "array<string>") -> Column:
    """A stored JSON array; empty if it is missing or malformed."""
    return F.filter(F.coalesce(F.from_json(text, kind), F.array().cast(kind)), lambda x: x.isNotNull())


def delimited(text: Column) -> Column:
    """A list stored with U+001F between its entries; blanks go."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\u001f"), lambda x: F.trim(x) != "")


def snapshot(items: DataFrame) -> DataFrame:
    """Valid entries of a downloaded catalogue: a positive id, a filled name, the first of each id."""
    w = Window.partitionBy("id").orderBy("ord")
    return items.where((F.col("id") > 0) & (F.trim("name") != "")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def usable(version: Column, updated_ms: Column, now_ms: Column) -> tuple[Column, Column]:
    """Whether a stored snapshot can be used at all, and whether it is fresh."""
    known = version == 1
    return known, known & (now_ms - updated_ms <= DAY_MS) & (now_ms >= updated_ms)


def order_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders of each customer in pages of SIZE; page 2 of every ninth customer is missing, page 1 of every seventh is cut short."""
    o = b.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), (F.row_number().over(w) - 1).alias("n"))
    rows = rows.withColumn("page", F.floor(F.col("n") / SIZE).cast("int"))
    lost = (F.col("key") % 9 == 4) & (F.col("page") == 2)
    cut = (F.col("key") % 7 == 3) & (F.col("page") == 1) & (F.col("n") % SIZE > 1)
    rows = rows.where(~lost & ~cut)
    last = o.groupBy(F.col("o_custkey").alias("key")).agg(F.floor((F.count("*") - 1) / SIZE).cast("int").alias("last_page"))
    every = last.select("key", "last_page", F.explode(F.sequence(F.lit(0), F.col("last_page"))).alias("page"))
    sizes = rows.groupBy("key", "page").agg(F.count("*").alias("size"))
    pages = every.join(sizes, ["key", "page"], "left").select("key", "page", F.coalesce("size", F.lit(0)).alias("size"), (F.col("page") == F.col("last_page")).alias("last"))
    return rows.drop("n"), pages


_PAGES = """WITH r0 AS (SELECT o_custkey AS key, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders),
r1 AS (SELECT key, id, n, (n // 5)::INT AS page, max(n // 5) OVER (PARTITION BY key) AS last_page FROM r0),
rows_ AS (SELECT * FROM r1 WHERE NOT (key % 9 = 4 AND page = 2) AND NOT (key % 7 = 3 AND page = 1 AND n % 5 > 1)),
pages AS (SELECT p.key, p.page, count(r.id) AS size, p.page = any_value(p.last_page) AS last FROM (SELECT DISTINCT key, page, last_page FROM r1) p LEFT JOIN rows_ r ON r.key = p.key AND r.page = p.page GROUP BY p.key, p.page)
"""


@query(_PAGES + ", s AS (SELECT key, min(page) FILTER (last OR size < 5) AS stop FROM pages WHERE page < 20 GROUP BY key) SELECT r.key, id, page FROM rows_ r JOIN s ON s.key = r.key WHERE page < 20 AND page < coalesce(stop + 1, 20)")
def src_page_loop(spark, sf_dir):
    rows, pages = order_pages(spark, sf_dir)
    return read_rows(rows, pages, F.col("last") | (F.col("size") < SIZE))


@query(
    _PAGES
    + """, s AS (SELECT key, min(page) FILTER (last OR (size > 0 AND size < 5)) AS stop, min(page) FILTER (size = 0) AS lost FROM pages WHERE page < 20 GROUP BY key)
SELECT key, CASE WHEN stop IS NULL OR coalesce(lost <= stop, false) THEN NULL ELSE (SELECT count(*) FROM rows_ r WHERE r.key = s.key AND r.page <= s.stop) END AS n FROM s"""
)
def src_page_loop_lists(spark, sf_dir):
    """Rows read of each key; null where a page is missing or the cap comes before the end."""
    rows, pages = order_pages(spark, sf_dir)
    end = F.col("last") | ((F.col("size") > 0) & (F.col("size") < SIZE))
    at = pages.where(F.col("page") < CAP).groupBy("key").agg(F.min(F.when(end, F.col("page"))).alias("stop"), F.min(F.when(F.col("size") == 0, F.col("page"))).alias("lost"))
    n = rows.join(at, "key").groupBy("key").agg(F.count_if(F.col("page") <= F.col("stop")).alias("n"))
    failed = F.col("stop").isNull() | F.coalesce(F.col("lost") <= F.col("stop"), F.lit(False))
    return at.join(n, "key", "left").select("key", F.when(~failed, F.col("n")).alias("n"))


@query(_PAGES + ", s AS (SELECT key, min(page) FILTER (last OR size = 0) AS stop FROM pages WHERE page < 20 GROUP BY key) SELECT r.key, count(*) AS n FROM rows_ r JOIN s ON s.key = r.key WHERE page < 20 AND page < coalesce(stop + 1, 20) GROUP BY r.key")
def src_page_loop_favs(spark, sf_dir):
    rows, pages = order_pages(spark, sf_dir)
    return read_rows(rows, pages, F.col("last") | (F.col("size") == 0)).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 3 = 1 THEN '' ELSE event_type || ',' || user_id END AS items FROM events")
def src_prefs_json(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('["'), "event_type")).otherwise(F.to_json(F.array(F.col("event_type"), F.lit(None), F.col("user_id").cast("string"))))
    items = json_list(text)
    return b.table(spark, sf_dir, "events").select("event_id", F.size(items).alias("n"), F.array_join(items, ",").alias("items"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || ',' || p_type END AS items FROM part")
def src_delimited_list(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 4 != 0, F.concat_ws("\u001f", "p_name", F.lit(" "), "p_type", F.lit("")))
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(delimited(text), ",").alias("items"))


@query("SELECT id, arg_min(name, ord) AS name FROM (SELECT l_suppkey % 40 AS id, CASE WHEN l_partkey % 6 = 0 THEN ' ' ELSE p_name END AS name, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS ord FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE id > 0 AND trim(name) <> '' GROUP BY id")
def src_ingredient_snapshot(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = li.select((F.col("l_suppkey") % 40).alias("id"), F.when(F.col("l_partkey") % 6 == 0, " ").otherwise(F.col("p_name")).alias("name"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("ord"))
    return snapshot(items).select("id", "name")


@query("SELECT event_id, event_id % 5 <> 0 AS usable, event_id % 5 <> 0 AND ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15' AS fresh FROM events")
def src_snapshot_ttl(spark, sf_dir):
    now = F.unix_millis(F.lit("2024-01-15").cast("timestamp"))
    known, fresh = usable(F.when(F.col("event_id") % 5 == 0, 2).otherwise(1), F.unix_millis(F.col("ts").cast("timestamp")), now)
    return b.table(spark, sf_dir, "events").select("event_id", known.alias("usable"), fresh.alias("fresh"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def src_room(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))
