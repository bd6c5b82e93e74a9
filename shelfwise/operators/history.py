"""Histories: what was opened last, day headers, bounded logs, merges of local and remote scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from ..sources import bindings as b
from .catalog import catalog, last_of

RECENT, MESSAGES = 20, 100


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n rows of the greatest `order` of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def recent(access: DataFrame, n: int = RECENT) -> DataFrame:
    """The products that each account opened last, newest first, each once; pos counts from 1."""
    last = access.groupBy("uid", "product_id").agg(F.max(F.struct("moment", "ord")).alias("m"))
    w = Window.partitionBy("uid").orderBy(F.desc("m"))
    return last.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("uid", "product_id", F.col("m.moment").alias("moment"), F.col("m.ord").alias("ord"), "pos")


def with_day_headers(rows: DataFrame, day: Column) -> DataFrame:
    """Marks the first row of each day in each account's newest-first list."""
    w = Window.partitionBy("uid").orderBy(F.desc("moment"), F.desc("ord"))
    return rows.withColumn("day", day).withColumn("header", ~F.coalesce(F.lag("day").over(w) == F.col("day"), F.lit(False)))


def merged_scans(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Both lists, each key once: the remote row where there is one."""
    both = remote.withColumn("side", F.lit(0)).unionByName(local.withColumn("side", F.lit(1)))
    w = Window.partitionBy("uid", key).orderBy("side", "ord")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def history(access: DataFrame, scans: DataFrame, items: DataFrame, n: int = RECENT) -> DataFrame:
    """Each account's newest n products that the catalogue knows; a product scanned later than opened shows as a scan."""
    opened = recent(access, 10**9).drop("pos").join(items.select(F.col("id").alias("product_id"), "name"), "product_id")
    w = Window.partitionBy("uid", "product_id").orderBy("ord")
    first = scans.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("uid", "product_id", F.col("moment").alias("scanned"))
    both = opened.join(first, ["uid", "product_id"], "left")
    later = F.coalesce(F.col("scanned") > F.col("moment"), F.lit(False))
    shown = both.select("uid", "product_id", "name", F.when(later, F.col("scanned")).otherwise(F.col("moment")).alias("shown_at"), F.when(later, "SCAN").otherwise("ACCESS").alias("kind"), "ord")
    order = Window.partitionBy("uid").orderBy(F.desc(F.to_date("shown_at")), F.desc("shown_at"), F.desc("ord"))
    return shown.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).drop("ord")


def scans(spark, sf_dir) -> DataFrame:
    """Scan sessions that name a product."""
    d = b.decision(spark, sf_dir)
    return d.select("uid", (F.col("scan_id") % 300).alias("product_id"), "moment", "ord")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def win_keep_last_n(spark, sf_dir):
    return keep_last(b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query(b.ctes("access") + "SELECT uid, product_id, max(moment) AS moment, row_number() OVER (PARTITION BY uid ORDER BY max(moment) DESC, max(ord) DESC)::INT AS pos FROM access GROUP BY uid, product_id QUALIFY pos <= 20")
def win_recent_access(spark, sf_dir):
    return recent(b.access(spark, sf_dir)).drop("ord")


@query(
    b.ctes(*b.CATALOG, "access")
    + ", r AS (SELECT uid, product_id, max(moment) AS moment, max(ord) AS ord FROM access GROUP BY uid, product_id QUALIFY row_number() OVER (PARTITION BY uid ORDER BY max(moment) DESC, max(ord) DESC) <= 20) SELECT uid, product_id, name, (moment::DATE)::VARCHAR AS day FROM r JOIN catalog ON id = product_id"
)
def win_recent_catalog_access(spark, sf_dir):
    items = catalog(spark, sf_dir).select(F.col("id").alias("product_id"), "name")
    return recent(b.access(spark, sf_dir)).join(items, "product_id").select("uid", "product_id", "name", F.to_date("moment").cast("string").alias("day"))


@query(
    b.ctes("access")
    + "SELECT uid, product_id, moment, (moment::DATE)::VARCHAR AS day, coalesce(lag(moment::DATE) OVER w <> moment::DATE, true) AS header FROM access WINDOW w AS (PARTITION BY uid ORDER BY moment DESC, ord DESC)"
)
def win_history_day_headers(spark, sf_dir):
    return with_day_headers(b.access(spark, sf_dir), F.to_date("moment").cast("string")).drop("ord")


@query(
    b.ctes(*b.CATALOG, "access", "decision")
    + """, o AS (SELECT uid, product_id, max(moment) AS moment, max(ord) AS ord FROM access GROUP BY uid, product_id),
s AS (SELECT uid, scan_id % 300 AS product_id, moment AS scanned FROM decision QUALIFY row_number() OVER (PARTITION BY uid, scan_id % 300 ORDER BY ord) = 1),
h AS (SELECT o.uid, o.product_id, name, CASE WHEN scanned > moment THEN scanned ELSE moment END AS shown_at, CASE WHEN scanned > moment THEN 'SCAN' ELSE 'ACCESS' END AS kind, o.ord
  FROM o JOIN catalog c ON c.id = o.product_id LEFT JOIN s ON s.uid = o.uid AND s.product_id = o.product_id)
SELECT uid, product_id, name, shown_at, kind, row_number() OVER (PARTITION BY uid ORDER BY shown_at::DATE DESC, shown_at DESC, ord DESC)::INT AS pos FROM h QUALIFY pos <= 20"""
)
def join_history_access(spark, sf_dir):
    return history(b.access(spark, sf_dir), scans(spark, sf_dir), catalog(spark, sf_dir))


@query(b.ctes("access") + "SELECT uid, product_id, moment FROM access ORDER BY moment::DATE DESC, moment DESC, ord DESC LIMIT 20")
def topk_history(spark, sf_dir):
    return b.access(spark, sf_dir).orderBy(F.desc(F.to_date("moment")), F.desc("moment"), F.desc("ord")).limit(RECENT).drop("ord")


@query(
    b.ctes("decision")
    + "SELECT uid, scan_id, status, CASE WHEN seen THEN 'remote' ELSE 'local' END AS side FROM decision QUALIFY row_number() OVER (PARTITION BY uid, scan_id ORDER BY (NOT seen)::INT, ord) = 1"
)
def set_union_scans(spark, sf_dir):
    d = b.decision(spark, sf_dir)
    out = merged_scans(d.where("seen"), d.where("not seen"), "scan_id")
    return out.select("uid", "scan_id", "status", F.when(F.col("side") == 0, "remote").otherwise("local").alias("side"))


@query(
    b.ctes("favourite")
    + ", m AS (SELECT uid, max(CASE WHEN side = 'remote' THEN id END) AS last FROM favourite GROUP BY uid) SELECT uid, id, last + row_number() OVER (PARTITION BY uid ORDER BY id DESC) AS position FROM favourite JOIN m USING (uid) WHERE side = 'local' AND last IS NOT NULL"
)
def win_append_position(spark, sf_dir):
    """New local entries go behind the server's greatest position, the newest first."""
    f = b.favourite(spark, sf_dir)
    last = f.groupBy("uid").agg(F.max(F.when(F.col("side") == "remote", F.col("id"))).alias("last")).where("last is not null")
    w = Window.partitionBy("uid").orderBy(F.desc("id"))
    return f.where("side = 'local'").join(last, "uid").select("uid", "id", (F.col("last") + F.row_number().over(w)).alias("position"))


@query("SELECT user_id AS uid, greatest(max(event_id) + 1, user_id * 100) AS next_id FROM events GROUP BY user_id")
def win_next_id(spark, sf_dir):
    """One more than the greatest id, and not below the stored counter."""
    e = b.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("uid")).agg((F.max("event_id") + 1).alias("n")).select("uid", F.greatest("n", F.col("uid") * 100).alias("next_id"))


@query("SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id")
def agg_room_count(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos FROM conversations")
def room_ordered_read(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("pos"))
