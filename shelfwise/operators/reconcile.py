"""Reconciliation of two copies of sets, lists and decisions: what to add, change, remove, or tell about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from ..sources import bindings as b
from .catalog import first_of

DECIDED = ("APPROVED", "REJECTED")


def new_decisions(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Decided scans that weren't among the seen ones; accounts without any seen state yet are told nothing."""
    told = seen.select("uid").distinct()
    return now.join(seen, ["uid", "scan_id"], "left_anti").join(told, "uid", "left_semi")


def actions(local: DataFrame, remote: DataFrame, *keys: str) -> DataFrame:
    """Each key that only one side has: add what the local side has more, remove what it lacks."""
    add = local.join(remote, list(keys), "left_anti").select(*keys, F.lit("add").alias("op"))
    return add.unionByName(remote.join(local, list(keys), "left_anti").select(*keys, F.lit("remove").alias("op")))


def three_way(base: Column, local: Column, remote: Column) -> Column:
    """The local value where it was changed since the base, else the remote one."""
    return F.when(local.eqNullSafe(base), remote).otherwise(local)


def like_state(events: DataFrame) -> DataFrame:
    """The products that an account likes after all its taps, newest first.

    A like that repeats doesn't move a product: it stands where the first like since its last unlike put it.
    """
    last = events.groupBy("uid", "product_id").agg(F.max_by("liked", "ord").alias("liked"), F.max(F.when(~F.col("liked"), F.col("ord"))).alias("unliked"))
    since = events.join(last.where("liked"), ["uid", "product_id"]).where(events["liked"] & (F.col("ord") > F.coalesce("unliked", F.lit(-1))))
    at = since.groupBy("uid", "product_id").agg(F.min("ord").alias("since"))
    return at.withColumn("pos", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("since"))))


def queues(events: DataFrame) -> DataFrame:
    """What is still to be sent of each product: the last tap, whatever came before."""
    return events.groupBy("uid", "product_id").agg(F.when(F.max_by("liked", "ord"), "like").otherwise("unlike").alias("send"))


def distinct_ordered(items: Column) -> Column:
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull()))


def merge_favourites(current: Column, to_like: Column, to_unlike: Column, server: Column) -> Column:
    """Unsent likes that still stand, then the server's favourites without unsent unlikes."""
    return F.array_distinct(F.concat(F.array_intersect(current, to_like), F.array_except(server, to_unlike)))


def lists(spark, sf_dir) -> DataFrame:
    """User lists as the base, local and remote copies hold them: one row a list, null where a copy lacks it."""
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.col("p_name")
    return p.select(
        k.alias("id"),
        F.when(k % 5 != 4, name).alias("base"),
        F.when(k % 7 != 6, F.when(k % 3 == 0, F.concat(name, F.lit(" mine"))).otherwise(name)).alias("local"),
        F.when(k % 6 != 5, F.when(k % 4 == 0, F.concat(name, F.lit(" theirs"))).otherwise(name)).alias("remote"),
    )


_LISTS = """lists AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 4 THEN p_name END AS base,
  CASE WHEN p_partkey % 7 <> 6 THEN CASE WHEN p_partkey % 3 = 0 THEN p_name || ' mine' ELSE p_name END END AS local,
  CASE WHEN p_partkey % 6 <> 5 THEN CASE WHEN p_partkey % 4 = 0 THEN p_name || ' theirs' ELSE p_name END END AS remote FROM part)"""


@query(
    b.ctes("decision")
    + """, st AS (SELECT DISTINCT uid, scan_id FROM decision WHERE seen AND status <> 'PENDING'), nw AS (SELECT DISTINCT uid, scan_id FROM decision WHERE NOT seen AND status <> 'PENDING')
SELECT * FROM nw WHERE NOT EXISTS (FROM st WHERE st.uid = nw.uid AND st.scan_id = nw.scan_id) AND uid IN (SELECT uid FROM st)"""
)
def anti_new_decisions(spark, sf_dir):
    d = b.decision(spark, sf_dir).where(F.col("status").isin(*DECIDED))
    return new_decisions(d.where("not seen").select("uid", "scan_id").distinct(), d.where("seen").select("uid", "scan_id").distinct())


@query(
    b.ctes("favourite")
    + """, l AS (SELECT DISTINCT uid, product_id FROM favourite WHERE side = 'local'), r AS (SELECT DISTINCT uid, product_id FROM favourite WHERE side = 'remote')
SELECT *, 'add' AS op FROM (FROM l EXCEPT FROM r) UNION ALL SELECT *, 'remove' FROM (FROM r EXCEPT FROM l)"""
)
def set_item_diff(spark, sf_dir):
    f = b.favourite(spark, sf_dir)
    side = lambda s: f.where(F.col("side") == s).select("uid", "product_id").distinct()
    return actions(side("local"), side("remote"), "uid", "product_id")


@query(
    "WITH "
    + _LISTS
    + """ SELECT id, CASE WHEN local IS NOT NULL AND remote IS NULL THEN 'add' ELSE 'delete' END AS op FROM lists
WHERE (local IS NOT NULL AND remote IS NULL) OR (base IS NOT NULL AND local IS NULL AND remote IS NOT NULL)"""
)
def set_three_way_ids(spark, sf_dir):
    """Chosen ids that the server lacks are added; recorded ids that were given up and the server has are deleted."""
    ids = lists(spark, sf_dir).select("id", F.col("local").isNotNull().alias("chosen"), F.col("base").isNotNull().alias("recorded"), F.col("remote").isNotNull().alias("server"))
    op = F.when(F.col("chosen") & ~F.col("server"), "add").when(F.col("recorded") & ~F.col("chosen") & F.col("server"), "delete")
    return ids.select("id", op.alias("op")).where("op is not null")


@query("WITH " + _LISTS + " SELECT id, CASE WHEN local IS NOT DISTINCT FROM base THEN remote ELSE local END AS name FROM lists WHERE NOT (base IS NOT NULL AND remote IS NULL) AND NOT (local IS NULL AND base IS NOT NULL) AND (local IS NOT NULL OR remote IS NOT NULL)")
def merge_lists_3way(spark, sf_dir):
    """Lists that neither side gave up, each field from the side that changed it."""
    x = lists(spark, sf_dir)
    gone = F.col("base").isNotNull() & (F.col("remote").isNull() | F.col("local").isNull())
    return x.where(~gone & (F.col("local").isNotNull() | F.col("remote").isNotNull())).select("id", three_way(F.col("base"), F.col("local"), F.col("remote")).alias("name"))


@query("WITH " + _LISTS + " SELECT id, CASE WHEN local IS DISTINCT FROM base THEN local END AS name, local IS DISTINCT FROM base AS changed FROM lists WHERE local IS NOT NULL")
def prj_patch_fields(spark, sf_dir):
    """The fields to send: those that differ from the base."""
    x = lists(spark, sf_dir).where("local is not null")
    changed = ~F.col("local").eqNullSafe(F.col("base"))
    return x.select("id", F.when(changed, F.col("local")).alias("name"), changed.alias("changed"))


@query(
    b.ctes("likes")
    + """, l AS (SELECT uid, product_id, arg_max(liked, ord) AS liked, max(ord) FILTER (NOT liked) AS un FROM likes GROUP BY uid, product_id),
s AS (SELECT k.uid, k.product_id, min(k.ord) AS since FROM likes k JOIN l ON k.uid = l.uid AND k.product_id = l.product_id WHERE l.liked AND k.liked AND k.ord > coalesce(un, -1) GROUP BY ALL)
SELECT uid, product_id, since, row_number() OVER (PARTITION BY uid ORDER BY since DESC)::INT AS pos FROM s"""
)
def set_like_unlike(spark, sf_dir):
    return like_state(b.like(spark, sf_dir))


@query(
    b.ctes("favourite")
    + """, o AS (SELECT uid, side, product_id, min(id) AS id FROM favourite GROUP BY ALL),
server AS (SELECT * FROM o WHERE side = 'remote' AND product_id % 9 <> 1), mine AS (SELECT * FROM o WHERE side = 'local' AND product_id % 3 = 0),
m AS (SELECT uid, product_id, 0 AS k, id FROM mine UNION ALL SELECT uid, product_id, 1, id FROM server),
d AS (SELECT uid, product_id, k, id FROM m QUALIFY row_number() OVER (PARTITION BY uid, product_id ORDER BY k) = 1)
SELECT uid, string_agg(product_id::VARCHAR, ',' ORDER BY k, id) AS merged FROM d GROUP BY uid"""
)
def set_merge_favourites(spark, sf_dir):
    """Per account: liked here (of which every third is unsent), on the server, and unsent unlikes (rest 1 of 9)."""
    f = b.favourite(spark, sf_dir).groupBy("uid", "side", "product_id").agg(F.min("id").alias("id"))
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("id", "product_id")))), lambda x: x["product_id"])
    per = f.groupBy("uid").agg(ordered("local").alias("mine"), ordered("remote").alias("server"))
    out = merge_favourites(F.col("mine"), F.filter("mine", lambda x: x % 3 == 0), F.filter("server", lambda x: x % 9 == 1), F.col("server"))
    return per.select("uid", F.array_join(out.cast("array<string>"), ",").alias("merged")).where("merged != ''")


@query(
    b.ctes("favourite")
    + """, o AS (SELECT uid, product_id, min((side = 'remote')::INT) AS k, min(id) FILTER (side = 'local') AS l, min(id) AS any_id FROM favourite GROUP BY uid, product_id)
SELECT uid, string_agg(product_id::VARCHAR, ',' ORDER BY k, coalesce(l, any_id)) AS items FROM o GROUP BY uid"""
)
def set_append_missing(spark, sf_dir):
    """The local list, then what only the server has."""
    f = b.favourite(spark, sf_dir).groupBy("uid", "side", "product_id").agg(F.min("id").alias("id"))
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("id", "product_id")))), lambda x: x["product_id"])
    per = f.groupBy("uid").agg(ordered("local").alias("mine"), ordered("remote").alias("server"))
    return per.select("uid", F.array_join(F.concat("mine", F.array_except("server", "mine")).cast("array<string>"), ",").alias("items"))


@query("WITH " + _LISTS + " SELECT id, CASE WHEN id % 4 <> 1 AND id % 3 <> 2 AND remote IS NOT NULL AND local IS DISTINCT FROM remote THEN remote ELSE local END AS name, id % 4 <> 1 AND id % 3 <> 2 AND remote IS NOT NULL AND local IS DISTINCT FROM remote AS replaced FROM lists")
def set_cas_replace(spark, sf_dir):
    """Replaces a list by the server's only if its version is as read, nothing is pending, and it differs."""
    x = lists(spark, sf_dir)
    swap = (F.col("id") % 4 != 1) & (F.col("id") % 3 != 2) & F.col("remote").isNotNull() & ~F.col("local").eqNullSafe(F.col("remote"))
    return x.select("id", F.when(swap, F.col("remote")).otherwise(F.col("local")).alias("name"), swap.alias("replaced"))


@query("WITH k AS (SELECT p_partkey AS id, lower(trim(p_name)) AS key FROM part) SELECT id, count(*) OVER (PARTITION BY key) > 1 AS in_use FROM k")
def set_name_in_use(spark, sf_dir):
    k = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim("p_name")).alias("key"))
    used = k.groupBy("key").agg((F.count("*") > 1).alias("in_use"))
    return k.join(used, "key").select("id", "in_use")


@query("SELECT source, lang, min(doc_id) AS first FROM documents WHERE trim(lang) <> '' GROUP BY source, lang")
def set_distinct_allergies(spark, sf_dir):
    """Distinct non-blank values of a list in order of first mention."""
    d = b.table(spark, sf_dir, "documents").where(F.trim("lang") != "")
    return d.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))


@query("SELECT l_suppkey AS effect_id, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY l_suppkey")
def set_effect_dedup(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").where("l_suppkey % 7 != 0").select(F.col("l_suppkey").alias("effect_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return li.groupBy("effect_id").agg(F.min("ord").alias("ord"))


@query(b.ctes("favourite") + ", d AS (SELECT uid, product_id, max(id) AS id FROM favourite WHERE side = 'remote' GROUP BY uid, product_id) SELECT uid, product_id, row_number() OVER (PARTITION BY uid ORDER BY id DESC)::INT AS pos FROM d")
def sort_favourites(spark, sf_dir):
    last = b.favourite(spark, sf_dir).where("side = 'remote'").groupBy("uid", "product_id").agg(F.max(F.coalesce("id", F.lit(0))).alias("id"))
    return last.select("uid", "product_id", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("id"))).alias("pos"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber DESC, l_partkey) AS items FROM lineitem GROUP BY l_orderkey")
def sort_list_items(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct((-F.coalesce("l_linenumber", F.lit(0))).alias("p"), "l_partkey")))
    return b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_partkey"].cast("string")), ",").alias("items"))
