"""Queries that write what the service and the device keep, read it back, and give what is there."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reconcile
from ..plans.registry import query
from . import bindings as b
from . import stored, tables
from .kept import folder
from .pages import SIZE

@query(
    """SELECT 'products' AS collection, (p_partkey - 1) // 500 AS page, p_partkey AS id, p_name AS name FROM part
UNION ALL SELECT 'customers', (c_custkey - 1) // 500, c_custkey, c_name FROM customer UNION ALL SELECT 'suppliers', (s_suppkey - 1) // 500, s_suppkey, s_name FROM supplier"""
)
def src_rest_list(spark, sf_dir):
    """Three whole collections, stored as pages of 500 and read back by a task a range of pages."""
    item = lambda df, key, name, c: df.select(F.lit(c).alias("collection"), (F.col(key) - 1).alias("n"), F.to_json(F.struct(F.col(key).alias("id"), F.col(name).alias("name"))).alias("item"))
    rows = item(b.table(spark, sf_dir, "part"), "p_partkey", "p_name", "products").unionByName(item(b.table(spark, sf_dir, "customer"), "c_custkey", "c_name", "customers"))
    rows = rows.unionByName(item(b.table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "suppliers"))
    stored.store_pages(rows, path := folder(spark, "collections"), 500)
    read = stored.stored_pages(spark, path).where("item is not null").withColumn("x", F.from_json("item", "id bigint, name string"))
    return read.select("collection", F.col("page").cast("bigint").alias("page"), "x.id", "x.name")


@query("SELECT o_custkey AS key, o_orderkey AS id, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) // 5)::INT AS page FROM orders")
def src_rest_paged(spark, sf_dir):
    """All orders of each customer, the newest first, in pages of SIZE: stored as responses, a line each, and read page by page until the last one."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.col("o_orderkey").asc_nulls_last())
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.struct(F.row_number().over(w).alias("n"), F.struct(F.col("o_orderkey").alias("id")).alias("x")).alias("item"))
    pages = rows.groupBy("key", F.expr(f"(item.n - 1) div {SIZE}").cast("int").alias("page")).agg(F.transform(F.sort_array(F.collect_list("item")), lambda i: i["x"]).alias("content"))
    pages = pages.withColumn("last", F.col("page") == F.max("page").over(Window.partitionBy("key")))
    pages.write.json(path := folder(spark, "paged"))
    stored_ = spark.read.schema("key bigint, page int, content array<struct<id:bigint>>, last boolean").json(path)
    stop = F.min(F.when(F.col("last") | (F.size("content") < SIZE), F.col("page"))).over(Window.partitionBy("key"))
    return stored_.withColumn("stop", stop).where("page <= stop").select("key", F.inline("content"), "page")


@query("SELECT doc_id AS id, 'WAITING_UPLOAD' AS state, sha256(coalesce(text, '')) AS digest, true AS whole FROM documents")
def sink_draft_json(spark, sf_dir):
    """Drafts stored with the digest of their evidence, read back and checked."""
    drafts = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("WAITING_UPLOAD").alias("state"), F.col("text").alias("evidence"))
    tables.save_drafts(drafts, path := folder(spark, "drafts"))
    return tables.drafts(spark, path).select("id", "state", "digest", "whole")


@query(b.ctes("likes") + "SELECT CASE WHEN arg_max(liked, ord) THEN 'like' ELSE 'unlike' END AS op, uid || '/' || product_id AS key, sha256(CASE WHEN arg_max(liked, ord) THEN 'like' ELSE 'unlike' END || chr(31) || uid || '/' || product_id || chr(31)) AS id FROM likes GROUP BY uid, product_id")
def sink_rest_write(spark, sf_dir):
    """Requests written to the outbox by a committing writer, twice under one job, and read back."""
    actions = reconcile.queues(b.like(spark, sf_dir)).select(F.col("send").alias("op"), F.concat_ws("/", "uid", "product_id").alias("key"), F.lit(None).cast("string").alias("payload"))
    path = folder(spark, "outbox")
    for _ in range(2):
        stored.send(actions, path, "likes")
    return stored.sent(spark, path).select("op", "key", "id")


@query("WITH " + reconcile._LISTS + " SELECT id, coalesce(local, remote) AS name FROM lists WHERE local IS NOT NULL OR remote IS NOT NULL")
def sink_upsert(spark, sf_dir):
    """Names on the server after local ones were put over them: updates where there is one, inserts where not."""
    x, path = reconcile.lists(spark, sf_dir), folder(spark, "names")
    kind = dict(x.dtypes)
    schema = f"id {kind['id']}, name string"
    tables.commit(x.where("remote is not null").select("id", F.col("remote").alias("name")), path, "server")
    tables.upsert(x.where("local is not null").select("id", F.col("local").alias("name")), path, "id", schema, "local")
    return tables.table(spark, path, schema)


@query(
    b.ctes("favourite")
    + """, d AS (SELECT uid, side, product_id, min(id) AS id FROM favourite GROUP BY ALL), o AS (SELECT *, bool_or(side = 'local') OVER (PARTITION BY uid) AS mine FROM d)
SELECT uid, product_id, (row_number() OVER (PARTITION BY uid ORDER BY id, product_id) - 1)::INT AS position FROM o WHERE side = CASE WHEN mine THEN 'local' ELSE 'remote' END"""
)
def sink_replace_list(spark, sf_dir):
    """The server's lists, those of accounts with a list of their own replaced by it, as stored."""
    f = b.favourite(spark, sf_dir).groupBy("uid", "side", "product_id").agg(F.min("id").alias("id"))
    path, order = folder(spark, "lists"), F.struct("id", "product_id").alias("ord")
    for side in ("remote", "local"):
        tables.replace_lists(f.where(F.col("side") == side).select("uid", "product_id", order), path, "uid", "ord", "product_id", side)
    kind = dict(f.dtypes)
    return tables.table(spark, path, f"uid {kind['uid']}, product_id {kind['product_id']}, position int")
