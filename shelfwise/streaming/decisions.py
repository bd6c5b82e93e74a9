"""Polling with durable state: which decisions are new since the last poll, what to send again, what changed meanwhile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import DECIDED
from ..plans.registry import query
from ..sources import bindings as b
from . import polls

MOST_ATTEMPTS, LEAST_AGE_MS = 6, 120_000


def latest(events: DataFrame) -> DataFrame:
    """The status that each scan has after all its events."""
    return events.groupBy("uid", "scan_id").agg(F.max_by("status", "ord").alias("status"))


def state_of(status: DataFrame) -> DataFrame:
    """(uid, scan_id): the decided scans, and a row without a scan for every account that was polled."""
    decided = status.where(F.col("status").isin(*DECIDED)).select("uid", "scan_id")
    return decided.unionByName(status.select("uid", F.lit(None).cast(decided.schema["scan_id"].dataType).alias("scan_id")).distinct())


def poll(status: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, scan_id) to tell about, and the state that replaces `seen`: a first poll of an account tells nothing."""
    state = state_of(status)
    known = seen.select("uid").distinct()
    fresh = state.where("scan_id is not null").join(seen, ["uid", "scan_id"], "left_anti").join(known, "uid", "left_semi")
    return fresh, state


def start(stream: DataFrame, folder: str, checkpoint: str):
    """Runs a poll for each micro-batch of status rows and writes what it tells to news/k; a repeated batch gives the same files. State is keyed (see polls)."""
    for key, value in polls.STORE.items():
        stream.sparkSession.conf.set(key, value)
    each = lambda batch, k: batch.select("uid", "scan_id").write.mode("overwrite").parquet(f"{folder}/news/{k}")
    return polls.news(stream, None).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_stage(uploaded: Column, checked: Column, submitted: Column) -> Column:
    """The first stage of a draft that isn't done; null if all are."""
    return F.when(~uploaded, "UPLOAD").when(~checked, "CHECK").when(~submitted, "SUBMIT")


@query(
    b.ctes("decision")
    + """, l AS (SELECT uid, scan_id, arg_max(status, ord) AS status FROM decision GROUP BY ALL), h AS (SELECT uid, scan_id, arg_max(status, ord) AS status FROM decision WHERE seen GROUP BY ALL)
SELECT uid, scan_id FROM l WHERE status <> 'PENDING' AND uid IN (SELECT uid FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.uid = l.uid AND h.scan_id = l.scan_id AND h.status <> 'PENDING')"""
)
def str_decision_poll(spark, sf_dir):
    """News of a second poll, after the middle of the month; tests run the same over a stream."""
    d = b.decision(spark, sf_dir)
    _, seen = poll(latest(d.where("seen")), state_of(latest(d.limit(0))))
    fresh, _ = poll(latest(d), seen)
    return fresh


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'UPLOAD' WHEN o_orderkey % 3 = 0 THEN 'CHECK' ELSE 'SUBMIT' END AS stage, (o_orderkey % 9)::INT AS attempts FROM orders
WHERE o_orderkey % 9 < 6 AND o_orderdate <= TIMESTAMP '1999-01-01' - INTERVAL 2 MINUTE AND NOT (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AND o_orderstatus = 'F')"""
)
def str_resend_queue(spark, sf_dir):
    """Drafts to try again: old enough, tried less than MOST_ATTEMPTS times, with a stage to do."""
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    age = F.unix_millis(F.lit("1999-01-01").cast("timestamp")) - F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    stage = next_stage(k % 2 != 0, k % 3 != 0, F.col("o_orderstatus") == "F")
    out = o.select("o_orderkey", stage.alias("stage"), (k % 9).cast("int").alias("attempts"), age.alias("age"))
    return out.where(F.col("stage").isNotNull() & (F.col("attempts") < MOST_ATTEMPTS) & (F.col("age") >= LEAST_AGE_MS)).drop("age")


@query("SELECT user_id, max(event_id) AS version, max(event_id) FILTER (event_type = 'purchase') AS sent, max(event_id) IS DISTINCT FROM max(event_id) FILTER (event_type = 'purchase') AS dirty FROM events GROUP BY user_id")
def str_version_guard(spark, sf_dir):
    """An account has something to send while its version isn't the one sent."""
    g = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("version"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("sent"))
    return g.withColumn("dirty", ~F.col("version").eqNullSafe(F.col("sent")))
