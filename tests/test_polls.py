"""Keyed polls over a stream that is stopped and started again."""

from __future__ import annotations

import os
import random
import time

import pytest

from shelfwise.streaming import decisions, polls

SCHEMA = "uid int, scan_id int, status string, ord int"


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in polls.STORE}
    for k, v in polls.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, folder, batches):
    """The news of each batch, and what the store did: the query is started anew for every batch."""
    out, did = [], []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).json(f"{folder}/in")
        writer = polls.news(stream, None).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out")
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert query.exception() is None
        out.append(sorted((r.uid, r.scan_id) for r in spark.read.schema(polls.NEWS).parquet(f"{folder}/out").where("kind = 'NEWS'").collect()))
        did.append(sum(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]))
    return [_minus(b, a) for a, b in zip([[]] + out, out)], did


def _minus(b, a):
    b = list(b)
    for x in a:
        b.remove(x)
    return b


def test_polls_with_restarts(spark, store, tmp_path):
    batches = [[(1, 1, "APPROVED", 1), (1, 2, "PENDING", 2)], [(1, 2, "REJECTED", 3), (2, 9, "APPROVED", 4)], [(1, 1, "PENDING", 5), (2, 9, "PENDING", 1)], [(1, 1, "APPROVED", 6), (2, 10, "REJECTED", 7), (None, 1, None, None)]]
    got, _ = run(spark, str(tmp_path), batches)
    assert got == [[], [(1, 2)], [], [(1, 1), (2, 10)]]


def test_same_news_as_polls_over_all_rows_and_work_of_the_batch_only(spark, store, tmp_path):
    rng, ord_, batches = random.Random(4), 0, []
    for size in (300, 6, 8, 5):
        rows = []
        for _ in range(size):
            ord_ += 1
            rows.append((rng.randint(1, 6), rng.randint(1, 60), rng.choice(["PENDING", "APPROVED", "REJECTED"]), ord_))
        batches.append(rows)
    got, did = run(spark, str(tmp_path), batches)
    seen, rows, want = decisions.state_of(decisions.latest(spark.createDataFrame([], SCHEMA))), [], []
    for batch in batches:
        rows += batch
        fresh, seen = decisions.poll(decisions.latest(spark.createDataFrame(rows, SCHEMA)), seen)
        want.append(sorted((r.uid, r.scan_id) for r in fresh.collect()))
        seen = spark.createDataFrame(seen.collect(), seen.schema)
    assert got == want and sum(map(len, want)) >= 3
    assert all(d <= 6 * len(b) for d, b in zip(did[1:], batches[1:])) and did[0] > 100


def test_undecided_scans_ask_for_another_poll(spark, store, tmp_path):
    spark.createDataFrame([(1, 1, "PENDING", 1), (2, 1, "APPROVED", 2)], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")
    writer = polls.news(stream, 1).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out")
    query, until, asked = writer.trigger(processingTime="1 second").start(), time.time() + 40, set()
    try:
        while time.time() < until and not asked:
            time.sleep(1)
            if os.path.isdir(f"{tmp_path}/out/_spark_metadata"):
                asked = {r.uid for r in spark.read.schema(polls.NEWS).parquet(f"{tmp_path}/out").where("kind = 'POLL'").collect()}
    finally:
        query.stop()
    assert asked == {1}
