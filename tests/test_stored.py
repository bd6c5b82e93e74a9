"""Pages read by a data source, requests written by one, tables replaced by versions."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.sources import stored, tables


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    rows = [("products", n, json.dumps({"id": n})) for n in range(43)] + [("brands", n, json.dumps({"id": n})) for n in range(7)]
    stored.store_pages(spark.createDataFrame(rows, "collection string, n long, item string"), folder, 5)
    with open(f"{folder}/brands/1.json", "w") as f:
        json.dump({"content": [], "last": False}, f)
    return folder


def test_pages_come_back_whole_and_by_ranges(spark, pages):
    df = stored.stored_pages(spark, pages, 4)
    assert df.where("collection = 'products'").count() == 43 and df.rdd.getNumPartitions() == 4
    got = [json.loads(r.item)["id"] for r in df.where("collection = 'products'").orderBy("page").collect()]
    assert sorted(got) == list(range(43))
    assert [(r.page, r.size, r.last) for r in df.where("collection = 'products' and page >= 8").distinct().collect()][0][1:] == (3, True)


def test_options_prune_files(spark, pages):
    with_broken = os.path.join(pages, "broken")
    os.makedirs(with_broken, exist_ok=True)
    with open(f"{with_broken}/0.json", "w") as f:
        f.write("no json")
    try:
        df = stored.stored_pages(spark, pages)
        assert stored.stored_pages(spark, pages, collections=("brands",), last=0).count() == 5
        assert stored.stored_pages(spark, pages, collections=("brands", "products"), first=8, last=8).count() == 3
        with pytest.raises(Exception, match="JSONDecode|Expecting value"):
            df.collect()
    finally:
        os.remove(f"{with_broken}/0.json")


def test_stop_rules(spark, pages):
    df = stored.stored_pages(spark, pages, 2)
    short = stored.read_until(df, F.col("last") | (F.col("size") < 5))
    assert {(r.collection, r["count"]) for r in short.groupBy("collection").count().collect()} == {("products", 43), ("brands", 5)}
    assert stored.read_until(df, F.col("last"), cap=3).where("collection = 'products'").count() == 15


def test_requests_are_written_once_a_job(spark, tmp_path):
    box = str(tmp_path / "box")
    actions = spark.createDataFrame([("PUT", str(k), "{}") for k in range(20)] + [("PUT", "3", "{}"), ("DELETE", "3", None)], "op string, key string, payload string").repartition(4)
    stored.send(actions, box, "a")
    stored.send(actions, box, "a")
    assert stored.sent(spark, box).count() == 21 and stored.sent(spark, box).select("id").distinct().count() == 21
    stored.send(actions.limit(0), box, "none")
    assert sorted(os.listdir(box)) == ["a", "none"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    box = str(tmp_path / "box")
    bad = spark.createDataFrame([("PUT", str(k)) for k in range(8)], "op string, key string").repartition(4).withColumn("payload", F.when(F.col("key") == "5", F.raise_error(F.lit("lost"))).otherwise(F.lit("x")))
    stored.register(spark)
    with pytest.raises(Exception, match="lost"):
        bad.select(F.lit("i").alias("id"), "op", "key", "payload").write.format("outbox").option("path", box).option("job", "b").mode("append").save()
    assert not os.path.exists(f"{box}/b") and not os.path.exists(f"{box}/_staged-b")


def test_upserts(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id bigint, name string"
    row = lambda *xs: spark.createDataFrame(list(xs), schema)
    ops = tables.upsert(row((1, "a"), (2, "b")), folder, "id", schema, "one")
    assert {r.op for r in ops.collect()} <= {"insert", "update"}
    before = tables.version(spark, folder)
    tables.upsert(row((2, "B"), (3, "c")), folder, "id", schema, "two")
    want = [(1, "a"), (2, "B"), (3, "c")]
    assert before == "one" and sorted(map(tuple, tables.table(spark, folder, schema).collect())) == want
    tables.upsert(row((2, "again")), folder, "id", schema, "two")
    assert sorted(map(tuple, tables.table(spark, folder, schema).collect())) == want
    bad = row((9, "x")).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.upsert(bad, folder, "id", schema, "three")
    assert tables.version(spark, folder) == "two" and sorted(map(tuple, tables.table(spark, folder, schema).collect())) == want


def test_lists_and_drafts(spark, tmp_path):
    folder = str(tmp_path / "l")
    rows = lambda *xs: spark.createDataFrame(list(xs), "uid bigint, product bigint, ord bigint")
    read = lambda: sorted((r.uid, r.position, r["product"]) for r in tables.table(spark, folder, "uid bigint, product bigint, position int").collect())
    tables.replace_lists(rows((1, 7, 2), (1, 8, 1), (2, 5, 1)), folder, "uid", "ord", "product")
    assert read() == [(1, 0, 8), (1, 1, 7), (2, 0, 5)]
    tables.replace_lists(rows((1, 9, 1), (3, None, 1)), folder, "uid", "ord", "product")
    assert read() == [(1, 0, 9), (2, 0, 5)]
    kept = str(tmp_path / "d")
    tables.save_drafts(spark.createDataFrame([(1, "WAITING_UPLOAD", "photo"), (2, "SENT", None)], "id bigint, state string, evidence string"), kept)
    assert [(r.id, r.whole) for r in tables.drafts(spark, kept).orderBy("id").collect()] == [(1, True), (2, True)]
