"""Costly work on small rows: shared parts of expressions are computed once a row, and rows are dealt over tasks by their number."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import products
from shelfwise.sources import bindings as b


def times_normalised(spark, value) -> int:
    """How often a plan takes off accents."""
    plan = spark.createDataFrame([("a b",)], "x string").select(value.alias("v"))._jdf.queryExecution().analyzed().toString()
    return plan.count("translate(")


def test_fields_are_normalised_once(spark):
    assert times_normalised(spark, text.identity_tokens(F.col("x"))) == 1
    assert times_normalised(spark, text.ngrams(F.col("x"))) == 1
    assert times_normalised(spark, text.ocr_variants(text.norm_field(F.col("x")))) == 1


def test_names_are_normalised_once_for_evidence(spark):
    said = products.evidence(F.array(F.col("x")), text.norm_field(F.col("x")), lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    assert times_normalised(spark, said) <= 3


def test_rows_are_dealt_by_number(spark, tmp_path):
    pq.write_table(pa.table({"k": list(range(2500))}), f"{tmp_path}/t.parquet")
    dealt = b.spread(spark, str(tmp_path), "t", 1000)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.agg(F.sum("k")).first()[0] == 2499 * 1250


def test_rows_are_dealt_by_key(spark, tmp_path):
    pq.write_table(pa.table({"k": [x % 500 for x in range(2500)], "v": list(range(2500))}), f"{tmp_path}/t.parquet")
    dealt = b.dealt(spark, str(tmp_path), "t", "k", "k", "v", rows=1000)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.distinct().rdd.getNumPartitions() == 3
    homes = dealt.select("k", F.spark_partition_id().alias("p")).groupBy("k").agg(F.countDistinct("p").alias("n"))
    assert homes.agg(F.max("n")).first()[0] == 1 and dealt.count() == 2500


def test_positions_need_one_shuffle(spark):
    from shelfwise.plans import library

    plan = library.QUERIES["sort_composition"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_effects_are_dealt_by_person(spark):
    from shelfwise.operators import match

    few, many = (match.effects(spark, "/root/testdata/sf0.001", most) for most in (200_000, 0))
    for e in (few, many):
        # what is grouped by person needs no further shuffle
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (e, e.groupBy("person", "slug").count())]
        assert plans[0].count("Exchange SinglePartition") == plans[1].count("Exchange SinglePartition") > 0 and plans[0].count("Exchange ") == plans[1].count("Exchange ")
    assert few.exceptAll(many).isEmpty() and few.count() == many.count()


def planned(spark, df) -> str:
    """The optimised plan as text, with all fields."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_front_products_need_one_shuffle_and_one_reading(spark):
    from shelfwise.plans import library

    df = library.QUERIES["ext_front_product"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert planned(spark, df).count("translate(") == 1


def test_stops_are_looked_for_once(spark):
    from shelfwise.operators import ingredient_list, label_words

    lines = spark.createDataFrame([(1, 0, "INGREDIENTES: AQUA, TALC"), (1, 1, "CITRAL, Rua das Flores 5")], "scan_id int, line int, text string")
    for df in (ingredient_list.section(lines), ingredient_list.with_stops(ingredient_list.seen(lines), "n")):
        assert planned(spark, df).count(label_words.TOWN) == planned(spark, df).count(label_words.CONTACTS) == 1
    assert ingredient_list.section(lines).select("raw", "stop").first()[:] == ("AQUA, TALC CITRAL,", "RUA")


def test_lines_are_folded_once(spark):
    from shelfwise.operators import company, label_reader

    lines = spark.createDataFrame([(1, 0, "Ação ‘x’ ")], "scan_id int, line int, text string")
    assert planned(spark, company.read(lines)).count("\\p{M}") == planned(spark, label_reader.read(lines)).count("\\p{M}") == 1
    assert [company.read(lines).first()["n"], label_reader.read(lines).first()["n"]] == ["ACAO 'X'", "ACAO ‘X’"]
    assert spark.createDataFrame([("a",), (None,), ("é",)], "x string").select(text.strip_accents(F.col("x"))).collect() == [("a",), (None,), ("e",)]
