"""The SQL functions: inlined, usable in any query, the same as the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import sql, text


def test_the_same_values_without_python(spark):
    sql.install(spark)
    rows = [("Creme Hidratante Ação 24h", "CREME HIDRATANTE"), ("REX0NA", "REXONA"), ("", ""), (None, "A"), ("  ,Água Termal;", "AGUA"), ("MEL & ROSA", "ROSA MEL"), ("it's", "ITS")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = spark.sql("SELECT x, y, slug(x) AS a, norm_field(x) AS b, norm_ingredient_key(x) AS c, similarity(y, y) AS d, ocr_similarity(x, y) AS e FROM {df}", df=df)
    want = df.select("x", "y", text.slug(F.col("x")), text.norm_field(F.col("x")), text.norm_ingredient_key(F.col("x")), text.similarity(F.col("y"), F.col("y")), text.ocr_similarity(F.col("x"), F.col("y")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_list(spark):
    sql.install(spark)
    got = spark.sql("SELECT position, part FROM ingredient_parts('AQUA, PARFUM;; MICA')").collect()
    assert [(r.position, r.part) for r in got] == [(1, "AQUA"), (2, "PARFUM"), (4, "MICA")]
