"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are partitioned by size. An item of fewer than SURE five-word shingles is kept whole; a larger one as its MinHash
sketch, its MINIMA least shingle hashes. Documents of any length are read once, shingle by shingle, against the
sketches, so that a short item is met inside a long document as surely as inside a short one. A document that holds
enough of an item's sketch is a candidate, and every candidate is verified by the exact share of the item's shingles
that the whole document holds.

Chance to miss an item whose share held is just 0.8: none below SURE shingles, for it needs 0.8 of them anyway; beyond, SEEN of
MINIMA = 16 minima are asked for where 12.8 are expected, which fails with less than 0.0001.

Defined cases: null texts count as empty and match nothing; an item or a document of one to four words is one shingle;
items without words match nothing; rows that repeat doc_id and text give one result; items that repeat item_id and text
count once; empty tables give an empty result; extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILAR, given_rows, materialize, row_key, rows_of, shingle_rows, shingles, small

#: Items of fewer shingles are looked up by all of them, others by their MINIMA least; of these a candidate holds SEEN or more.
SURE, MINIMA, SEEN = 16, 16, 6


def probes(items: DataFrame, least: float) -> DataFrame:
    """(h, item_id, need): the shingles by which items are met, and how many of them a candidate must hold."""
    short = F.size("shs") < SURE
    kept = F.when(short, F.col("shs")).otherwise(F.slice(F.sort_array("shs"), 1, MINIMA))
    return items.select("item_id", F.explode(kept).alias("h"), F.when(short, F.ceil(least * F.size("shs") - 1e-9)).otherwise(F.lit(SEEN)).alias("need"))


def found(docs: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(rk, doc_id, item_id, n_shared, n_item) of the pairs whose containment is `least` or more."""
    items = items.select(items["item_id"].alias("item_id"), shingles(items["text"]).alias("shs")).where(F.size("shs") > 0).dropDuplicates()
    items = materialize(items, "items")
    wanted = probes(items, least)
    text = docs.select(row_key(docs["doc_id"], docs["text"]).alias("rk"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    hits = shingle_rows(text, "rk").join(small(wanted), "h").groupBy("rk", "item_id", "need").agg(F.count_distinct("h").alias("n"))
    near = materialize(hits.where("n >= need").select("rk", "item_id"), "near")
    held = text.join(small(near.select("rk").distinct()), "rk").dropDuplicates(["rk"]).select("rk", "doc_id", F.explode(shingles(F.col("text"))).alias("h"))
    flat = items.select("item_id", F.size("shs").alias("n_item"), F.explode("shs").alias("h"))
    exact = held.join(small(flat), "h").join(near, ["rk", "item_id"]).groupBy("rk", "doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return exact.where(F.col("n_shared") >= least * F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents that hold no item, with their columns."""
    hit = small(materialize(found(docs, items, least).select("rk").distinct(), "leaks"))
    return given_rows(rows_of(docs).join(hit, "rk", "left_anti"), docs)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return found(docs, items).select("doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item"))


OP8_SQL = """
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, ws[k] || ' ' || ws[k+1] || ' ' || ws[k+2] || ' ' || ws[k+3] || ' ' || ws[k+4] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM d WHERE len(ws) >= 5)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4
), sh AS (
  SELECT DISTINCT item_id, ws[k] || ' ' || ws[k+1] || ' ' || ws[k+2] || ' ' || ws[k+3] || ' ' || ws[k+4] AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM i WHERE len(ws) >= 5)
  UNION SELECT item_id, array_to_string(ws, ' ') FROM i WHERE len(ws) BETWEEN 1 AND 4
), n AS (
  SELECT item_id, count(*) AS n_item FROM sh GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN sh USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(n_item)
"""
