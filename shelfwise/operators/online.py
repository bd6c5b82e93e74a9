"""Exact resolution of ingredient names against answers of a catalogue service, code by code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_ingredient_key
from ..plans.registry import query
from ..sources import bindings as b
from .resolve import administrative

#: Codes that stop a whole report, and codes that say a name is unknown.
REFUSED, UNKNOWN = (401, 403), (400, 404)


def online(names: DataFrame, by_name: DataFrame, by_alias: DataFrame, by_id: DataFrame) -> DataFrame:
    """(scan_id, position, raw, status, method, resolution, confidence, error, id, inci, refused) of each name of a scan.

    The service's answers are relations: by_name (name, code, id, inci), by_alias (name, code, id), by_id (id, code, inci). A
    name without an answer is unknown. The name is asked for as it is, then as an alias, and an alias's ingredient by its
    id; administrative text is not asked for. Any refused request refuses the scan's whole report.
    """
    first = by_name.select(F.col("name"), F.col("code").alias("c1"), F.col("id").alias("id1"), F.col("inci").alias("inci1"))
    second = by_alias.select(F.col("name"), F.col("code").alias("c2"), F.col("id").alias("id2"))
    third = by_id.select(F.col("id").alias("id2"), F.col("code").alias("c3"), F.col("inci").alias("inci2"))
    asked = names.withColumn("name", F.trim("raw")).join(first, "name", "left").join(second, "name", "left").join(third, "id2", "left")
    noise = administrative(norm_ingredient_key(F.col("raw")))
    c1, c2, c3 = F.coalesce("c1", F.lit(404)), F.coalesce("c2", F.lit(404)), F.coalesce("c3", F.lit(404))
    unknown = c1.isin(*UNKNOWN)
    known, alias = ~noise & (c1 == 200), ~noise & unknown & (c2 == 200)
    error = F.when(noise | (c1 == 200), F.lit(None)).when(~unknown, c1).when(c2 == 200, F.when(c3 != 200, c3)).when(~c2.isin(*UNKNOWN), c2)
    named = alias & (c3 == 200)
    status = F.when(noise, "ADMINISTRATIVE_NOISE").when(known, "KNOWN").when(named, "ALIAS").when(error.isNotNull(), "LOOKUP_ERROR").otherwise("NOT_FOUND")
    method = F.when(known, "EXACT_INCI").when(named, "EXACT_ALIAS")
    confidence = F.when(known, 1.0).when(named, 0.99).otherwise(0.0)
    out = asked.withColumns({"status": status, "method": method, "confidence": confidence, "error": error})
    out = out.withColumn("resolution", F.when(F.col("confidence") > 0, "RESOLVED").otherwise("UNRESOLVED"))
    refused = out.groupBy("scan_id").agg(F.bool_or(F.coalesce(F.col("error").isin(*REFUSED), F.lit(False))).alias("refused"))
    return out.join(refused, "scan_id").select(
        "scan_id", "position", "raw", "status", "method", "resolution", "confidence", "error", F.when(F.col("status") == "KNOWN", F.col("id1")).when(F.col("status") == "ALIAS", F.col("id2")).alias("id"),
        F.when(F.col("status") == "KNOWN", F.col("inci1")).when(F.col("status") == "ALIAS", F.col("inci2")).alias("inci"), "refused",
    )


@query(
    """SELECT l_orderkey AS scan_id, l_linenumber AS position, CASE WHEN p_partkey % 17 = 3 THEN 'ADMINISTRATIVE_NOISE' WHEN p_partkey % 5 = 0 THEN 'KNOWN' WHEN p_partkey % 5 = 1 AND p_size > 10 THEN 'ALIAS' WHEN p_partkey % 5 IN (1, 2) THEN 'LOOKUP_ERROR' ELSE 'NOT_FOUND' END AS status,
CASE WHEN p_partkey % 17 = 3 OR p_partkey % 5 NOT IN (1, 2) THEN NULL WHEN p_partkey % 5 = 2 THEN CASE WHEN p_partkey % 7 = 0 THEN 403 ELSE 500 END WHEN p_size <= 10 THEN 502 END AS error,
bool_or(p_partkey % 17 <> 3 AND p_partkey % 5 = 2 AND p_partkey % 7 = 0) OVER (PARTITION BY l_orderkey) AS refused
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey"""
)
def resolve_ingredient_online(spark, sf_dir):
    """Lines as names of an order's scan; the service knows a fifth of the parts by name, a fifth by alias, and fails on another."""
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k")).distinct()
    raw = F.when(F.col("k") % 17 == 3, F.concat(F.lit("SAC "), F.col("k").cast("string"))).otherwise(F.concat(F.lit(" part "), F.col("k").cast("string")))
    names = lines.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("position"), raw.alias("raw"))
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"))
    five = F.col("p_partkey") % 5
    by_name = p.where(five.isin(0, 2)).select("name", F.when(five == 0, 200).when(F.col("p_partkey") % 7 == 0, 403).otherwise(500).alias("code"), F.col("p_partkey").alias("id"), F.upper("name").alias("inci"))
    by_alias = p.where(five == 1).select("name", F.lit(200).alias("code"), F.col("p_partkey").alias("id"))
    by_id = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, 200).otherwise(502).alias("code"), F.upper("name").alias("inci"))
    return online(names, by_name, by_alias, by_id).select("scan_id", "position", "status", "error", "refused")
