"""Distributed union-find over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b: bigint) is linked to, over any number of steps.

    Alternating large-star and small-star steps: every edge is moved to the least neighbour of its ends until nothing
    moves. Each step is an aggregation with map-side combine and an equi-join, so a hub costs no task its whole
    neighbourhood. Nulls and loops are ignored; no edges give no rows. More than `rounds` steps raise an error.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a is not null and b is not null and a != b")
        .distinct()
    )
    e = materialize(e, name)
    before = _sum(e)
    for _ in range(rounds):
        if before == (0, None):
            break
        # large star: larger neighbours of u move to the least neighbour of u (or u)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.join(least.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")).distinct()
        # small star: smaller neighbours of u, and u, move to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo")))
            .where("hi != lo")
            .distinct()
        )
        e = materialize(small, name)
        after = _sum(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return materialize(roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()), name)


def _sum(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
