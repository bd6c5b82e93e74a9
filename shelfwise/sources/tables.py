"""Small tables of records that jobs replace as a whole: a version is written aside, then a pointer names it.

Readers see the version that the pointer names, so a job that fails in between changes nothing, and a version that was
committed under a name is not written again: a repeated job gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The committed versions' names by number; a pointer that a lost job left without a name counts for nothing."""
    store, p = _path(spark, f"{folder}/_versions")
    out = {}
    for f in store.listStatus(p) if store.exists(p) else []:
        with_name = store.open(f.getPath())
        try:
            if f.getLen():
                out[int(f.getPath().getName())] = with_name.readUTF()
        finally:
            with_name.close()
    return out


def version(spark: SparkSession, folder: str) -> str | None:
    held = versions(spark, folder)
    return held[max(held)] if held else None


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    now = version(spark, folder)
    return spark.createDataFrame([], schema) if now is None else spark.read.schema(schema).parquet(f"{folder}/{now}")


def commit(df: DataFrame, folder: str, name: str | None = None) -> str:
    """Writes `df` as the table's next version. The pointer is a file of the version's number that no other job can create again."""
    spark = df.sparkSession
    held, name = versions(spark, folder), name or uuid.uuid4().hex
    if name in held.values():
        return name
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    store, pointer = _path(spark, f"{folder}/_versions/{max(held, default=-1) + 1:012d}")
    out = store.create(pointer, False)  # fails where another job has committed this number
    try:
        out.writeUTF(name)
    finally:
        out.close()
    return name


def upsert(rows: DataFrame, folder: str, key: str, schema: str, name: str | None = None) -> DataFrame:
    """Puts `rows` (of `schema`, one a key) into the table; (key, op) says which were updates and which inserts."""
    spark = rows.sparkSession
    old = table(spark, folder, schema)
    ops = rows.join(old.select(key, F.lit(True).alias("held")), key, "left").select(key, F.when(F.col("held"), "update").otherwise("insert").alias("op"))
    kept = old.join(rows.select(key), key, "left_anti")
    commit(rows.select(*old.columns).unionByName(kept), folder, name)
    return ops


def replace_lists(rows: DataFrame, folder: str, owner: str, order: str, item: str, name: str | None = None) -> None:
    """Replaces the whole list of every owner in `rows` by its items in order, numbered from 0; other owners' lists stay. A null item only empties a list."""
    spark = rows.sparkSession
    place = (F.row_number().over(Window.partitionBy(owner).orderBy(order)) - 1).alias("position")
    new = rows.where(F.col(item).isNotNull()).select(owner, item, place)
    old = table(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema))
    commit(new.unionByName(old.join(rows.select(owner).distinct(), owner, "left_anti")), folder, name)


def save_drafts(drafts: DataFrame, folder: str, name: str | None = None) -> None:
    """Stores drafts (id, state, evidence) with the digest of their evidence."""
    commit(drafts.select("id", "state", "evidence", F.sha2(F.coalesce("evidence", F.lit("")), 256).alias("digest")), folder, name)


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """The stored drafts, `whole` where the evidence still has its digest."""
    held = table(spark, folder, "id bigint, state string, evidence string, digest string")
    return held.withColumn("whole", F.sha2(F.coalesce("evidence", F.lit("")), 256) == F.col("digest"))
