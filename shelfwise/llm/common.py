"""Pieces that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D.
WHITE = "[ \\t-\\r]+"
#: Whatever is neither an ASCII letter or digit nor outside ASCII parts the words of shingles.
NOT_WORD = "[\\x00-/:-`{-\\x7F]+"
SHINGLE = 5
SIMILAR = 0.8
#: Broadcasts are only hinted at below this many counted rows; beyond it Spark joins by shuffling.
BROADCAST_ROWS = 200_000

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, one process (a local master) takes a folder of its own; a cluster is refused."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _local_dir:
        _local_dir[app] = tempfile.mkdtemp(prefix="shelfwise-")
    return _local_dir[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are within the limit, else as it is. For rows of a few numbers."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a document row by 16 bytes of two hashes; rows that repeat both doc_id and text are one document."""
    id_, body = F.coalesce(doc_id.cast("string"), F.lit("\x00")), F.coalesce(text, F.lit(""))
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.unhex(F.concat(part(F.xxhash64(id_, body)), part(F.xxhash64(F.lit(1), body, id_))))


def rows_of(docs: DataFrame) -> DataFrame:
    """(row, rk): each row's columns as one struct, so that no name of theirs can clash with ours, and the row's key."""
    return docs.select(F.struct("*").alias("row"), row_key(docs["doc_id"], docs["text"]).alias("rk"))


def given_rows(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `docs` from the structs of `rows`; a new `text` also sets n_chars where there is such a column."""
    new = {}
    if text is not None:
        new["text"] = text
        if "n_chars" in docs.columns:
            new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def shingle_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(w: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word windows of an array of words, in order; empty for shorter arrays."""
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of n-word shingles. A text of 1 to n-1 words is one shingle, one without words has none."""
    return let(
        shingle_words(text),
        lambda w: F.array_distinct(
            F.when((F.size(w) > 0) & (F.size(w) < n), F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(windows(w, n))
        ),
    )


def shingle_rows(docs: DataFrame, *names: str) -> DataFrame:
    """(*names, h): a row for each shingle of `text`, repeats included, hashed as by `shingles`; rows instead of arrays stay in generated code."""
    cut = docs.select(*names, F.split(F.lower(F.coalesce("text", F.lit(""))), NOT_WORD).alias("w"))
    # only the first and the last can be empty
    ends = (F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0), F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0))
    cut = cut.select(*names, F.slice("w", ends[0] + 1, F.size("w") - ends[0] - ends[1]).alias("w")).where(F.size("w") > 0)
    at = cut.select(*names, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - SHINGLE))).alias("i"))
    whole = F.xxhash64(F.concat_ws(" ", "w"))
    return at.select(*names, F.when(F.size("w") < SHINGLE, whole).otherwise(F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(SHINGLE)])).alias("h"))
