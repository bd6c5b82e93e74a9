"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host (the column `source`) the distinct documents that hold a line are counted;
lines above the host's limit are removed; documents that a text rule fails, or that are left with too little, are
rejected.

Defined cases: a null text counts as empty, a null source as the host ''; an empty text fails the base rule; rows that
repeat doc_id and text are one document and each get a row with the same values; copies under other doc_ids are documents
of their own; an empty table gives an empty table; extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, given_rows, let, materialize, row_key, rows_of, windows, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A line may stand in this many documents of a host, or in this share of them, whichever is more.
LEAST_DOCS, SHARE = 20, 0.05
#: A document is depleted when fewer words, or a smaller share of its words, are left.
LEFT_WORDS, LEFT_SHARE = 10, 0.3


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeat_words(w: Column, n: int = 5) -> Column:
    """How many words of the array lie in n-word windows that occur twice or more in it."""

    def covered(hs: Column) -> Column:
        at = lambda s, i: F.get(s, i)["h"]
        doubles = let(
            F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: (F.coalesce(at(s, i - 1) == x["h"], F.lit(False))) | F.coalesce(at(s, i + 1) == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        return F.aggregate(
            doubles,
            F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    return let(windows(w, n), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case without white space at its ends."""
    return F.xxhash64(F.lower(F.trim(line, F.lit(SPACES))))


def measured(docs: DataFrame) -> DataFrame:
    """The base columns of every row, and its lines with a word as (hash, words), as a table."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(
        row_key(docs["doc_id"], docs["text"]).alias("rk"),
        docs["doc_id"].alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("host"),
        F.xxhash64(row_key(docs["doc_id"], docs["text"])).alias("document"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(
            F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
            lambda ls: F.struct(
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.transform(ls, lambda x: F.struct(line_hash(x).alias("h"), F.size(F.split(F.trim(x, F.lit(SPACES)), WHITE)).alias("n"))).alias("lines"),
            ),
        ).alias("l"),
    )
    return materialize(base.select("rk", "doc_id", "host", "document", "word_chars", "n_symbols", "w.n_words", "w.n_repeat_words", "l.n_dup_lines", "l.lines"), "quality")


def common_lines(base: DataFrame, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """(host, h): lines in more distinct documents of a host than its limit allows."""
    hosts = base.groupBy("host").agg(F.count_distinct("document").alias("docs"))
    held = (
        base.select("host", "document", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h")
        .agg(F.count_distinct("document").alias("n"))
        .where(F.col("n") > least)
    )
    return held.join(hosts, "host").where(F.col("n") > F.greatest(F.lit(float(least)), share * F.col("docs"))).select("host", "h")


def judged(docs: DataFrame, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """Base columns, base_failed, removed (hashes of removed lines or null), kept_words and kept of every row."""
    base = measured(docs)
    common = common_lines(base, least, share)
    held = base.select("rk", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    removed = held.join(common, ["host", "h"]).groupBy("rk").agg(F.collect_set("h").alias("removed"))
    left = F.aggregate("lines", F.lit(0), lambda n, x: n + F.when(F.array_contains("removed", x["h"]), 0).otherwise(x["n"]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        base.join(removed, "rk", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept_words", F.when(F.col("removed").isNull(), F.col("n_words")).otherwise(left.cast("long")))
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (F.col("removed").isNull() | ((F.col("kept_words") >= LEFT_WORDS) & (F.col("kept_words") >= LEFT_SHARE * F.col("n_words")))),
        )
    )


def filter_documents(docs: DataFrame, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """The kept documents with their columns, lines above the limits taken out of their texts."""
    verdict = judged(docs, least, share).where("kept").select("rk", "removed").dropDuplicates(["rk"])
    out, whole = rows_of(docs).join(verdict, "rk"), F.col("row")["text"]
    lines = F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains("removed", line_hash(x)))
    return given_rows(out, docs, F.when(F.col("removed").isNull(), whole).otherwise(F.array_join(lines, "\n")))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '') AS k FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d
), win AS (
  SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT r, g FROM win GROUP BY r, g HAVING count(*) >= 2
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM win JOIN twice USING (r, g), (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), ls AS (
  SELECT r, host, k, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS xs
  FROM (SELECT r, host, k, unnest(string_split(t, chr(10))) AS x FROM d)
), l AS (
  SELECT r, host, k, x, len(xs) AS n, lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM ls WHERE len(xs) > 0
), dup AS (
  SELECT r, count(*) - count(DISTINCT x) AS n FROM l GROUP BY r
), hosts AS (
  SELECT host, count(DISTINCT k) AS docs FROM d GROUP BY host
), common AS (
  SELECT host, h FROM (SELECT host, h, count(DISTINCT k) AS n FROM l GROUP BY host, h) JOIN hosts USING (host)
  WHERE n > 20 AND n > 0.05::DOUBLE * docs
), hit AS (
  SELECT r, sum(CASE WHEN c.h IS NULL THEN n ELSE 0 END) AS left_words, count(c.h) AS removed
  FROM l LEFT JOIN common c ON l.host = c.host AND l.h = c.h GROUP BY r
), b AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(left_words, 0) AS left_words, coalesce(removed, 0) AS removed
  FROM d JOIN w ON d.r = w.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r LEFT JOIN hit ON d.r = hit.r
)
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND (removed = 0 OR (left_words >= 10 AND left_words >= 0.3::DOUBLE * n_words)) AS kept
FROM b
"""
