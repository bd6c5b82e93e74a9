"""Spelling variants: words one edit apart, grouped by wildcards, without pairs.

A word of L letters stands in L replacement groups, each keyed by (position, what is before it, what is after it), written
as the word with one letter made '*'. Two words that differ by one replaced letter share exactly one such group, so a
group's size and its two most frequent words tell each member how many near words it has there and which one is the most
frequent. The words of a group differ in one letter, so a group is never larger than the alphabet, whatever the corpus.
For inserted and deleted letters the distinct deletions of each word are joined with the vocabulary: a deletion that is a
word is near, and that word has all words that it is a deletion of (aggregated to their number and the most frequent one).
The three are summed per word. Roots follow forms by pointer doubling; each form is at least RATIO times as frequent.

Defined cases: a null text has no words, a null doc_id counts as an empty text in the hash that plants misspellings; repeated
rows count as often as they stand; words without near words have no form and are their own root; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The letters of words.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter.
PLANTED = 31


def vocabulary(docs: DataFrame, planted: int | None = PLANTED, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least `letters` letters that stand at least `count` times. Shorter runs are never cut out of the texts."""
    runs = docs.select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(docs["text"], F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))).alias("run"),
    ).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if planted:
        h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % planted == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substr(F.col("run"), at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _places(word: Column) -> Column:
    return F.sequence(F.lit(1), F.length(word))


def _without(word: Column, i: Column, put: str = "") -> Column:
    return F.concat(F.substr(word, F.lit(1), i - 1), F.lit(put), F.substr(word, i + 1))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words of (word, n) that have near words; best is (-n, word) of the most frequent, ties by code points."""
    rank = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    # one replaced letter: at most one word for each letter of the alphabet in a group
    groups = (
        words.select(rank.alias("own"), F.explode(F.transform(_places(F.col("word")), lambda i: _without(F.col("word"), i, "*"))).alias("key"))
        .groupBy("key")
        .agg(F.collect_list("own").alias("held"))
        .where(F.size("held") > 1)
        .select(F.size("held").alias("size"), "held", F.slice(F.sort_array("held"), 1, 2).alias("top"))
    )
    replaced = groups.select("size", "top", F.explode("held").alias("own")).select(
        F.col("own.w").alias("word"), (F.col("size") - 1).cast("long").alias("n_near"), F.when(F.col("own") == F.get("top", F.lit(0)), F.get("top", F.lit(1))).otherwise(F.get("top", F.lit(0))).alias("best")
    )
    # one letter less or more: deletions meet the vocabulary
    less = words.select(rank.alias("longer"), F.explode(F.array_distinct(F.transform(_places(F.col("word")), lambda i: _without(F.col("word"), i)))).alias("word"))
    # a deletion is a word or nothing, so only those that the vocabulary holds are kept
    met = materialize(less.join(words, "word").select("word", "n", "longer"), "deletions")
    more = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min("longer").alias("best"))
    fewer = met.groupBy(F.col("longer.w").alias("word")).agg(F.count("*").alias("n_near"), F.min(rank).alias("best"))
    return replaced.unionByName(more).unionByName(fewer).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form): pointers are doubled until none moves. A form has no way back, so it ends."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    found = near(words)
    form_n = -F.col("best.m")
    is_form = form_n >= ratio * F.col("n")
    out = materialize(
        words.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, form_n).alias("form_n")
        ),
        "variants",
    )
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(materialize(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet")), "vocabulary"))


#: The crc32 of a text's bytes, a byte a step, by the table of the polynomial's 256 remainders.
_STEP = "xor(tab[(xor(c, b) & 255) + 1], c >> 8)"
OP11_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1), lambda i: ('0x' || hex(encode(doc_id || ':' || run))[2 * i - 1 : 2 * i])::BIGINT), lambda c, b: {_STEP}, 4294967295::BIGINT), 4294967295) AS h
  FROM runs, tab
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), wild AS (
  SELECT word, n, a || '*' || b AS key FROM cut
), gone AS (
  SELECT DISTINCT word, n, a || b AS key FROM cut
), pairs AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM wild x JOIN wild y ON x.key = y.key AND x.word <> y.word
  UNION ALL SELECT v.word, v.n, gone.word, gone.n FROM gone JOIN v ON key = v.word
  UNION ALL SELECT gone.word, gone.n, v.word, v.n FROM gone JOIN v ON key = v.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.next = f.word
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON f.word = chain.word AND chain.next IS NULL
"""
