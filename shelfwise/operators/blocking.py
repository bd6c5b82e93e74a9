"""Pairs of strings that can be alike, met by equi-joins: nothing is compared with everything.

Two strings whose edit distance is at most d have in common all but 2 d of their pairs of neighbouring letters, so with all
pairs in one order, those of rare letters first, they share one of their first 2 d + 1. A string within another has its first four
letters among the other's runs of four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_of_letters(s: Column) -> Column:
    """The pairs of neighbouring letters, the second occurrence of one told from the first; a string of one letter is its own pair."""
    two = F.when(F.length(s) < 2, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2))))
    numbered = lambda all_: F.transform(all_, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(all_, 1, i + 1), lambda y: y == x)).cast("string")))
    return F.get(F.transform(F.array(two), numbered), F.lit(0))


#: Letters from rare to frequent: pairs with rare letters come first in the order that all strings share.
_RARE = "ZQJXKVBPGWYFMCULDHRSNIOATE"


def first_pairs(s: Column, low: float) -> Column:
    """The first pairs of letters of a string, as many as strings of similarity `low` to it need."""
    edits = F.floor((1 - low) * F.length(s) / low + 1e-9).cast("int")
    ordered = F.sort_array(F.transform(pairs_of_letters(s), lambda g: F.translate(g, _RARE, "".join(chr(ord("A") + i) for i in range(26)))))
    return F.slice(ordered, 1, 2 * edits + 1)


def can_be_alike(left: DataFrame, right: DataFrame, low: float) -> DataFrame:
    """(s, t): of different strings of left (s) and right (t) all pairs whose edit distance is at most (1 - low) of the longer one, and some more.

    The order of pairs is the same for all strings and known beforehand, so each string's first pairs are an expression of its own.
    """
    a = left.select("s", F.length("s").alias("n"), F.explode(first_pairs(F.col("s"), low)).alias("g"))
    b = right.select("t", F.length("t").alias("m"), F.explode(first_pairs(F.col("t"), low)).alias("g"))
    return a.join(b, "g").where(F.least("n", "m") >= low * F.greatest("n", "m") - 1e-9).select("s", "t").distinct()


def holds(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """(s, t): all pairs of which one holds the other, the held one of `least` letters or more."""
    runs = lambda c: F.when(F.length(c) >= least, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substr(c, i, F.lit(least))))).otherwise(F.array().cast("array<string>"))
    first = lambda c: F.when(F.length(c) >= least, F.left(c, F.lit(least)))
    all_of = lambda df, c: df.select(c, F.explode(runs(c)).alias("r"))
    head = lambda df, c: df.select(c, first(F.col(c)).alias("r")).where("r is not null")
    within = head(left, "s").join(all_of(right, "t"), "r").where(F.col("t").contains(F.col("s")))
    around = all_of(left, "s").join(head(right, "t"), "r").where(F.col("s").contains(F.col("t")))
    return within.select("s", "t").unionByName(around.select("s", "t")).distinct()
