"""All terms of a table that stand in a text as whole words, each with its place, in one pass over the text.

A term stands at a place where neither the character before nor the one after it is a letter or a digit. Small tables of
terms go to every task as one automaton that reads Arrow batches; tables above TERMS rows are not sent anywhere: the words
of the texts meet the first words of the terms by an equi-join, and the rest of a term is compared in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tables of terms up to so many rows are sent to the tasks.
TERMS = 50_000
HIT = "struct<kind:string,term:string,at:int,stop:int>"
_WORD = "[A-Za-z0-9]+"


def scanner(terms: list[tuple[str, str]]):
    """A column function: text to an array of hits of (kind, term), by place, longer ones first, then by kind."""
    kinds: dict[str, list[str]] = {}
    for kind, term in sorted(set(terms)):
        kinds.setdefault(term, []).append(kind)

    @F.arrow_udf(f"array<{HIT}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for term in kinds:
            words.add_word(term, term)
        words.make_automaton()
        fields = [("kind", pa.string()), ("term", pa.string()), ("at", pa.int32()), ("stop", pa.int32())]
        for texts in batches:
            ends, flat = [0], []
            for text in texts.to_pylist():
                found = []
                for last, term in words.iter(text) if text and kinds else ():
                    at, stop = last - len(term) + 1, last + 1
                    if (at == 0 or not text[at - 1].isalnum()) and (stop == len(text) or not text[stop].isalnum()):
                        found += [(at, -stop, kind, term) for kind in kinds[term]]
                flat += sorted(found)
                ends.append(len(flat))
            columns = [[x[2] for x in flat], [x[3] for x in flat], [x[0] for x in flat], [-x[1] for x in flat]]
            rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], fields=[pa.field(n, t) for n, t in fields])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return scan


def hits_by_join(texts: DataFrame, terms: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, kind, term, at, stop): the same hits by joining words with the first words of terms, which must begin with an ASCII letter or digit; `key` names a row."""
    # where the i-th word begins: what is before it, in words and in gaps
    gaps = F.split(text, _WORD, -1)
    cut = texts.select(*key, F.col(text).alias("text"), F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("word"), gaps.alias("gap"))).alias("i", "w"))
    before = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.where("w.word is not null").select(*key, "text", F.col("w.word").alias("first"), (F.sum(F.length("w.gap") + F.length("w.word")).over(before) - F.length("w.word")).cast("int").alias("at"))
    known = terms.select("kind", "term", F.regexp_extract("term", f"^{_WORD}", 0).alias("first")).distinct()
    stop = F.col("at") + F.length("term")
    edge = lambda i: ~F.substr("text", i, F.lit(1)).rlike("^[\\p{L}\\p{N}]$")
    met = placed.join(known, "first").where((F.substr("text", F.col("at") + 1, F.length("term")) == F.col("term")) & ((F.col("at") == 0) | edge(F.col("at"))) & ((stop == F.length("text")) | edge(stop + 1)))
    return met.select(*key, "kind", "term", "at", stop.cast("int").alias("stop"))


def with_hits(texts: DataFrame, terms: DataFrame | list[tuple[str, str]], key: list[str], text: str, most: int = TERMS) -> DataFrame:
    """`texts` with `hits`: the array of hits in the column `text`, in order; `key` names a row."""
    if isinstance(terms, DataFrame):
        if terms.limit(most + 1).count() > most:
            found = hits_by_join(texts, terms, key, text).groupBy(*key).agg(
                F.transform(F.sort_array(F.collect_list(F.struct("at", (-F.col("stop")).alias("end"), "kind", "term"))), lambda h: F.struct(h["kind"].alias("kind"), h["term"].alias("term"), h["at"].alias("at"), (-h["end"]).alias("stop"))).alias("hits")
            )
            return texts.join(found, key, "left").withColumn("hits", F.coalesce("hits", F.array().cast(f"array<{HIT}>")))
        terms = [(r["kind"], r["term"]) for r in terms.select("kind", "term").collect()]
    return texts.withColumn("hits", scanner(terms)(F.col(text)))


def of_kind(kind: str, hits: Column | str = "hits") -> Column:
    return F.filter(hits, lambda h: h["kind"] == kind)
