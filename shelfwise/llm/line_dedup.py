"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are normalised (lower case, no spaces at the ends) and equal ones become one. A line's character shingles are all
its windows of CHARS characters (UTF-16 units), in any script; a shorter line is one window. The shingles are dealt to
BINS bins of three parts by their hash, the least hash of each part is the line's signature and those of a bin are a band: at
a Jaccard similarity of 0.8 a band is shared with a chance of 0.51, so all ten miss with 0.0008, at 0.9 with 0.000002. Lines that share a band
are compared by exact Jaccard similarity of all their shingles, and linked lines are joined by distributed union-find; of
each component the line that comes first by (doc_id, line number) stays, everything else goes.

First every line is compared with one line only, that which leads most of its bands, and linked lines are joined. In TURNS
more turns the lines of bands of more than FEW are compared with one line of each band, chosen anew, as most copies of a
line are linked by this already. Then the bands that still hold lines of different components are taken up again: up to SMALL lines are compared pair by
pair across components, and the lines of larger bands meet by an exact prefix filter, which loses no pair.

Before texts are read, a pair must pass a bound on its similarity: each line's windows set bits in FINE longs, a bit that
only one line has stands for a window, or more, that the other lacks. The bound is exact: no similar pair fails it.

Defined cases: null texts have no lines; empty lines are always kept; lines equal after normalisation are linked without
any band, however short; rows that repeat doc_id and text are one document and keep the same lines; doc_ids of any type
are ordered as their type is and a null comes last; an empty table gives an empty one; extra columns may have any name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIMILAR, given_rows, let, materialize, row_key, rows_of, small
from .graph import connected_components

CHARS = 10
BINS, SMALL = 10, 128
#: Longs of bits of a line, and the longs of all of them laid over one another, which are looked at first.
FINE, WORDS = 64, 16
#: How often the lines of bands of more than FEW are compared with one other line before all pairs are.
TURNS, FEW = 3, 16
#: Least hashes that all parts of all bins choose from.
ENOUGH = 120
#: Lines in a block of a large group, and how often a shingle occurs to be set behind the rarer ones.
BLOCK, HOT = 256, 16
#: Rows of one or two numbers are broadcast below this many; beyond it the joins shuffle.
WANTED = 1_000_000


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\n\x0b\x0c\r")))


def _starts(units: Column) -> Column:
    """Where the windows of a line's UTF-16 bytes begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(units) - 2 * CHARS + 1), F.lit(2))


def char_shingles(norm: Column) -> Column:
    """Distinct hashes of all windows of CHARS characters of a normalised line; a shorter line is one window."""
    return let(F.encode(norm, "UTF-16BE"), lambda u: F.array_distinct(F.transform(_starts(u), lambda i: F.xxhash64(F.substr(u, i, F.lit(2 * CHARS))))))


def _different(norm: Column) -> Column:
    """About how many different windows a line has at least: its share of different words tells. Lines of long words count as uniform."""
    words = F.split(norm, " ")
    share = F.size(F.array_distinct(words)) / F.size(words)
    return F.when(F.length(norm) > 40 * F.size(words), 0.0).otherwise(F.length(norm) * share)


def bands(lines: DataFrame) -> DataFrame:
    """(key, nid): the bands of every line of `lines` (nid, norm).

    Of a line of many windows only those go on whose hash can be the least of its part: some ENOUGH / (BINS * 3) of each.
    """
    most = F.lit(2**63 - 1)
    bar = F.when(F.length("norm") > 2 * ENOUGH, let(_different(F.col("norm")), lambda n: F.when(n > 2 * ENOUGH, (F.lit(ENOUGH * 2.0**64) / n - F.lit(2.0**63)).cast("long")).otherwise(most)))
    units = lines.select("nid", F.encode("norm", "UTF-16BE").alias("u"), F.coalesce(bar, most).alias("bar"))
    each = units.select("nid", "u", "bar", F.explode(_starts(F.col("u"))).alias("i"))
    each = each.select("nid", "bar", F.xxhash64(F.substr("u", F.col("i"), F.lit(2 * CHARS))).alias("h")).where("h <= bar")
    part = F.pmod("h", F.lit(3 * BINS)).cast("int")
    # the upper half of a hash orders as the whole does, and half as much is shuffled
    least = each.select("nid", F.expr(f"cast(pmod(h, {3 * BINS}) as int) div 3").cast("int").alias("bin"), (part % 3).alias("part"), F.shiftright("h", 32).cast("int").alias("h")).groupBy("nid", "bin").agg(*[F.min(F.when(F.col("part") == k, F.col("h"))).alias(f"h{k}") for k in range(3)])
    return least.select(F.xxhash64("bin", "h0", "h1", "h2").alias("key"), "nid")


def lines_of(docs: DataFrame) -> DataFrame:
    """(rk, d, line_no, norm) of every line that is not empty."""
    base = docs.select(row_key(docs["doc_id"], docs["text"]).alias("rk"), docs["doc_id"].alias("d"), docs["text"].alias("text"))
    return base.select("rk", "d", F.posexplode(F.transform(F.split("text", "\n"), normal)).alias("line_no", "norm")).where("norm != ''")


def _keys() -> list[Column]:
    """A line's name: two hashes of its text."""
    return [F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2")]


def unique_lines(docs: DataFrame) -> DataFrame:
    """(nid, norm, m) of the different normalised lines: a number, and how often the line stands anywhere.

    Only the names of lines are shuffled: of a line that repeats, one place is chosen. (Where a row of a document repeats
    as a whole that place comes twice; two equal lines share all bands and are linked.)
    """
    places = lines_of(docs).select("norm", *_keys(), F.xxhash64("rk", "line_no").alias("place"))
    counted = places.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min("place").alias("chosen")).where("m > 1")
    several = small(materialize(counted, "line_counts"), limit=WANTED)
    each = places.join(several, ["h1", "h2"], "left").where("chosen is null or chosen = place")
    return materialize(each.select(F.monotonically_increasing_id().alias("nid"), "norm", F.coalesce("m", F.lit(1)).alias("m")), "lines")


def window_bits(lines: DataFrame) -> DataFrame:
    """(nid, n, fine, w0, w1, ..) of `lines` (nid, norm): how many different windows a line has, the bits that they set, and these laid over one another."""
    each = lines.select("nid", char_shingles(F.col("norm")).alias("hs")).select("nid", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    each = each.select("nid", "n", F.shiftright("h", 6).bitwiseAND(F.lit(FINE - 1)).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    bits = each.groupBy("nid", "n").agg(*[F.bit_or(F.when(F.col("w") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"x{k}") for k in range(FINE)])
    laid = [reduce(Column.bitwiseOR, [F.col(f"x{i}") for i in range(k, FINE, WORDS)]).alias(f"w{k}") for k in range(WORDS)]
    return bits.select("nid", "n", F.array(*[f"x{k}" for k in range(FINE)]).alias("fine"), *laid)


def _side(bits: DataFrame, name: str) -> DataFrame:
    """Columns of `bits` named for one side of a pair; nid becomes `name`."""
    return bits.withColumnsRenamed({"nid": name, "c": f"c{name}"} | {x: f"{x}_{name}" for x in ("n", "fine", "keys", *[f"w{k}" for k in range(WORDS)])})


def _possible(least: float) -> Column:
    """Whether the lines a and b can be similar by their sizes and bits: first by the few longs, then by all."""
    lone = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    few = lambda x, y: reduce(Column.__add__, [lone(F.col(f"w{k}_{x}"), F.col(f"w{k}_{y}")) for k in range(WORDS)])
    all_ = lambda x, y: F.aggregate(F.zip_with(f"fine_{x}", f"fine_{y}", lone), F.lit(0), lambda n, more: n + more)
    wanted = least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-6
    enough = [(F.col(f"n_{x}") - lacks(x, y)) >= wanted for lacks in (few, all_) for x, y in ("ab", "ba")]
    return reduce(Column.__and__, enough, F.least("n_a", "n_b") >= wanted)


def _bounded(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ..) whose lines can be similar."""
    return pairs.join(_side(bits, "a"), "a").join(_side(bits, "b"), "b").where(_possible(least)).select(*pairs.columns)


def _linked(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ..) whose lines are similar; `lines` is (nid, norm)."""
    side = lambda n: lines.select(F.col("nid").alias(n), F.col("norm").alias(f"norm_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, char_shingles(F.col("norm_a")).alias("sa"), char_shingles(F.col("norm_b")).alias("sb"))
    shared = both.select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("all"))
    return shared.where(F.col("n") >= least * (F.col("all") - F.col("n"))).select(*pairs.columns)


def _across(members: DataFrame, lines: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """(a, b, ca, cb) of different components that can be similar, from (key, nid, c): of the pairs of small groups, and of all lines of larger ones."""
    group = members.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    dealt = members.join(group.where("c0 != c1").drop("c0", "c1"), "key")
    few = dealt.where(F.col("m") <= SMALL).groupBy("nid", "c").agg(F.collect_set("key").alias("keys")).join(bits, "nid")
    few = few.select("*", F.explode("keys").alias("key"))
    # a pair that shares several bands is taken in one of them
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    every = _side(few, "a").join(_side(few, "b"), "key").where(F.expr("a < b and ca != cb") & _possible(least) & once).select("a", "b", "ca", "cb")
    large = materialize(dealt.where(F.col("m") > SMALL).select("nid", "c").distinct(), "large")
    return every if large.isEmpty() else every.unionByName(_bounded(_rest(large, lines, least).distinct(), bits, least)).distinct()


def _rest(large: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """(a, b, ca, cb) of all lines of `large` (nid, c) that can be similar, by an exact prefix filter.

    With every line's shingles in one order, rare ones first, two lines that share o shingles or more have one in common
    among the first n - o + 1 of each. What o must be is known better if partners are of known size, so lines are met
    by (shingle, class of both sizes). The first shared shingle also bounds how many can follow it. Groups are dealt in
    pairs of blocks.
    """
    # a few hundred windows a line: dealt evenly before they become rows
    sets = large.join(lines, "nid").repartition("nid").select("nid", "c", char_shingles(F.col("norm")).alias("hs"))
    held = sets.select("nid", F.size("hs").alias("n"), "c", F.explode("hs").alias("h"))
    hot = materialize(held.groupBy("h").agg(F.count("*").alias("f")).where(F.col("f") >= HOT), "hot_shingles")
    ranked = held.join(small(hot, limit=WANTED), "h", "left").groupBy("nid", "n", "c").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h"))).alias("o"))

    up, n = 1 / least, F.col("n")
    k = F.floor(F.log(n.cast("double")) / F.lit(math.log(up)) + 1e-9) if up > 1 else n
    low = lambda j: F.floor(F.pow(F.lit(up), j) * (1 - 1e-9))
    fits = F.ceil(least * n - 1e-9)
    # class 2k: both lines of size class k; 2k + 1: of k (side 0) and k + 1 (side 1)
    roles = [(2 * k, F.greatest(fits, low(k)), -1), (2 * k + 1, low(k + 1), 0), (2 * k - 1, fits, 1)]
    first = lambda least_size: F.greatest(F.lit(1), F.least(n, n - F.ceil(least / (1 + least) * (n + least_size) - 1e-9) + 1)).cast("int")
    named = lambda kind, side: lambda x, i: F.struct(x["h"].alias("h"), kind.cast("long").alias("kind"), F.lit(side).alias("side"), i.alias("i"))
    keys = [F.transform(F.slice("o", 1, first(at_least)), named(kind, side)) for kind, at_least, side in roles]
    met = materialize(ranked.select("nid", "n", "c", F.explode(F.concat(*keys)).alias("x")).select(F.xxhash64("x.h", "x.kind").alias("key"), "x.side", "x.i", "nid", "n", "c"), "prefixes")
    group = met.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    group = group.where("c0 != c1 and (s0 != s1 or s0 = -1)").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = met.join(group, "key").withColumn("block", F.pmod(F.xxhash64("nid", "key"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = dealt.where("side < 1").select("key", F.col("block").alias("p"), others.alias("q"), F.col("nid").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("i").alias("ix"), F.col("side").alias("sx"))
    two = dealt.where("side != 0").select("key", others.alias("p"), F.col("block").alias("q"), F.col("nid").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("i").alias("iy"))
    can = F.expr("least(nx - ix, ny - iy)") >= least / (1 + least) * (F.col("nx") + F.col("ny")) - 1e-9
    pairs = one.join(two, ["key", "p", "q"]).where(F.expr("cx != cy and (sx = 0 or x < y)") & (F.least("nx", "ny") >= least * F.greatest("nx", "ny")) & can)
    swap = F.col("x") < F.col("y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("cx")).otherwise(F.col("cy")).alias("ca"), F.when(swap, F.col("cy")).otherwise(F.col("cx")).alias("cb"))


def components(lines: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(node, component) of the lines of `lines` (nid, norm) that are linked to others."""
    dealt = bands(lines).repartition("key")
    live = dealt.groupBy("key").agg(F.count("*").alias("m"), F.min("nid").alias("lead")).where("m > 1")
    members = materialize(dealt.join(live.hint("shuffle_hash"), "key"), "bands")
    held = materialize(lines.select("nid", "norm").join(small(members.select("nid").distinct(), limit=WANTED), "nid"), "line_texts")

    bits = materialize(window_bits(held), "line_bits")
    shared = members.where("nid != lead").groupBy("nid", "lead").agg(F.count("*").alias("n"))
    lead = shared.groupBy("nid").agg(F.max(F.struct("n", -F.col("lead"))).alias("best")).select((-F.col("best")["col2"]).alias("a"), F.col("nid").alias("b"))
    found = materialize(_linked(_bounded(lead, bits, least), held, least), "line_links")
    known = connected_components(found, "line_groups")
    for turn in range(TURNS):
        named = materialize(_named(members, known), "named_bands")
        more = materialize(_linked(_bounded(_led(named, turn), bits, least), held, least), "line_links")
        known = _merged(known, more)
    named = materialize(_named(members, known), "named_bands")
    more = materialize(_across(named, held, bits, least), "line_pairs")
    return _merged(known, _linked(more, held, least))


def _named(members: DataFrame, known: DataFrame) -> DataFrame:
    """(key, nid, c): the places in bands with their components so far."""
    c = known.select(F.col("node").alias("nid"), F.col("component").alias("c"))
    return members.select("key", "nid").join(c, "nid", "left").withColumn("c", F.coalesce("c", "nid"))


def _led(named: DataFrame, turn: int) -> DataFrame:
    """(a, b, ca, cb): each line of a band of many lines and several components, with one line of another component that is chosen anew each turn."""
    group = named.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by(F.struct("nid", "c"), F.xxhash64("nid", F.lit(turn))).alias("lead"))
    led = named.join(group.where(F.col("m") > FEW).where("c0 != c1").select("key", "lead"), "key").where("c != lead.c")
    swap = F.col("nid") < F.col("lead.nid")
    return led.select(F.least("nid", "lead.nid").alias("a"), F.greatest("nid", "lead.nid").alias("b"), F.when(swap, F.col("c")).otherwise(F.col("lead.c")).alias("ca"), F.when(swap, F.col("lead.c")).otherwise(F.col("c")).alias("cb")).distinct()


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """`known` (node, component) after `links` (ca, cb) between its components, or lines that are in none yet."""
    joined = known.select(F.col("node").alias("nid"), F.col("component").alias("c"))
    across = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "line_groups")
    both = joined.join(across.withColumnRenamed("node", "c"), "c", "left").select(F.col("nid").alias("node"), F.coalesce("component", "c").alias("component"))
    return materialize(both.unionByName(across.join(joined.select(F.col("nid").alias("node")), "node", "left_anti")), "line_groups")


def removed_lines(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(rk, gone): the numbers, from 0, of the lines that each document loses; documents that lose none are absent.

    A line is known by two hashes of its text. The join of places with the lines that repeat has one row for each place,
    so a common line costs no more than its places; beyond the broadcast limit Spark splits its partition.
    """
    lines = unique_lines(docs)
    linked = components(lines, least).withColumnsRenamed({"node": "nid"})
    known = lines.join(linked, "nid", "left").where("m > 1 or component is not null")
    two = _keys()
    flagged = materialize(known.select(*two, F.coalesce("component", "nid").alias("component")), "repeated_lines")
    places = lines_of(docs).select("rk", F.struct(F.col("d").isNull().alias("none"), "d", "line_no", "rk").alias("at"), *two)
    held = materialize(places.join(small(flagged.select("h1", "h2"), limit=WANTED), ["h1", "h2"], "left_semi"), "repeats")
    # the first place of each line, then of each component: both are counted before they are shuffled
    first = held.groupBy("h1", "h2").agg(F.min("at").alias("at")).join(flagged, ["h1", "h2"]).groupBy("component").agg(F.min("at").alias("at"))
    gone = held.select("rk", F.col("at.line_no").alias("line_no")).join(first.select("at.rk", "at.line_no"), ["rk", "line_no"], "left_anti")
    return gone.groupBy("rk").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents with their columns, without the lines that repeat earlier ones. Documents of which nothing is left go."""
    out = rows_of(docs).join(removed_lines(docs, least), "rk", "left")
    whole = F.col("row")["text"]
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = out.withColumn("text", F.when(F.col("gone").isNull(), whole).otherwise(left))
    return given_rows(out.where(F.col("gone").isNull() | (normal(F.col("text")) != "")), docs, F.col("text"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row a document: how many lines it has, which go (numbers from 0), and how many stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.select("doc_id", row_key(docs["doc_id"], docs["text"]).alias("rk"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    out = base.join(removed_lines(docs), "rk", "left")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("gone"), F.lit(0))).alias("n_kept"), F.sort_array(F.coalesce("gone", F.array().cast("array<int>"))).alias("removed"))
