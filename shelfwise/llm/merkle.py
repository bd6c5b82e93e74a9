"""Merkle manifest of a dataset: a trie keyed by exact ranks, with a proof for every row.

A row's rank within its language comes from histograms of digits, not from a sort: rows are counted by ever shorter
prefixes of their binary doc_id, and from the shortest prefix down each digit's start is its parent's start plus the counts
of the smaller digits beside it. No window holds more than 2**BITS digits. Only rows that tie (a repeated doc_id) are
counted again by the digits of their leaf, and rows that are alike in everything by a number of their own.

The rank's digits in base `fanout` key the trie. Nodes that share their longest prefix, all but the last few digits, are
reduced together in one group of at most BLOCK nodes, whose roots are the nodes of the next step.

Defined cases: null fields are '-' in the leaf; a null language is a group of its own and comes first, a null doc_id comes
first in its language; rows of one doc_id are ordered by the first 60 bits of their leaves, equal rows in any order; a doc_id that
is text is ordered by its UTF-8 bytes; an empty table has no root and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

#: Bits of a digit of the histograms, and the most nodes that are reduced in one group.
BITS, BLOCK = 12, 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAST = -(2**63)
#: Bytes of a text that make one number.
BYTES = 7


def digit_starts(keys: DataFrame, group: list[str], key: str) -> DataFrame:
    """(*group, key, n, before): the rows of each bigint key and how many rows of its group have smaller keys."""
    counts = materialize(keys.groupBy(*group, key).agg(F.count("*").alias("n")), "digits")
    low, high = counts.agg(F.min(key), F.max(key)).first()
    levels = max(1, -(-(((low or 0) ^ (high or 0)) % 2**64).bit_length() // BITS))
    # with the sign bit turned, the order of the digits is that of the numbers
    counts = counts.withColumn("p", F.col(key).bitwiseXOR(F.lit(LEAST))).drop(key)
    above = None
    for k in reversed(range(levels)):
        level = counts if k == 0 else counts.groupBy(*group, F.shiftrightunsigned("p", BITS * k).alias("p")).agg(F.sum("n").alias("n"))
        top = above is None
        level = level.withColumn("parent", F.lit(0) if top else F.shiftrightunsigned("p", BITS))
        smaller = Window.partitionBy(*group, "parent").orderBy(F.col("p") if top else F.col("p").bitwiseAND(F.lit(2**BITS - 1))).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
        if not top:
            level = level.join(above, [*group, "parent"]).withColumn("before", F.col("before") + F.col("start"))
        above = level.select(*group, F.col("p").alias("parent"), F.col("before").alias("start"))
    return level.select(*group, F.col("p").bitwiseXOR(F.lit(LEAST)).alias(key), "n", "before")


def ranked(rows: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """`rows` with `rank`, from 0, in their group by the bigint columns `keys`; only rows that tie are counted by the next one."""
    rest, done = rows.withColumn("rank", F.lit(0).cast("long")), []
    for i, key in enumerate(keys):
        by = [*group, *keys[:i]]
        starts = digit_starts(rest.select(*by, key), by, key)
        rest = materialize(rest.join(starts, [*by, key]).withColumn("rank", F.col("rank") + F.col("before")).drop("before"), "ranked")
        done.append(rest.where("n = 1").drop("n"))
        rest = rest.where("n > 1").drop("n")
        if i + 1 < len(keys) and rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def text_keys(df: DataFrame, text: str, to: str) -> tuple[DataFrame, list[str]]:
    """`df` with bigint columns that order `text` by its UTF-8 bytes, null first, and their names."""
    most = df.agg(F.max(F.octet_length(text))).first()[0] or 1
    width = min(BYTES, most)
    parts = -(-most // width)
    own = F.coalesce(F.col(text), F.lit(""))
    padded = F.rpad(F.hex(F.encode(own, "utf-8")), 2 * width * parts, "0")
    columns = {f"{to}{i}": F.conv(F.substring(padded, 2 * width * i + 1, 2 * width), 16, 10).cast("long") for i in range(parts)}
    columns |= {f"{to}_bytes": F.octet_length(own).cast("long"), f"{to}_there": F.col(text).isNotNull().cast("long")}
    return df.withColumns(columns), list(columns)


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*[F.coalesce(F.concat(F.octet_length(v := fields[c].cast("string")).cast("string"), F.lit(":"), v), F.lit("-")) for c in FIELDS])


def reduced(nodes: DataFrame, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """(g, rank, h, p, path) of the nodes (g, rank, h, n nodes in g, p: anything) and (g, h): the roots.

    path holds, level by level, the digests left and right of the node's ancestor in its run.
    """
    deep = 1
    while fanout ** (deep + 1) <= BLOCK:
        deep += 1
    width = fanout**deep
    levels_of = lambda n: F.when(n > width, F.lit(deep)).otherwise(sum((n > fanout**d).cast("int") for d in range(deep)))
    kids = F.transform(F.sort_array(F.collect_list(F.struct((F.col("rank") % width).cast("int").alias("i"), "h", "p"))), lambda k: F.struct(k["h"].alias("h"), k["p"].alias("p")))
    blocks = nodes.groupBy("g", F.expr(f"rank div {width}").alias("b")).agg(kids.alias("kids"), F.first("n").alias("n")).withColumn("deep", levels_of(F.col("n")))
    first = F.transform("kids", lambda k: k["h"])
    runs = lambda hs: F.transform(F.sequence(F.lit(0), F.floor((F.size(hs) - 1) / fanout).cast("int")), lambda k: F.sha2(F.array_join(F.slice(hs, k * fanout + 1, fanout), ""), 256))
    climbed = F.aggregate(F.sequence(F.lit(1), F.greatest("deep", F.lit(1))), F.array(first), lambda all_, _: F.concat(all_, F.array(runs(F.element_at(all_, -1)))))
    blocks = materialize(blocks.withColumn("levels", F.when(F.col("deep") > 0, climbed).otherwise(F.array(first))), "trie")

    size = F.array(*[F.lit(fanout**d) for d in range(deep)])

    def siblings(i: Column, level: Column) -> Column:
        at = F.floor(i / F.get(size, level)).cast("int")
        start = at - at % fanout
        hs = F.get("levels", level)
        return F.struct(F.array_join(F.slice(hs, start + 1, at - start), "").alias("left"), F.array_join(F.slice(hs, at + 2, start + fanout - at - 1), "").alias("right"))

    none = F.array().cast("array<struct<left:string,right:string>>")
    path = lambda i: F.when(F.col("deep") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("deep") - 1, F.lit(0))), lambda d: siblings(i, d))).otherwise(none)
    placed = blocks.select("g", "b", F.inline(F.transform("kids", lambda k, i: F.struct(i.alias("i"), k["h"].alias("h"), k["p"].alias("p"), path(i).alias("path")))))
    placed = placed.select("g", "b", (F.col("b") * width + F.col("i")).alias("rank"), "h", "p", "path")
    roots = blocks.select("g", F.col("b").alias("rank"), F.get(F.element_at("levels", -1), F.lit(0)).alias("h"), "n")
    whole = roots.where(F.col("n") <= width).select("g", "h")
    if not roots.where(F.col("n") > width).isEmpty():
        upper = roots.where(F.col("n") > width).select("g", "rank", "h", F.ceil(F.col("n") / width).alias("n"), F.lit(0).alias("p"))
        higher, tops = reduced(upper, fanout)
        higher = small(higher.select("g", F.col("rank").alias("b"), F.col("path").alias("higher")))
        placed = placed.join(higher, ["g", "b"], "left").withColumn("path", F.concat("path", F.coalesce("higher", none))).drop("higher")
        whole = whole.unionByName(tops)
    return placed.drop("b"), whole


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """(doc_id, leaf, claim, subroot, root, path) of every row; claim is the leaf of the row with the fields `claimed` instead of its own."""
    fields = {c: docs[c] for c in FIELDS}
    leaf, other = leaf_of(fields), leaf_of({**fields, **(claimed or {})})
    by_text = dict(docs.dtypes)["doc_id"] == "string"
    leaves = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), leaf.alias("leaf"), F.nullif(other, leaf).alias("claim"), F.monotonically_increasing_id().alias("own"))
    leaves = materialize(leaves, "leaves")
    langs = materialize(leaves.groupBy("lang").agg(F.count("*").alias("size")), "langs")
    numbered, keys = text_keys(langs, "lang", "k")
    numbered = materialize(ranked(numbered, [], keys).select("lang", "size", F.col("rank").alias("g")), "groups")
    n_langs = numbered.count()
    part = small(numbered.withColumnRenamed("lang", "of"), n_langs)
    leaves = leaves.join(part, leaves["lang"].eqNullSafe(part["of"])).drop("of", "lang")
    if by_text:
        leaves, keys = text_keys(leaves, "doc_id", "k")
    else:
        keys = ["k", "k_there"]
        leaves = leaves.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn("k_there", F.col("doc_id").isNotNull().cast("long"))
    leaves = leaves.withColumn("k_leaf", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    rows = ranked(leaves, ["g"], [*keys, "k_leaf", "own"])
    placed, subroots = reduced(rows.select("g", "rank", F.col("leaf").alias("h"), F.col("size").alias("n"), F.struct("doc_id", "claim").alias("p")), fanout)
    tops, top = reduced(subroots.select(F.lit(0).alias("g"), F.col("g").alias("rank"), "h", F.lit(n_langs).alias("n"), F.lit(0).alias("p")), fanout)
    root = top.first()
    tops = small(tops.select(F.col("rank").alias("g"), F.col("h").alias("subroot"), F.col("path").alias("top")), n_langs)
    return placed.join(tops, "g").select(
        "p.doc_id", F.col("h").alias("leaf"), F.coalesce("p.claim", "h").alias("claim"), "subroot", F.lit(root[1] if root else None).cast("string").alias("root"), F.concat("path", "top").alias("path")
    )


def verified(rows: DataFrame) -> DataFrame:
    """Folds each claim with the siblings on its path: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    folded = F.aggregate("path", F.col("claim"), lambda h, s: digest(s["left"], h, s["right"]))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    return verified(manifest(docs, {"n_chars": F.when(chosen, docs["n_chars"] + 1).otherwise(docs["n_chars"])}))


#: crc32 of the decimal digits of doc_id, bit by bit.
CRC = "list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


def _up(name: str, base: str) -> str:
    """Nodes of all levels above `base` (g, pos, h, n)."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, h, n FROM {base}
  UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2
)"""


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, {_leaf("n_chars")} AS leaf, {_leaf(f"n_chars + CASE WHEN xor({CRC}, 4294967295) % 7 = 0 THEN 1 ELSE 0 END")} AS claim FROM documents
), p AS (
  SELECT r, doc_id, leaf, coalesce(claim, leaf) AS claim, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), leaves AS (SELECT g, pos, leaf AS h, n FROM p), {_up("nodes", "leaves")}
, subs AS (SELECT 0 AS g, g AS pos, h, (SELECT count(DISTINCT g) FROM p) AS n FROM nodes WHERE n = 1)
, {_up("tops", "subs")}
, path AS (
  SELECT r, p.lvl, s.h AS side, (p.pos >> p.lvl) % 2 = 1 AS is_right FROM (
    SELECT r, g, pos, unnest(range(0, (SELECT max(lvl) FROM nodes WHERE nodes.g = p.g)))::INTEGER AS lvl FROM p) p
  LEFT JOIN nodes s ON s.g = p.g AND s.lvl = p.lvl AND s.pos = xor(p.pos >> p.lvl, 1)
  UNION ALL
  SELECT r, 1000 + p.lvl, s.h, (p.g >> p.lvl) % 2 = 1 FROM (SELECT r, g, unnest(range(0, (SELECT max(lvl) FROM tops)))::INTEGER AS lvl FROM p) p
  LEFT JOIN tops s ON s.lvl = p.lvl AND s.pos = xor(p.g >> p.lvl, 1)
), steps AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k, coalesce(side, '') AS side, is_right FROM path
), fold AS (
  SELECT r, 0 AS k, claim AS h FROM p
  UNION ALL
  SELECT r, f.k + 1, sha256(CASE WHEN is_right THEN side || h ELSE h || side END) FROM fold f JOIN steps s USING (r) WHERE s.k = f.k + 1
), ends AS (
  SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r
), proofs AS (
  SELECT p.r, sha256(coalesce(string_agg(side, '' ORDER BY k), '')) AS proof_sha256 FROM p LEFT JOIN steps USING (r) GROUP BY p.r
)
SELECT doc_id, leaf, subs.h AS subroot, tops.h AS root, proof_sha256, folded_root, folded_root = tops.h AS verified
FROM p JOIN subs ON subs.pos = p.g JOIN tops ON tops.n = 1 JOIN ends USING (r) JOIN proofs USING (r)
"""
