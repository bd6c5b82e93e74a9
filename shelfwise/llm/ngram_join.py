"""N-gram Jaccard join by chosen paths.

Every document is a set of five-word shingles. Equal sets become one weighted set. Sets are embedded as POSITIONS minhash
tokens, and each of RUNS runs splits them recursively: a path picks one sampled position, and with a chance of EXTRA a
second (1 / 0.8 = 1.25 children on average, as the threshold asks), and sets go down together while they share the token
there. Two levels are always taken; buckets of more than LARGE sets are split further, up to LEVELS. In each bucket all
pairs of tokens sketches are compared, and pairs that may reach the threshold are linked; a bucket that is still
large at the last level is cut into parts of LARGE sets that are compared among themselves and with landmarks sampled
from the whole bucket; then each set that isn't in the bucket's largest cluster is compared with all of the bucket, in
pairs of blocks, so that of every pair of a bucket both are in one cluster or have been compared. Linked sets form clusters by distributed union-find, so that every set is sent to
one cluster only, and within a cluster all pairs are compared by exact Jaccard similarity: large clusters in pairs of
blocks, each in a task of its own.

Recall: at 0.8 a run keeps a pair with a chance of about 0.7 after two levels and 0.6 after four, so twelve runs miss
about one pair in a million and in fifty thousand; links of both through a third set add to that.

Defined cases: null texts and texts without words have no shingles and no links; texts of one to four words are one
shingle, so equal ones are linked; rows that repeat a text are copies and are links of each other; a null doc_id stays
null; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILAR, given_rows, materialize, row_key, rows_of, small
from .graph import connected_components
from .hashing import mix, shingle_sets

POSITIONS, RUNS, EXTRA, LARGE, LEVELS, LANDMARKS = 64, 12, 0.25, 256, 4, 16
#: Sketches that agree in fewer positions are no candidates: four standard deviations below 0.8.
AGREE = 0.6
#: Sets of a block of a large bucket.
MEMBERS = 2048
#: Sets and shingles of a block of a large cluster.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_500_000

_seeds = mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64))
XORS, ODDS = (_seeds[:POSITIONS] >> np.uint64(32)).astype(np.uint32), ((_seeds[POSITIONS:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """POSITIONS 16-bit tokens a set; sets without shingles get zeros."""
    out = np.zeros((len(sets), POSITIONS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    step = 512
    for lo in range(0, len(full), step):
        part = full[lo : lo + step]
        h = (np.concatenate([sets[i] for i in part]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(sets[i]) for i in part[:-1]])
        for t in range(POSITIONS):
            least = np.minimum.reduceat((h ^ XORS[t]) * ODDS[t], at)
            out[part, t] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def descend(keys: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child paths of the paths of sets with tokens `sig`: (paths, row of the parent)."""
    rows = np.arange(len(keys))
    first = mix(keys + np.uint64(1))
    second = mix(keys + np.uint64(2))
    two = (second >> np.uint64(40)).astype(np.float64) / 2**24 < EXTRA
    out = []
    for pick, some in ((first, rows), (second, rows[two])):
        at = (pick[some] % np.uint64(POSITIONS)).astype(np.int64)
        out.append((mix(mix(keys[some] * np.uint64(POSITIONS + 1) + at.astype(np.uint64)) + sig[some, at].astype(np.uint64)), some))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def paths(sig: np.ndarray, levels: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Paths of all runs after `levels` levels: (paths, row)."""
    roots = mix(np.arange(1000, 1000 + RUNS, dtype=np.uint64))
    keys, rows = np.tile(roots, len(sig)), np.repeat(np.arange(len(sig)), RUNS)
    for _ in range(levels):
        keys, parent = descend(keys, sig[rows])
        rows = rows[parent]
    return keys, rows


def _linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n members' component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return root
        root = new


def _close(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose tokens agree often enough."""
    same = np.zeros((len(sig), len(sig)), np.uint8)
    for t in range(POSITIONS):
        same += sig[:, t][:, None] == sig[:, t][None, :]
    return np.nonzero(np.triu(same >= AGREE * POSITIONS, 1))


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    if len(a) * len(b) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], np.int64).reshape(len(a), len(b))
    both = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    _, col, count = np.unique(both, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((len(a) + len(b), 4096), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return np.rint(out).astype(np.int64)


def runs_of(batches, key: str):
    """Consecutive rows of equal key, over batches of rows that are sorted by it."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if rest and rest[-1][key].iat[0] != k[lo]:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(pdf.iloc[lo:hi])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def signed(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, digest, n, sig, paths) of every row; digest is of the set of shingles, and null where there are none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                sets = shingle_sets(part["text"].tolist())
                sig = minhash(sets)
                keys, rows = paths(sig)
                order = np.argsort(rows, kind="stable")
                own = np.split(keys[order].view(np.int64), np.searchsorted(rows[order], np.arange(1, len(part))))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pd.DataFrame({"rk": part["rk"], "doc_id": part["doc_id"], "digest": digest, "n": [len(s) for s in sets], "sig": [x.tobytes() for x in sig], "paths": own})

    rows = docs.select(row_key(docs["doc_id"], docs["text"]).alias("rk"), docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(sign, f"rk binary, doc_id {kind}, digest binary, n int, sig binary, paths array<bigint>"), "signed")


def _deeper(batches):
    for pdf in batches:
        if len(pdf):
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), POSITIONS)
            keys, rows = descend(pdf["path"].to_numpy().view(np.uint64), sig)
            yield pd.DataFrame({"path": keys.view(np.int64), "sid": pdf["sid"].to_numpy()[rows]})


def _compare(batches):
    for group in runs_of(batches, "gid"):
        sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(len(group), POSITIONS)
        sid = group["sid"].to_numpy()
        root = _linked(len(sid), *_close(sig))
        own = root != np.arange(len(sid))
        if own.any():
            yield pd.DataFrame({"a": sid[root[own]], "b": sid[own]})


def _across(batches):
    """Links between the two sides of each unit, a few for each cluster that they join; both sides' clusters are known."""
    for group in runs_of(batches, "unit"):
        right = group["right"].to_numpy()
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        if not len(i) or not len(j):
            continue
        sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(len(group), POSITIONS)
        sid, comp = group["sid"].to_numpy(), group["comp"].to_numpy()
        same = np.zeros((len(i), len(j)), np.uint8)
        for t in range(POSITIONS):
            same += sig[i, t][:, None] == sig[j, t][None, :]
        x, y = np.nonzero((same >= AGREE * POSITIONS) & (comp[i][:, None] != comp[j][None, :]))
        root = _linked(len(sid), i[x], j[y])
        own = root != np.arange(len(sid))
        if own.any():
            yield pd.DataFrame({"a": sid[root[own]], "b": sid[own]})


def _rest_of(many: DataFrame, sigs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): links that `edges` miss between sets of one large bucket; `many` is (path, sid, n).

    Sets of the bucket's largest cluster are linked already, so only the others meet the whole bucket.
    """
    known = connected_components(edges, "linked").withColumnsRenamed({"node": "sid", "component": "comp"})
    held = materialize(many.join(known, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "held")
    sizes = held.groupBy("path", "comp").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("path").agg(F.max(F.struct("k", "comp")).alias("core"), F.sum("k").alias("n")).select("path", F.col("core.comp").alias("core"), F.col("n"), (F.col("n") - F.col("core.k")).alias("out"))
    held = held.drop("n").join(largest.where("out > 0"), "path")
    blocks = lambda n: F.ceil(F.col(n) / MEMBERS).cast("int")
    own = lambda n: F.pmod(F.xxhash64("sid", "path", F.lit(2)), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    unit = lambda: F.xxhash64("path", "i", "j").alias("unit")
    left = held.where("comp != core").select("path", "sid", "comp", own("out").alias("i"), each("n").alias("j")).select(unit(), "sid", "comp", F.lit(False).alias("right"))
    right = held.select("path", "sid", "comp", each("out").alias("i"), own("n").alias("j")).select(unit(), "sid", "comp", F.lit(True).alias("right"))
    dealt = left.unionByName(right).join(sigs, "sid").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(_across, "a bigint, b bigint")


def clusters(sets: DataFrame) -> DataFrame:
    """(sid, cluster) of the sets that a bucket of chosen paths links to others; `sets` is (sid, sig, paths)."""
    members = sets.select("sid", F.explode("paths").alias("path")).distinct()
    sigs = sets.select("sid", "sig")
    edges = []
    for level in range(2, LEVELS + 1):
        held = members.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        members = materialize(members.join(held, "path"), "paths")
        few = members.where(F.col("n") <= LARGE).groupBy("path").agg(F.sort_array(F.collect_list("sid")).alias("g")).select("g").distinct()
        parts = few.select(F.xxhash64("g").alias("gid"), F.explode("g").alias("sid"))
        many = members.where(F.col("n") > LARGE)
        last = level == LEVELS
        if last:
            n = F.ceil(F.col("n") / LARGE)
            part = many.select("sid", F.xxhash64("path", F.pmod(F.xxhash64("sid", "path"), n)).alias("gid"))
            landmark = F.pmod(F.xxhash64("sid", "path", F.lit(1)), F.lit(1 << 40)) * F.col("n") < LANDMARKS * (1 << 40)
            marks = many.where(landmark).select("sid", F.explode(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.xxhash64("path", i.cast("long")))).alias("gid"))
            parts = parts.unionByName(part).unionByName(marks)
        groups = parts.distinct().join(sigs, "sid").repartition("gid").sortWithinPartitions("gid")
        edges.append(groups.mapInPandas(_compare, "a bigint, b bigint"))
        if many.isEmpty():
            break
        if last:
            found = materialize(reduce(DataFrame.unionByName, edges), "found")
            edges = [found, _rest_of(many, sigs, found)]
            break
        members = many.select("path", "sid").join(sigs, "sid").mapInPandas(_deeper, "path bigint, sid bigint").distinct()
    return connected_components(reduce(DataFrame.unionByName, edges), "clusters").withColumnsRenamed({"node": "sid", "component": "cluster"})


def distinct_sets(sign: DataFrame) -> DataFrame:
    """(sid, digest, weight, rk, n, sig, paths): the different sets of shingles, numbered, and in how many rows each is."""
    real = sign.where("digest is not null").groupBy("digest").agg(F.count("*").alias("weight"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    return materialize(real.select(F.monotonically_increasing_id().alias("sid"), "*"), "sets")


def links(docs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(sid, n_links) to other sets, counted in rows, and the edges (a, b) that join linked sets."""
    cluster = clusters(sets)
    named = cluster.join(sets.select("sid", "weight", "rk", "n"), "sid")
    heavy = named.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    named = materialize(named.join(heavy, "cluster"), "clustered")
    text = docs.select(row_key(docs["doc_id"], docs["text"]).alias("rk"), docs["text"].alias("text"))
    whole = text.join(small(named.select("rk", "sid", "cluster", "weight", "blocks")), "rk").dropDuplicates(["sid"])

    def cut(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                yield part.drop(columns=["rk", "text"]).assign(members=[s.tobytes() for s in shingle_sets(part["text"].tolist())])

    cutted = whole.mapInPandas(cut, "sid bigint, cluster bigint, weight bigint, blocks int, members binary")
    block = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("blocks")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = cutted.withColumn("block", block).select("sid", "cluster", "weight", "block", "members", F.explode(units).alias("u"))
    dealt = dealt.select(F.xxhash64("cluster", "u.i", "u.j").alias("unit"), "sid", "weight", "members", (F.col("block") == F.col("u.j")).alias("right"), (F.col("u.i") == F.col("u.j")).alias("own"))

    def verify(batches):
        for group in runs_of(batches, "unit"):
            sets = [np.frombuffer(x, np.uint64) for x in group["members"]]
            sid, weight, right, own = (group[c].to_numpy() for c in ("sid", "weight", "right", "own"))
            n = np.array([len(s) for s in sets])
            i, j = (np.arange(len(sets)),) * 2 if own[0] else (np.flatnonzero(~right), np.flatnonzero(right))
            if not len(i) or not len(j):
                continue
            shared = intersections([sets[x] for x in i], [sets[x] for x in j])
            near = shared >= least * (n[i][:, None] + n[j][None, :] - shared)
            if own[0]:
                np.fill_diagonal(near, False)
            count = np.zeros(len(sets), np.int64)
            count[i] += near @ weight[j]
            if not own[0]:
                count[j] += weight[i] @ near
            x, y = np.nonzero(near)
            root = _linked(len(sets), i[x], j[y])
            some = count > 0
            yield pd.DataFrame({"sid": sid[some], "n": count[some], "root": sid[root[some]]})

    out = materialize(dealt.repartition("unit").sortWithinPartitions("unit").mapInPandas(verify, "sid bigint, n bigint, root bigint"), "verified")
    return out.groupBy("sid").agg(F.sum("n").alias("n_links")), out.select(F.col("sid").alias("a"), F.col("root").alias("b")).where("a != b")


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(rk, doc_id, class, n_links) of every row; class names the rows that links join, and is null for rows without a set."""
    sign = signed(docs)
    sets = distinct_sets(sign)
    count, edges = links(docs, sets, least)
    joined = connected_components(edges, "classes").withColumnsRenamed({"node": "sid", "component": "class"})
    known = sets.select("sid", "digest", "weight").join(count, "sid", "left").join(joined, "sid", "left")
    known = known.select("digest", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("class", "sid").alias("class"))
    out = sign.select("rk", "doc_id", "digest").join(known, "digest", "left")
    return out.select("rk", "doc_id", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def dedup(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents with their columns, one of each class: that of the least doc_id, in its type's order. Documents without words all stay."""
    named = materialize(classes(docs, least), "named")
    first = named.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("first"))
    stay = first.select("first.rk")
    gone = named.where("class is not null").select("rk").join(stay, "rk", "left_anti").distinct()
    out = rows_of(docs).join(small(gone), "rk", "left_anti")
    if not named.groupBy("rk").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["rk"])
    return given_rows(out, docs)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """One row a document: its class (the least doc_id that links lead to) and its number of links."""
    named = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = materialize(named, "classes")
    first = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return named.join(first, "class", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")
