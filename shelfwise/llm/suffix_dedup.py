"""Removal of long repeated byte strings by suffix order and longest previous factors.

Whole texts are UTF-8 bytes. Every string of `length` bytes holds an anchor: the position whose GRAM-byte hash is the
first of its least. Equal strings have equal anchors, so repeats can only be found among anchors with an equal hash. The
starts that share an anchor are stretches, and a stretch's context is all bytes of its strings. Contexts that occur
elsewhere as a whole are repeats throughout; of the others with a shared anchor, and of one of each whole repeat to compare
with, the contexts are sent to blocks, all contexts of an anchor hash to one block.

A block is one text. Its starts are put in suffix order by doubling (names of 8 bytes, then of pairs of names, up to
`length`), which compares bytes, not hashes. In that order the nearest start before and the nearest behind with a smaller
place give each start's longest previous factor: the longer of the two common beginnings, in bytes up to `length`. The
mirror with greater places is the longest next factor. keep="first" removes what repeats something earlier and so keeps
the first copy; keep="none" removes every copy. "Earlier" is the order of a document's text hash and then of positions.

An anchor hash with more than HOT different contexts is not sent to one block: its strings are named one by one (by hashes
of their four quarters) and counted by distributed aggregation, which gives the same answer.

Defined cases: null texts are empty; texts shorter than `length` keep all their bytes; a text that is repeated as a whole
is removed as a whole (keep="first": the row of the least doc_id keeps it, every row where doc_ids tie); a null doc_id
stays null; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small
from .hashing import BASE, INVERSE, chunks, mix, powers

LENGTH, GRAM = 400, 32
#: Contexts of a block, and the most of one anchor hash.
BLOCK, HOT = 1500, 8000
#: The contexts to read are broadcast below this many (some 24 bytes each); beyond it texts are joined by shuffling.
WANTED = 2_000_000
FAR = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, w: int, best, fill) -> np.ndarray:
    """best over each x[i : i + w]."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[w - 1 : w - 1 + n])


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of each b[i : i + size]."""
    if len(b) < size:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)))])
    return mix((sums[size:] - sums[:-size]) * powers(INVERSE, len(b))[: len(b) - size + 1])


def anchors(raw: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first and last string start, anchor position, anchor hash) of the stretches of starts with one anchor.

    The anchor of a string is the first of its least GRAM hashes.
    """
    size = np.array([len(r) for r in raw])
    first = np.concatenate([[0], np.cumsum(size)])
    h = gram_hashes(np.frombuffer(b"".join(raw), np.uint8), GRAM)
    w = length - GRAM + 1
    low = _sliding(h, w, np.minimum, FAR)
    of = np.repeat(np.arange(len(raw)), np.maximum(size - length + 1, 0))
    if not len(of):
        return (of,) * 4 + (np.zeros(0, np.uint64),)
    begin = np.cumsum(np.maximum(size - length + 1, 0)) - np.maximum(size - length + 1, 0)
    start = np.arange(len(of)) - begin[of] + first[of]
    least = low[start]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)]))
    lo, hi, value, of = start[new], start[np.append(new[1:], len(start)) - 1], least[new], of[new]
    # where each least hash stands: the first place at or behind the start, found among the places sorted by hash
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(h <= _sliding(np.concatenate([edge, low, edge]), w, np.maximum, np.uint64(0)))
    names, rank = np.unique(h[at], return_inverse=True)
    places = np.sort(rank * len(h) + at)
    find = lambda v, s: places[np.searchsorted(places, np.searchsorted(names, v) * len(h) + s)] % len(h)
    own = find(value, lo)
    tied = own < hi
    if tied.any():  # the same hash again further on: from each place on, the next one is the anchor
        n = (hi - lo + 1)[tied]
        each = np.repeat(np.flatnonzero(tied), n)
        s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[each]
        p = find(value[each], s)
        cut = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (p[1:] != p[:-1])]))
        ends = np.append(cut[1:], len(s)) - 1
        keep = ~tied
        lo, hi, own = (np.concatenate([x[keep], y]) for x, y in ((lo, s[cut]), (hi, s[ends]), (own, p[cut])))
        value, of = np.concatenate([value[keep], value[each[cut]]]), np.concatenate([of[keep], of[each[cut]]])
    return of, lo - first[of], hi - first[of], own - first[of], value


def window_names(context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context number, names of its four quarters) for each string start of each context, in order."""
    q = length // 4
    b = np.frombuffer(b"".join(context), np.uint8)
    size = np.array([len(c) for c in context])
    first = np.cumsum(size) - size
    h = gram_hashes(b, q)
    starts = size - length + 1
    of = np.repeat(np.arange(len(context)), starts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + first[of]
    tail = gram_hashes(b, length - 3 * q)
    return of, np.stack([h[at], h[at + q], h[at + 2 * q], tail[at + 3 * q]])


def prefix_names(b: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, names): ranks of the strings of each size at every byte of b, by doubling up to `length`. Near b's end they mean nothing."""
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    size = min(8, length)
    code = np.zeros(len(b), np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | ahead(b, k).astype(np.uint64)
    rank = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int32)
    levels = [(size, rank(code))]
    while size < length:
        step = min(size, length - size)
        names = levels[-1][1]
        levels.append((size + step, rank(names.astype(np.int64) * (len(b) + 1) + ahead(names, step))))
        size += step
    return levels


def common_beginning(b: np.ndarray, levels: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many bytes the strings at p and at q share from their start, up to the size of the last level."""
    most = levels[-1][0]
    n = np.where(levels[-1][1][p] == levels[-1][1][q], most, 0)
    left = np.flatnonzero(n == 0)
    for size, names in levels[-2::-1]:
        x, y = p[left] + n[left], q[left] + n[left]
        inside = n[left] + size <= most
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        n[left] += np.where(inside & (names[x] == names[y]), size, 0)
    for _ in range(min(levels[0][0], most - 1)):
        left = left[n[left] < most]
        left = left[b[p[left] + n[left]] == b[q[left] + n[left]]]
        n[left] += 1
    return n


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 where there is none: by minima of runs of 1, 2, 4, .. places."""
    minima = [values]
    while 2 ** len(minima) <= len(values):
        low, half = minima[-1], 2 ** (len(minima) - 1)
        minima.append(np.minimum(low[:-half], low[half:]))
    at = np.arange(len(values))
    for k in range(len(minima) - 1, -1, -1):
        back = at - 2**k
        at = np.where((back >= 0) & (minima[k][np.maximum(back, 0)] >= values), back, at)
    return at - 1


def factors(b: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of the strings of b at `starts`, in bytes up to `length`.

    place orders the strings; those of one place are the same bytes of a text and no repeat of each other.
    """
    levels = prefix_names(b, length)
    order = np.argsort(levels[-1][1][starts], kind="stable")
    at, held = starts[order], place[order]

    def longest(values: np.ndarray) -> np.ndarray:
        before = nearest_smaller(values)
        behind = len(values) - 1 - nearest_smaller(values[::-1])[::-1]
        best = np.zeros(len(values), np.int64)
        for other, there in ((before, before >= 0), (behind, behind < len(values))):
            best[there] = np.maximum(best[there], common_beginning(b, levels, at[there], at[other[there]]))
        out = np.zeros(len(values), np.int64)
        out[order] = best
        return out

    return longest(held), longest(-held)


def stretches(of: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, from, to) of the byte runs that strings at sorted starts cover."""
    if not len(of):
        return of, start, start
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(of)]]) - 1
    return of[new], start[new], start[last] + length


def _anchor_rows(length: int):
    def scan(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in chunks(texts):
                raw = [t.encode("utf-8", "replace") for t in texts[lo:hi]]
                of, a, last, at, h = anchors(raw, length)
                b = last + length
                whole = [hashlib.blake2b(raw[i][x:y], digest_size=8, salt=str(p - x).encode()).digest() for i, x, y, p in zip(of.tolist(), a.tolist(), b.tolist(), at.tolist())]
                yield pd.DataFrame({"tid": pdf["tid"].to_numpy()[lo:hi][of], "a": a.astype(np.int32), "b": b.astype(np.int32), "h": h.view(np.int64), "ctx": np.frombuffer(b"".join(whole), np.int64)})

    return scan


def _context_rows():
    def cut(batches):
        for pdf in batches:
            out = []
            for tid, text, want in zip(pdf["tid"], pdf["text"], pdf["want"]):
                raw = text.encode("utf-8", "replace")
                for w in want:
                    out.append((w["block"], tid, w["a"], w["twice"], raw[w["a"] : w["b"]]))
                    if len(out) == 2000:
                        yield pd.DataFrame(out, columns=["block", "tid", "lo", "twice", "bytes"])
                        out = []
            yield pd.DataFrame(out, columns=["block", "tid", "lo", "twice", "bytes"])

    return cut


def _repeats(length: int, keep: str):
    """Byte runs that repeat, of the contexts that are not whole repeats, from rows sorted by block."""
    from .ngram_join import runs_of

    def find(batches):
        for group in runs_of(batches, "block"):
            tid, lo, twice = group["tid"].to_numpy(), group["lo"].to_numpy().astype(np.int64), group["twice"].to_numpy()
            context = group["bytes"].tolist()
            size = np.array([len(x) for x in context])
            count = size - length + 1
            of = np.repeat(np.arange(len(context)), count)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = inside + lo[of]
            ranks = np.lexsort((start, tid[of]))
            place = np.zeros(len(of), np.int32)
            place[ranks] = np.cumsum(np.concatenate([[0], (np.diff(tid[of][ranks]) != 0) | (np.diff(start[ranks]) != 0)]))
            previous, following = factors(np.frombuffer(b"".join(context), np.uint8), inside + (np.cumsum(size) - size)[of], place, length)
            hit = previous >= length
            if keep == "none":
                hit = (hit | (following >= length)) & ~twice[of]
            i, a, b = stretches(of[hit], start[hit], length)
            if len(i):
                yield pd.DataFrame({"tid": tid[i], "a": a.astype(np.int32), "b": b.astype(np.int32)})

    return find


def _named(length: int):
    """Each string of the contexts of hot anchors, by a joint name."""

    def name(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                of, q = window_names(part["bytes"].tolist(), length)
                start = np.arange(len(of)) - np.searchsorted(of, np.arange(len(part)))[of] + part["lo"].to_numpy()[of]
                yield pd.DataFrame({"name": mix(q[0] + mix(q[1] + mix(q[2] + mix(q[3])))).view(np.int64), "tid": part["tid"].to_numpy()[of], "a": start.astype(np.int32)})

    return name


def repeated_runs(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(tid, a, b): runs of bytes of distinct texts (tid: a hash of the text) that strings of `length` bytes repeat.

    Runs of one text may overlap. Whole texts that several rows hold are not told apart here: see `repeated`.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("tid"), docs["doc_id"].alias("doc_id"), text.alias("text")).where(F.octet_length("text") >= length)
    found = materialize(texts.select("tid", "text").mapInPandas(_anchor_rows(length), "tid bigint, a int, b int, h bigint, ctx bigint"), "anchors")
    who = F.xxhash64("tid", "a")
    same = found.groupBy("h", "ctx").agg(F.min(who).alias("least"), F.max(who).alias("most"), *[F.min(c).alias(c) for c in ("tid", "a", "b")])
    same = materialize(same.withColumn("twice", F.col("least") != F.col("most")).drop("most"), "contexts")

    # whole repeats: every string of the stretch occurs elsewhere
    twice = small(same.where("twice").select("h", "ctx", "least"))
    repeats = materialize(found.join(twice, ["h", "ctx"]), "repeats")
    whole = repeats
    if keep == "first":
        order = F.struct("tid", "a")
        first = repeats.groupBy("h", "ctx").agg(F.min(order).alias("first"))
        whole = repeats.join(first, ["h", "ctx"]).where(order != F.col("first"))
    runs = whole.select("tid", "a", "b").distinct()

    # one of each different context of an anchor hash that has several
    one = repeats.where(who == F.col("least")).select("tid", "a", "b", "h", F.lit(True).alias("twice")).distinct()
    each = same.where("not twice").select("tid", "a", "b", "h", "twice").unionByName(one).repartition("h")
    several = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    chosen = materialize(each.join(several, "h"), "chosen")
    total = chosen.count()
    blocks = max(1, -(-total // BLOCK))
    block = F.when(F.col("n") > HOT, F.lit(None)).when(F.col("n") > BLOCK, F.xxhash64("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(blocks)))
    wants = chosen.select("tid", F.struct("a", "b", block.alias("block"), "twice").alias("w")).groupBy("tid").agg(F.collect_list("w").alias("want"))
    # of equal texts the row of the least doc_id is read; if that repeats, its contexts come twice and count as one place
    rows = texts.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    wants = small(materialize(wants.join(rows, "tid"), "wants"), total, WANTED)
    kept = texts.join(wants, (texts["tid"] == wants["tid"]) & texts["doc_id"].eqNullSafe(wants["doc_id"])).select(texts["tid"], "text", "want")
    cut = kept.mapInPandas(_context_rows(), "block bigint, tid bigint, lo int, twice boolean, bytes binary")
    if not chosen.where(F.col("n") > HOT).isEmpty():
        cut = materialize(cut, "cut")
        named = cut.where("block is null").mapInPandas(_named(length), "name bigint, tid bigint, a int").distinct()
        pair = F.struct("tid", "a")
        again = named.groupBy("name").agg(F.min(pair).alias("first"), F.max(pair).alias("last")).where("first != last")
        hot = named.join(again, "name")
        hot = hot.where(pair != F.col("first")) if keep == "first" else hot
        runs = runs.unionByName(hot.select("tid", "a", (F.col("a") + length).alias("b")))
        cut = cut.where("block is not null")
    found_runs = cut.repartition("block").sortWithinPartitions("block").mapInPandas(_repeats(length, keep), "tid bigint, a int, b int")
    return runs.unionByName(found_runs)


def merged(runs: DataFrame) -> DataFrame:
    """(tid, spans): the maximal runs, in order, as structs of a and b."""
    w = Window.partitionBy("tid").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.select("tid", "a", "b").distinct().withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    spans = opened.withColumn("span", F.sum("new").over(w)).groupBy("tid", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def repeated(docs: DataFrame, length: int = LENGTH, keep: str = "none") -> DataFrame:
    """(doc_id, text as bytes, spans): the runs of bytes to remove of every row."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("tid"), F.encode(text, "UTF-8").alias("raw"))
    copies = rows.where(F.octet_length("raw") >= length).groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    spans = materialize(merged(repeated_runs(docs, length, keep)), "spans")
    n_spans = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    out = rows.join(small(materialize(copies.select("tid", "first"), "copies")), "tid", "left").join(small(spans, n_spans), "tid", "left")
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.octet_length("raw").alias("b")))
    copied = F.col("first").isNotNull() & (F.lit(True) if keep == "none" else F.coalesce(F.col("doc_id") != F.col("first"), F.lit(False)))
    return out.select("doc_id", "raw", F.when(copied, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))).alias("spans"))


def remaining(raw, spans):
    """The bytes outside the spans."""
    parts = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.struct(F.coalesce(F.get(spans, i - 1)["b"], F.lit(0)).alias("a"), F.coalesce(F.get(spans, i)["a"], F.octet_length(raw)).alias("b")))
    return F.when(F.size(spans) == 0, raw).otherwise(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, F.substr(raw, p["a"] + 1, p["b"] - p["a"]))))


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    return found.select(
        "doc_id",
        F.octet_length("raw").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(remaining(F.col("raw"), F.col("spans")), 256).alias("kept_sha256"),
        (F.octet_length("raw") - removed).alias("n_kept"),
    )
