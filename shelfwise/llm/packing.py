"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents are measured in words plus one end mark; what exceeds the longest sequence is cut into full pieces. Pieces are
dealt at random to shards of about SHARD pieces, and each shard is packed in one task: pieces from the longest down, each
into the open bin with the least room that takes it; if none does, a bin of the least cost for each position that the
remaining pieces can fill is opened. That is done for every choice of permitted lengths that holds the longest; each bin
is then downsized to the shortest permitted length that holds its contents, and the cheapest outcome is kept. Shards
bound a task's memory, and cost at most a few half-filled bins each.

Defined cases: null and empty texts are one piece of length 1; repeated rows are packed each on its own; a null doc_id
stays null; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

LENGTHS = (512, 1024, 2048, 4096)
SHARD = 3000
#: Attention makes a sequence of n positions cost n + n * n / QUADRATIC.
QUADRATIC = 16384


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def pack(lengths: list[int], permitted: tuple[int, ...], opened: tuple[int, ...]) -> tuple[float, list[tuple[int, int]], list[int]]:
    """Best fit over pieces sorted from the longest, opening bins of `opened`: total cost, (bin, offset) of each piece, and the downsized bins."""
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    size: list[int] = []
    used: list[int] = []
    put = []
    rest = sum(lengths)
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            b = len(size)
            left = min((c for c in opened if c >= n), key=lambda c: (cost(c) / min(c, rest), c))
            size.append(left)
            used.append(0)
        put.append((b, used[b]))
        used[b] += n
        rest -= n
        left -= n
        if left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append(b)
    final = [min(c for c in permitted if c >= u) for u in used]
    return sum(map(cost, final)), put, final


def best_pack(lengths: list[int], permitted: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int]]:
    *less, longest = sorted(permitted)
    choices = [(*c, longest) for k in range(len(less) + 1) for c in combinations(less, k)]
    _, put, final = min((pack(lengths, tuple(sorted(permitted)), c) for c in choices), key=lambda x: x[0])
    return put, final


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(id, doc_id, piece, start, length): id names a piece of this run."""
    n = docs.select(docs["doc_id"].alias("doc_id"), (F.size(words(docs["text"])) + 1).alias("n"))
    cut = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / longest).cast("int"))).alias("piece"))
    start = F.col("piece") * longest
    return materialize(cut.select(F.monotonically_increasing_id().alias("id"), "doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("n") - start).alias("length")), "pieces")


def packed(docs: DataFrame, permitted: tuple[int, ...] = LENGTHS, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, piece, start and length in its document, bin, offset in the bin, and the bin's capacity."""
    cut = pieces(docs, max(permitted))
    shards = max(1, round(cut.count() / shard))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id"], ascending=[False, True], kind="stable")
        put, final = best_pack(pdf["length"].tolist(), permitted)
        pdf["bin"] = [int(pdf["shard"].iat[0]) * 2**32 + b for b, _ in put]
        pdf["offset"] = [o for _, o in put]
        pdf["capacity"] = [final[b] for b, _ in put]
        return pdf[["doc_id", "piece", "start", "length", "bin", "offset", "capacity"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fill, f"doc_id {kind}, piece int, start int, length int, bin bigint, offset int, capacity int")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
