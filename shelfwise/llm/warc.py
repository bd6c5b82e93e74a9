"""WARC archives of pages, read back and indexed by an external merge.

Writing: each page becomes a WARC/1.1 record; of equal payloads the record of the smallest page_id is a response, others
are revisits that name it. Every file is a capture run, sorted by URL key and time before it is written. Reading: each
archive is parsed by its Content-Length fields and every response's digest is computed anew from the bytes read. The
runs' index entries, in run order, are then dealt by key range, and each range's runs are merged by a loser tree, so the
capture histories come out in global order of URL key, time and page.

Defined cases: a null html is an empty payload; payloads shorter than `least` are all responses; rows that repeat a
page_id and payload are all responses; a null page_id stays null and, where every page of a payload has none, all are
responses; control characters and spaces in a url are percent-encoded; a null url is written as about:blank; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, shared_dir, small

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of a file by the size of their payloads: below the bound so many, beyond all bounds one. No file passes some 128 MB but for one larger record.
FILES = ((16 << 10, 5000), (1 << 20, 120))
SCHEMA = "page_id bigint, url_key string, captured_at string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, run string, place bigint"


def base32_sha1(payload: Column) -> Column:
    """Base 32 of the SHA-1, from its hexadecimal digits: five of them make four letters."""
    five = lambda hexed, i: F.conv(F.substr(hexed, F.lit(i * 5 + 1), F.lit(5)), 16, 10).cast("int")
    letter = lambda v, j: F.substr(F.lit(BASE32), F.shiftright(v, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    four = lambda hexed, i: let(five(hexed, i), lambda v: F.concat(*[letter(v, j) for j in range(4)]))
    return let(F.sha1(payload), lambda hexed: F.concat(*[four(hexed, i) for i in range(8)]))


def url_key(url: Column) -> Column:
    """Host labels from the last, then the rest: example.org/a becomes org,example)/a."""
    rest = F.regexp_replace(url, "^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(url_key, captured_at, page_id, size, value): the text of each page's record without the two line ends after it."""
    html = F.coalesce(pages["html"], F.lit(""))
    base = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), html.alias("html"), base32_sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size"))
    several = base.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = small(materialize(several.select("digest", "first"), "payloads"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\\x00-\\x1F\\x7F]", "%0A"), " ", "%20")
    when = F.concat(F.replace(F.expr("cast(timestampadd(SECOND, coalesce(page_id, 0), TIMESTAMP_NTZ'2024-01-01 00:00:00') as string)"), F.lit(" "), F.lit("T")), F.lit("Z"))
    again = F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(False) | F.col("page_id").isNull())
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("page_id")),
        F.lit("\r\nWARC-Date: "),
        F.col("captured_at"),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("uri"),
        F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("first")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    out = base.join(first, "digest", "left").withColumns({"uri": uri, "captured_at": when, "again": again}).withColumn("block", block)
    return out.select(url_key(F.col("uri")).alias("url_key"), "captured_at", "page_id", "size", F.concat(head, F.col("block")).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes the archives: text files whose every record ends in two line ends, as the format asks. Records of like size share files."""
    runs = records(pages, least).sortWithinPartitions("url_key", "captured_at", "page_id")
    low, kinds = 0, []
    for high, count in (*FILES, (None, 1)):
        kinds.append(((F.col("size") >= low) & (F.lit(True) if high is None else F.col("size") < high), count))
        low = high
    sizes = pages.select(F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    held = sizes.agg(*[F.count_if(kind).alias(str(i)) for i, (kind, _) in enumerate(kinds)]).first()
    for i, (kind, count) in enumerate(kinds):
        if held[i] or not i:
            runs.where(kind).select("value").write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", count).text(path)


def parse(content: bytes):
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        yield fields, memoryview(content)[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _number(record_id: str) -> int | None:
    n = record_id[len("<urn:page:") : -1]
    return None if n == "none" else int(n)


def entries(content: bytes | memoryview, run: str) -> list[tuple]:
    """The index entries of one archive; raises if a response's bytes don't have the digest its record names."""
    out = []
    for place, (fields, block) in enumerate(parse(content)):
        raw = bytes(block)
        end = raw.index(b"\r\n\r\n") + 4
        size = int(raw[:end].rsplit(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            payload = raw[end:]
            if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{run}: record {place} is damaged")
        refers = _number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
        uri = fields["WARC-Target-URI"]
        out.append((_number(fields["WARC-Record-ID"]), uri, fields["WARC-Date"], size, digest, fields["WARC-Type"], refers, run, place))
    return out


class LoserTree:
    """Merges sorted sequences: each inner node holds the loser of its match, so the next item costs one walk to the root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.k = max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.losers[node]
            if held == -1:
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while (w := self.losers[0]) >= 0 and self.heads[w] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


def merge_runs(rows: list[tuple], key, run) -> list[tuple]:
    """Rows in any mix of runs, each run's rows in its order, merged. A run that came in parts makes several sequences."""
    runs: dict = {}
    for row in rows:
        own = runs.setdefault(run(row), [[]])
        if own[-1] and key(own[-1][-1]) > key(row):
            own.append([])
        own[-1].append(row)
    return list(LoserTree([part for parts in runs.values() for part in parts], key))


def read(spark, path: str, least_rows: int = 200_000) -> DataFrame:
    """The index of the archives at `path`, in global order of url_key, captured_at and page_id."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def scan(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(entries(content, name), columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    found = files.mapInPandas(scan, SCHEMA).withColumn("url_key", url_key(F.col("url_key")))
    index = materialize(found, "captures")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // least_rows))
    none = -(2**63)

    def merge(batches):
        rows = [r for pdf in batches for r in pdf.itertuples(index=False, name=None)]
        order = lambda r: (r[1], r[2], none if pd.isna(r[0]) else int(r[0]))
        yield pd.DataFrame(merge_runs(rows, order, lambda r: r[7]), columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.repartitionByRange(ranges, "url_key", "captured_at", "page_id").mapInPandas(merge, SCHEMA)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), f AS (
  SELECT x, min(page_id) AS first, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('{BASE32}', 1 + (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (5 * (3 - i % 4))::BIGINT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM p GROUP BY x
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (x)
"""
