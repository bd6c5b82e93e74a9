"""What a service hands out page by page and takes back request by request, as Spark data sources over stored files.

`stored_pages` reads <path>/<collection>/<page>.json, each {"content": [...], "last": bool}: a task reads a range of pages,
options for collections and pages prune the files before any is opened, and each row carries what the stop rules need. (Filters
are not pushed: this version of Spark keeps pushed filters with the loaded table, so a later read without them would miss rows.)
`outbox` writes requests: tasks write files of their own into a staging folder, and only the commit of the whole job moves the
files that succeeded tasks name into place; an aborted job leaves nothing. Files go through pyarrow's file systems, so a
path may be local or in any store that they know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .pages import CAP, read_rows


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class StoredPages(DataSource):
    """Options: path, pages_per_task (8), collections (a JSON list), first and last (pages)."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "collection string, page int, size int, last boolean, item string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


@dataclass
class Pages(InputPartition):
    collection: str
    files: list[tuple[int, str]]


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.per_task = options["path"], int(options.get("pages_per_task", 8))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 2**31))
        self.only = set(json.loads(options.get("collections", "[]")))

    def partitions(self) -> list[Pages]:
        """Files are found by their names; those outside of what the options ask for are never opened."""
        store, root = opened(self.path)
        held: dict[str, list[tuple[int, str]]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            stem, _, kind = info.base_name.rpartition(".")
            collection = info.path.rsplit("/", 2)[1]
            if info.type == fs.FileType.File and kind == "json" and stem.isdigit() and self.first <= int(stem) <= self.last and (not self.only or collection in self.only):
                held.setdefault(collection, []).append((int(stem), info.path))
        out = []
        for collection, files in sorted(held.items()):
            files.sort()
            out += [Pages(collection, files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for page, path in partition.files:
            with store.open_input_stream(path) as f:
                body = json.loads(f.read())
            content, last = body.get("content") or [], bool(body.get("last"))
            for item in content or [None]:  # an empty page is a row of its own: it may stop a reader
                yield partition.collection, page, len(content), last, None if item is None else json.dumps(item, sort_keys=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredPages)
    spark.dataSource.register(Outbox)


def stored_pages(spark: SparkSession, path: str, per_task: int = 8, collections: tuple[str, ...] = (), first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of the pages `first` to `last` of the named collections (of all, if none is named)."""
    register(spark)
    reader = spark.read.format("stored_pages").option("path", path).option("pages_per_task", per_task).option("collections", json.dumps(list(collections))).option("first", first)
    return (reader if last is None else reader.option("last", last)).load()


def read_until(pages: DataFrame, stop: Column, inclusive: bool = True, cap: int = CAP) -> DataFrame:
    """(collection, page, item): the items of each collection up to the page at which `stop` (over page, size, last) holds, or the cap."""
    keyed = pages.withColumnRenamed("collection", "key")
    heads = keyed.select("key", "page", "size", "last").distinct()
    return read_rows(keyed.where("item is not null").select("key", "page", "item"), heads, stop, inclusive, cap).withColumnRenamed("key", "collection")


def store_pages(rows: DataFrame, path: str, size: int) -> None:
    """Stores (collection, n, item) as pages of `size` items, in the order of n (from 0); a task writes whole pages."""
    pages = rows.groupBy("collection", F.expr(f"n div {size}").cast("int").alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("content"))
    ends = rows.groupBy("collection").agg(F.expr(f"max(n) div {size}").cast("int").alias("end"))

    def write(part: Iterator[Row]) -> None:
        store, root = opened(path)
        for r in part:
            store.create_dir(f"{root}/{r.collection}", recursive=True)
            with store.open_output_stream(f"{root}/{r.collection}/{r.page}.json") as f:
                f.write(json.dumps({"content": [json.loads(x) for x in r.content], "last": r.page == r.end}).encode())

    pages.join(ends, "collection").foreachPartition(write)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class Outbox(DataSource):
    """Requests (id, op, key, payload) as files of JSON lines. Options: path, job (a name: a job that was committed is not written again)."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "id string, op string, key string, payload string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OutboxWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


class OutboxWriter(DataSourceWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path.rstrip("/"), job

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        store, root = opened(self.path)
        return store, f"{root}/_staged-{self.job}", f"{root}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """Each attempt of a task has a file of its own, so a retried or a doubled task spoils nothing."""
        store, staged, _ = self._folders()
        store.create_dir(staged, recursive=True)
        name, n = f"{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(f"{staged}/{name}") as f:
            for row in iterator:
                f.write((json.dumps(row.asDict(), sort_keys=True) + "\n").encode())
                n += 1
        return Written([name] if n else [], n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staged, final = self._folders()
        if store.get_file_info(f"{final}/_done").type == fs.FileType.NotFound:
            store.create_dir(final, recursive=True)
            for m in messages:
                for name in m.files if m else []:
                    store.move(f"{staged}/{name}", f"{final}/{name}")
            with store.open_output_stream(f"{final}/_done") as f:
                f.write(str(sum(m.rows for m in messages if m)).encode())
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staged, _ = self._folders()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


def send(actions: DataFrame, path: str, job: str) -> None:
    """Writes the requests of `actions` (op, key, payload) to the outbox once a job; a request is named by its content."""
    register(actions.sparkSession)
    named = actions.select(F.sha2(F.concat_ws("\x1f", "op", "key", F.coalesce("payload", F.lit(""))), 256).alias("id"), "op", "key", "payload").dropDuplicates(["id"])
    named.write.format("outbox").option("path", path).option("job", job).mode("append").save()


def sent(spark: SparkSession, path: str, job: str = "*") -> DataFrame:
    """The requests of committed jobs."""
    return spark.read.schema("id string, op string, key string, payload string").json(f"{path.rstrip('/')}/{job}/*.json")
