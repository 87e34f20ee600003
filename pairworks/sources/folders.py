"""Folders as a table and as a stream: every task lists the folders it is given.

The driver lists the roots alone, and not even them where they are many; their subfolders are
dealt to tasks, which go through them folder by folder. A stream lists everything anew in each micro-batch, and
Spark's state store, which holds size and time of every file, lets through what was added or has
changed. So nothing depends on clocks: a file that shows up late with an old time is found too.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import translate
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, size bigint, modified timestamp"
STREAM_SCHEMA = f"{SCHEMA}, ts timestamp, initial boolean"
TASKS = 256
ROWS = 10_000  # files in a batch
_ARROW = [("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
_ARROW_STREAM = [*_ARROW, ("ts", pa.timestamp("us", "UTC")), ("initial", pa.bool_())]


@dataclass
class Folders(InputPartition):
    folders: list[tuple[str, str, bool]]  # root, path in its file system, whether folders below count too
    ts: int = 0
    initial: bool = False


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before such a path) of a qualified address."""
    scheme, authority, path = re.fullmatch(r"([A-Za-z][\w+.-]*):(?://([^/]*))?(/.*)?", root, re.S).groups()
    path = path or "/"
    if scheme == "file":
        return fs.LocalFileSystem(), path, "file:"
    if scheme in ("s3", "s3a"):
        return fs.FileSystem.from_uri(f"s3://{authority}")[0], authority + path.rstrip("/"), f"{scheme}://"
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0], path, f"{scheme}://{authority}"


def expanded(glob: str) -> list[str]:
    """A glob with {a,b} as globs without."""
    if not (found := re.search(r"\{([^{}]*)\}", glob)):
        return [glob]
    return [out for part in found[1].split(",") for out in expanded(glob[:found.start()] + part + glob[found.end():])]


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over as well."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What lies in a folder, nothing if it has gone meanwhile; a file stands for itself."""
    own = system.get_file_info(folder)
    if own.type == fs.FileType.File:
        return [own]
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [info for info in found if not _hidden(info.base_name)]


def _batch(rows: list[list], fields: list) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


class _Listing:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.roots: list[str] = json.loads(options["roots"])
        self.glob = options.get("glob")
        self.tasks = int(options.get("tasks", TASKS))

    def plan(self, ts: int = 0, initial: bool = False) -> list[InputPartition]:
        addresses = [(root, opened(root)[1]) for root in self.roots]
        if len(addresses) >= self.tasks:
            folders = [(root, path, True) for root, path in addresses]
        else:
            folders = [(root, path, False) for root, path in addresses]
            folders += [(root, info.path, True) for root, path in addresses
                        for info in _listed(opened(root)[0], path) if info.type == fs.FileType.Directory]
        return [Folders(folders[i::self.tasks], ts, initial) for i in range(min(self.tasks, len(folders)))]

    def files(self, partition: Folders) -> Iterator[list]:
        wanted = re.compile("|".join(map(translate, expanded(self.glob)))) if self.glob else None
        waiting = list(partition.folders)
        systems: dict[str, tuple] = {}
        while waiting:
            root, folder, deep = waiting.pop()
            if root not in systems:
                systems[root] = opened(root)
            system, _, prefix = systems[root]
            for info in _listed(system, folder):
                if info.type == fs.FileType.Directory:
                    if deep:
                        waiting.append((root, info.path, True))
                elif info.type == fs.FileType.File and (wanted is None or wanted.match(info.base_name)):
                    yield [prefix + info.path, info.base_name, info.size, (info.mtime_ns or 0) // 1000]

    def batches(self, partition: Folders, fields: list) -> Iterator[pa.RecordBatch]:
        more = [partition.ts, partition.initial][:len(fields) - len(_ARROW)]
        rows: list[list] = []
        for row in self.files(partition):
            rows.append(row + more)
            if len(rows) == ROWS:
                yield _batch(rows, fields)
                rows = []
        if rows:
            yield _batch(rows, fields)


class _Reader(_Listing, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.plan()

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.batches(partition, _ARROW)


class _StreamReader(_Listing, DataSourceStreamReader):
    """An offset is the time of a listing, in microseconds; a micro-batch lists everything."""

    _last = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self._last = max(self._last + 1, time.time_ns() // 1000)
        return {"at": self._last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.plan(max(start["at"] + 1, end["at"]), start["at"] == 0)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        return self.batches(partition, _ARROW_STREAM)


class FolderListing(DataSource):
    """Options: `roots` (a JSON list of qualified addresses), `glob` (of file names), `tasks`."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def qualified(spark: SparkSession, roots: str | list[str]) -> list[str]:
    """Full addresses of existing folders or files, by the file systems that Spark is set up for; globs are resolved."""
    out = []
    for root in [roots] if isinstance(roots, str) else roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not found:
            raise FileNotFoundError(root)
        out += [status.getPath().toString() for status in found]
    return out


def _options(spark: SparkSession, roots: str | list[str], glob: str | None) -> dict[str, str]:
    spark.dataSource.register(FolderListing)
    return {"roots": json.dumps(qualified(spark, roots)), **({"glob": glob} if glob else {})}


def list_folders(spark: SparkSession, roots: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, name, size, modified) of the files below some folders, as they are when the frame is computed.

    Hidden names (a leading dot or underscore) are left out. A folder is listed by one task, file
    by file: only its own listing is held, whatever lies below it.
    """
    return spark.read.format("folder_listing").options(**_options(spark, roots, glob)).schema(SCHEMA).load()


class Changed(StatefulProcessor):
    """Lets a file through when its size or time is not that of the listing before."""

    def __init__(self, ignore_initial: bool):
        self.ignore_initial = ignore_initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "size bigint, modified bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        before = self._seen.get() if self._seen.exists() else None
        for row in rows:
            now = (row["size"], row["_micros"])
            if before is not None and tuple(before) == now:
                continue
            self._seen.update(now)
            before = now
            if not (row["initial"] and self.ignore_initial):
                yield row

    def close(self) -> None:
        pass


def watch_sizes(spark: SparkSession, roots: str | list[str], glob: str | None = None, ignore_initial: bool = True) -> DataFrame:
    """A stream of (file, size, ts, path, modified): a row whenever a file is added or changes.

    `file` is its name and `ts` the time of the listing. What the first listing finds goes on only
    without `ignore_initial`. Files that vanish give no row, and are new only if they come back
    with another size or time; their state (two numbers) stays. Run it with a trigger
    of some seconds, as each micro-batch lists all folders. It needs the RocksDB state store.
    """
    listed = spark.readStream.format("folder_listing").options(**_options(spark, roots, glob)).schema(STREAM_SCHEMA).load()
    marked = listed.withColumn("_micros", F.unix_micros("modified"))
    new = marked.groupBy("path").transformWithState(Changed(ignore_initial), marked.schema, "Append", "None")
    return new.select(F.col("name").alias("file"), "size", "ts", "path", "modified")
