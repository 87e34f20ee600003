"""WARC archives as a PySpark data source, for writing and reading.

Reading plans partitions of whole files, takes equality, IN and null conditions on the type and
the header columns from Spark, parses a record's header first and jumps over the block of every
record that the conditions rule out, or whose payload is not asked for. Archives are compressed
record by record (.warc.gz); each member tells its length ahead, so that the jump inflates nothing
behind the header. Archives made elsewhere are read too, compressed or not.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
    IsNotNull, IsNull, WriterCommitMessage)

from pairworks.llm.common import materialise, new_path

SCHEMA = ("record_type string, record_id string, target_uri string, page_id long, refers_to long, "
          "payload_digest string, payload_bytes long, payload binary")
WRITE_SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_digest string, payload binary"
LEAST_REVISIT_BYTES = 100
_LIST = "_files-"  # a list of files per finished write
# Names of header fields.
_TYPE, _ID, _URI, _DIGEST, _LENGTH = "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Length"
_SHA256 = "sha256:"
_PAGE, _REFERS, _BYTES = "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# Columns that the header alone decides.
_HEADER_COLUMNS = {"record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes"}


def _open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(row: dict, date: str) -> bytes:
    """One record: header fields, block, and the two empty lines."""
    payload = row["payload"] or b""
    head = [("WARC-Type", row["record_type"]), (_ID, _record_id(row["page_id"], row["payload_digest"])), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append((_URI, quote(row["target_uri"], safe="%:/?#[]@!$&'()*+,;=~-._")))
    if row["page_id"] is not None:
        head.append((_PAGE, row["page_id"]))
    head += [(_DIGEST, _SHA256 + row["payload_digest"]), (_BYTES, len(payload))]
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"], row["payload_digest"])),
                 (_REFERS, row["refers_to"])]
        block = _HTTP
    else:
        block = _HTTP + payload
    head += [("Content-Type", "application/http;msgtype=response"), (_LENGTH, len(block))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


# A gzip member's head with an extra field, and the name of the field with its length, packed and not.
_MEMBER, _SKIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"sl"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own length, and that of its data, in its head."""
    packer = zlib.compressobj(1, wbits=-15)
    body = packer.compress(data) + packer.flush()
    size = len(_MEMBER) + 14 + len(body) + 8
    lengths = struct.pack("<II", size, len(data)) if max(size, len(data)) < 1 << 32 else bytes(8)
    return (_MEMBER + struct.pack("<H", 12) + _SKIP + struct.pack("<H", 8) + lengths + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Every task writes files of its own name. A finished write adds a list of its files, which is what readers
    go by; one that overwrites takes the lists before it away after that, and then their files."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.date = options["path"], options.get("date", "2000-01-01T00:00:00Z")
        self.most = int(options.get("file_bytes", 256 << 20))
        self.compress = options.get("compress", "true") == "true"
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open_folder(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    for row in batch.slice(start, 256).to_pylist():
                        if out is None or size >= self.most:
                            if out is not None:
                                out.close()
                                files[-1] = (files[-1][0], size)
                            files.append((uuid.uuid4().hex + (".warc.gz" if self.compress else ".warc"), 0))
                            out, size = system.open_output_stream(f"{folder}/{files[-1][0]}", compression=None, buffer_size=1 << 20), 0
                        data = record(row, self.date)
                        data = member(data) if self.compress else data
                        out.write(data)
                        size += len(data)
        finally:
            if out is not None:
                out.close()
                files[-1] = (files[-1][0], size)
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, folder = _open_folder(self.path)
        system.create_dir(folder, recursive=True)
        old = _lists(system, folder) if self.overwrite else []
        gone = [name for listed in old for name, _ in _read_list(system, listed)]
        with system.open_output_stream(f"{folder}/{_LIST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(sorted(f for m in messages if m is not None for f in m.files)).encode())
        for listed in old:
            system.delete_file(listed)
        for name in gone:
            system.delete_file(f"{folder}/{name}")

    def abort(self, messages: list[Written]) -> None:
        """No list names the files of a write that failed; those of its finished tasks go."""
        system, folder = _open_folder(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else ():
                system.delete_file(f"{folder}/{name}")


def _lists(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(_LIST))


def _read_list(system: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    with system.open_input_stream(path) as listed:
        return [(name, size) for name, size in json.loads(listed.read())]


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true") == "true"
        self.most = int(options.get("partition_bytes", 32 << 20))
        self.wanted: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what the header decides; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name not in _HEADER_COLUMNS or not isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull):
                yield f
            elif isinstance(f, IsNull) or isinstance(f, EqualNullSafe) and f.value is None:
                self.wanted.append((name, (None,)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted.append((name, tuple(v for v in values if v is not None)))

    def partitions(self) -> list[Files]:
        """Files of finished writes, put together up to `partition_bytes`; in a folder without such lists, made
        elsewhere, all files that are named like archives."""
        system, folder = _open_folder(self.path)
        lists = _lists(system, folder)
        files = sorted(f for path in lists for f in _read_list(system, path))
        if not lists:
            found = system.get_file_info(fs.FileSelector(folder))
            files = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))
        out, size = [], 0
        for name, n in files:
            if not out or size + n > self.most:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def _rejected(self, row: dict) -> bool:
        return any(row[name] is None if values is None else row[name] not in values for name, values in self.wanted)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = _open_folder(self.path)
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(f"{folder}/{name}") as file:
                for row in self._records(file):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, file: pa.NativeFile) -> Iterator[dict]:
        window = Window(file)
        at, kind = 0, Member if window.get(0, 2) == b"\x1f\x8b" else Plain
        while at < window.end:
            source = kind(window, at)
            head = b""
            while (stop := head.find(b"\r\n\r\n")) < 0:
                more = source.read(2048 + len(head))
                if not more:
                    raise ValueError(f"{self.path}: no header at byte {at}")
                head += more
            first, *lines = head[:stop].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"{self.path}: no record at byte {at}")
            fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
            size = stop + 4 + int(fields[_LENGTH.lower()])
            row = _row(fields)
            if not self._rejected(row):
                if self.with_payload and row["record_type"] != "revisit":
                    self._take_payload(row, (head + source.read(max(size - len(head), 0)))[stop + 4:size], fields)
                yield row
            at = source.end(size)

    def _take_payload(self, row: dict, block: bytes, fields: dict[str, str]) -> None:
        http = fields.get("content-type", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        row["payload"], row["payload_bytes"] = payload, len(payload)
        digest = fields.get(_DIGEST.lower(), "")
        if digest.startswith(_SHA256) and hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
            raise ValueError(f"{self.path}: payload of {row['record_id']} does not have its digest")


def _row(fields: dict[str, str]) -> dict:
    """A record's columns by its header alone; what it does not tell is null."""
    def number(name: str) -> int | None:
        return int(fields[name.lower()]) if name.lower() in fields else None

    digest = fields.get(_DIGEST.lower())
    return {"record_type": fields.get(_TYPE.lower()), "record_id": fields.get(_ID.lower()), "target_uri": fields.get(_URI.lower()),
            "page_id": number(_PAGE), "refers_to": number(_REFERS),
            "payload_digest": digest.removeprefix(_SHA256) if digest is not None else None, "payload_bytes": number(_BYTES), "payload": None}


class Window:
    """Bytes of a file by way of a buffer, so that headers cost no read each."""

    def __init__(self, file: pa.NativeFile):
        self._file, self.end, self._data, self._at = file, file.size(), b"", 0

    def get(self, start: int, n: int) -> bytes:
        n = max(min(n, self.end - start), 0)
        if start < self._at or start + n > self._at + len(self._data):
            self._file.seek(start)
            self._data, self._at = self._file.read(max(n, 1 << 18)), start
        return self._data[start - self._at:start - self._at + n]


class Plain:
    """A record that is not compressed."""

    def __init__(self, window: Window, at: int):
        self._window, self._start, self._at = window, at, at

    def read(self, n: int) -> bytes:
        data = self._window.get(self._at, n)
        self._at += len(data)
        return data

    def end(self, size: int) -> int:
        """Where the next record starts: behind `size` bytes and two line ends."""
        return self._start + size + 4


class Member:
    """A record that is a gzip member."""

    def __init__(self, window: Window, at: int):
        self._window, self._start, self._at = window, at, at
        self._inflate = zlib.decompressobj(wbits=31)

    def read(self, n: int) -> bytes:
        out = []
        while n and not self._inflate.eof:
            packed = self._inflate.unconsumed_tail
            if not packed:
                packed = self._window.get(self._at, 1 << 16)
                self._at += len(packed)
            out.append(self._inflate.decompress(packed, n))
            n -= len(out[-1])
            if not packed and not out[-1] and not self._inflate.eof:
                raise ValueError(f"the member at byte {self._start} is cut off")
        return b"".join(out)

    def end(self, size: int) -> int:
        """Where the next member starts: as this one tells, or where inflating it ends."""
        head = self._window.get(self._start, 24)
        if head[3] & 4 and head[12:16] == _SKIP + b"\x08\0" and (told := struct.unpack("<I", head[16:20])[0]):
            return self._start + told
        while not self._inflate.eof:
            self.read(1 << 20)
        return self._at - len(self._inflate.unused_data)


class WarcDataSource(DataSource):
    """format("warc"): option path; reading, payload=false leaves all payloads undecoded; writing, compress=false
    gives plain .warc files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known and lets Spark hand conditions to Python sources."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows to write: one per page, the smallest id of equal payloads a response, the others revisits.

    A null html is an empty payload. Payloads of less than LEAST_REVISIT_BYTES bytes are all
    responses. Rows that share the smallest id are all responses; a null id revisits any page
    with an id, and is a response if there is none. Only (digest, id) pairs are shuffled to find
    what repeats; the payloads are only if more of them repeat than may be broadcast.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    digest = F.sha2(payload, 256)
    first = pages.select(digest.alias("payload_digest"), F.col(id_col).cast("long").alias("id"), F.length(payload).alias("n")).filter(
        F.col("n") >= LEAST_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    repeated = materialise(first.filter("copies > 1 AND first IS NOT NULL").select("payload_digest", "first"), "warc-repeated")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
                        payload.alias("payload"), digest.alias("payload_digest"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "target_uri", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"), "payload_digest", "payload")


def write_archives(rows: DataFrame, path: str, mode: str = "append", compress: bool = True) -> None:
    """Rows made by `records`, written as WARC files under `path`, a folder that all executors reach."""
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).option("compress", str(compress).lower()).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records under `path`, of all writes to it that finished, or of any archives if none was made here.

    Conditions on header columns are checked before blocks are read. Records of any type come; what their
    headers do not tell is null. A payload is the body of an HTTP message or else the whole block; a revisit has none.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive of the pages and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of responses, size and digest are worked out from the payload that was read. Revisits are
    read by their headers alone. An empty table gives an empty one; other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(records(pages), path)
    whole = read_archives(spark, path).filter("record_type = 'response'").select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", "refers_to")
    heads = read_archives(spark, path, payload=False).filter("record_type = 'revisit'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return whole.unionByName(heads)
