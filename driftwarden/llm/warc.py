"""WARC archives as a Spark data source, written and read.

Writing: every record is a gzip member of its own, whose extra field holds its length.
Files roll at a size, carry names of their own for every attempt, and count only once
the driver has listed them in a manifest at commit, so that lost or repeated tasks leave
nothing that is read.

Reading: the driver plans partitions from file sizes. Filters on record type and other
header columns are pushed down. A record's headers are parsed first; the payload of a
record that the filters reject, or any payload if the schema has no payload column, is
skipped by the member's length without being inflated. Archives of other writers, whose
members have no length field or which are not compressed, are read as well.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
    IsNotNull, StringStartsWith, WriterCommitMessage,
)

from ..session import scratch_path
from .common import bounded_batches

SCHEMA = (
    "record_id string, type string, target_uri string, date string, page_id long, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary"
)
HEADERS = {
    "record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri",
    "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
    "page_id": "page-id",
}
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
ROWS_OUT = 256
BYTES_OUT = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "_manifest-"


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if ``refers_to`` names the page that has the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with its own length in the extra field "sl"."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    total = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Committed(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, payload, sha (hexadecimal SHA-1) and refers_to."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Committed:
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                sha = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                data = member(record(row["page_id"], row["url"], row["payload"] or b"", sha, row["refers_to"]))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Committed(files)

    def commit(self, messages: list) -> None:
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        names = [n for m in messages if m for n in m.files]
        with system.open_output_stream(f"{folder}/{_MANIFEST}{uuid.uuid4().hex}") as out:
            out.write("\n".join(names).encode())

    def abort(self, messages: list) -> None:
        system, folder = open_folder(self.path)
        for name in (n for m in messages if m for n in m.files):
            system.delete_file(f"{folder}/{name}")


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _headers(text: bytes) -> dict[str, str]:
    found, name = {}, None
    for line in text.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in " \t" and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class _Source:
    """Sequential bytes of one archive with a look ahead."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def fill(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.file.read(max(n - len(self.buffer), 1 << 16))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        data = self.fill(n)
        self.buffer = self.buffer[n:]
        return data

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""


def _member_length(head: bytes) -> int | None:
    if len(head) < 24 or not head[3] & 4 or head[12:14] != b"sl":
        return None
    return struct.unpack("<I", head[16:20])[0]


def records(file, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """``(headers, block)`` of every record for which ``wanted(headers)`` is "all" or
    "head"; the block is None for "head". Others are passed over."""
    source = _Source(file)
    while head := source.fill(24):
        if head[:2] == b"\x1f\x8b":
            length = _member_length(head)
            data, whole = b"", False
            unpack = zlib.decompressobj(31)
            used = 0
            while b"\r\n\r\n" not in data and not unpack.eof:
                at = min(used + 4096, length) if length else used + 4096
                piece = source.fill(at)[used:at]
                if not piece:
                    break
                data += unpack.decompress(piece)
                used += len(piece)
            headers = _headers(data.partition(b"\r\n\r\n")[0])
            want = wanted(headers)
            if want != "all" and length:
                source.skip(length)
            else:
                parts = [data]
                while not unpack.eof:
                    at = max(used + 1, length or used + (1 << 16))
                    piece = source.fill(at)[used:at]
                    if not piece:
                        break
                    parts.append(unpack.decompress(piece))
                    used += len(piece)
                data, whole = b"".join(parts), True
                source.skip(length or used - len(unpack.unused_data))
            if not headers:
                continue
            body = data.partition(b"\r\n\r\n")[2][: int(headers.get("content-length", 0))] if whole else None
        else:
            if not head.strip():
                source.take(len(head) - len(head.lstrip()) or len(head))
                continue
            if head.lstrip() != head:
                source.take(len(head) - len(head.lstrip()))
            n = 1 << 12
            while b"\r\n\r\n" not in source.fill(n) and len(source.fill(n)) == n:
                n *= 2
            text = source.fill(n).partition(b"\r\n\r\n")[0]
            source.take(len(text) + 4)
            headers = _headers(text)
            want = wanted(headers)
            size = int(headers.get("content-length", 0))
            body = source.take(size) if want == "all" else source.skip(size)
        if want:
            yield headers, body if want == "all" else None


def value(column: str, headers: dict[str, str]):
    """What a header column holds."""
    found = headers.get(HEADERS[column])
    if found is None:
        return None
    if column == "page_id":
        return int(found)
    return found.removeprefix("sha1:") if column == "payload_digest" else found


def split_http(headers: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    if not headers.get("content-type", "").startswith("application/http"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    return _headers(head), payload


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, verify: bool):
        self.path, self.columns, self.verify = path, list(schema.names), verify
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes tests of header columns; others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", [f.value]))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", list(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f

    def _passes(self, headers: dict[str, str]) -> bool:
        for column, kind, want in self.tests:
            found = value(column, headers)
            if found is None or kind == "in" and found not in want or kind == "starts" and not found.startswith(want):
                return False
        return True

    def partitions(self) -> list[Files]:
        system, folder = open_folder(self.path)
        infos = system.get_file_info(pa.fs.FileSelector(folder, recursive=True))
        files = {i.path: i.size for i in infos if i.is_file}
        lists = [p for p in files if p.rpartition("/")[2].startswith(_MANIFEST)]
        if lists:
            names = [n for p in lists for n in system.open_input_stream(p).read().decode().split("\n") if n]
            chosen = [f"{folder}/{n}" for n in names]
        else:
            chosen = [p for p in files if p.endswith((".warc", ".warc.gz"))]
        parts, size = [Files([])], 0
        for path in sorted(chosen):
            if size + files[path] > PARTITION_BYTES and parts[-1].names:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(path)
            size += files[path]
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.path)
        need = "all" if self.verify or {"payload", "payload_bytes"} & {*self.columns} else "head"
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(name) as file:
                for headers, block in records(file, lambda h: need if self._passes(h) else None):
                    rows.append(self._row(headers, block))
                    size += len(block or b"")
                    if len(rows) >= ROWS_OUT or size > BYTES_OUT:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, headers: dict[str, str], block: bytes | None) -> dict:
        row = {c: value(c, headers) for c in HEADERS}
        row["refers_to"] = headers.get("refers-to-page-id", row["refers_to"])
        if block is not None:
            http, payload = split_http(headers, block)
            row["payload"] = payload
            row["payload_bytes"] = int(http.get("content-length", len(payload)))
            if self.verify and row["type"] == "response":
                row["payload_bytes"] = len(payload)
                if digest(payload) != row["payload_digest"]:
                    raise ValueError(f"{row['record_id']}: the payload differs from its digest")
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.columns], self.columns
        )


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    bounded_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """A record for each row of ``pages`` (page_id, url, html; null html is empty). Of
    pages with equal payloads of at least ``least_bytes``, the one with the smallest
    page_id is the response and the others revisit it. Rows without page_id, and equal
    rows, are responses."""
    register(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    first = (
        rows.where(F.length("payload") >= least_bytes).groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last").select("sha", "first")
    )
    rows.join(first, "sha", "left").selectExpr(
        "page_id", "url", "payload", "sha",
        f"case when length(payload) >= {least_bytes} and first < page_id then first end as refers_to",
    ).write.format("warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """Records below ``path``; ``columns`` is the part of ``SCHEMA`` that is needed. With
    ``verify`` every response's payload is hashed and compared with its header."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("path", path).option("verify", str(verify).lower()).load()


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_pages(pages, path)
    columns = "page_id long, type string, payload_digest string, payload_bytes long, refers_to string"
    return read_archives(spark, path, columns, verify=True).where(
        F.col("type").isin("response", "revisit")
    ).selectExpr(
        "page_id", "payload_bytes", "payload_digest", "type as record_type",
        "cast(refers_to as long) as refers_to",
    )
