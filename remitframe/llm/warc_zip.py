"""WARC records inside ZIP packages, written by tasks and read back by byte range.

A package is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip
member per WARC record, and ``indexes/index.cdxj``, one line per record with its place. A reader
parses the end record and the central directory (with their ZIP64 forms), finds where a member's
bytes start, reads the index, and then reads single records by range. Nothing is extracted, and a
task holds one record at a time.

Of records with equal payloads of at least ``min_payload`` bytes the one with the smallest page id
is a ``response``; the others are ``revisit`` records that name it and carry no payload. Packages go
to a folder all executors share (``pyarrow`` opens it by URI); a task writes under a name of its own
and renames, so a task that runs again replaces its package.

Defined results: a null payload is empty; a null url is written as ``about:blank``; a null page id
comes after all others, and only rows with null ids make such an id a response; rows that repeat the
smallest id with the same payload are all responses; an empty table gives an empty result. Columns
other than the named ones are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitframe.llm.common import scratch, send_by_value, text_of
from remitframe.session import checked_join, checkpointed

send_by_value(__name__)

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 20
# Packed records that one task reads back.
READ_BYTES = 32 << 20


class Member(NamedTuple):
    """A stored member: its name, size, and where its local header starts."""
    name: str
    size: int
    header: int
    stored: bool


# --- ZIP directories -----------------------------------------------------------------------------

def _read_at(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"the file ends before byte {at + size}")
    return data


def read_directory(file: BinaryIO) -> list[Member]:
    """Members by the central directory; ZIP64 fields replace full 16- and 32-bit ones."""
    length = file.seek(0, io.SEEK_END)
    tail_start = max(0, length - 22 - 0xFFFF)
    tail = _read_at(file, tail_start, length - tail_start)
    # The comment may hold the signature too: the right one's comment ends the file.
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from(
            "<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail_start + at - 20
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        sign, _, end64, _ = struct.unpack("<4sIQI", _read_at(file, locator, 20))
        if sign != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = _read_at(file, end64, 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", end, 32)
    directory, members, at = _read_at(file, start, size), [], 0
    for _ in range(count):
        sign, method, packed, plain, n_name, n_extra, n_comment, header = struct.unpack_from(
            "<4s6xH8xIIHHH8xI", directory, at)
        if sign != b"PK\1\2":
            raise ValueError("bad central directory entry")
        name = directory[at + 46:at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        packed, plain, header = _zip64(extra, packed, plain, header)
        members.append(Member(name, packed, header, method == 0 and packed == plain))
        at += 46 + n_name + n_extra + n_comment
    return members


def _zip64(extra: bytes, packed: int, plain: int, header: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            field = at + 4
            values = []
            for value in (plain, packed, header):
                if value == 0xFFFFFFFF:
                    value, = struct.unpack_from("<Q", extra, field)
                    field += 8
                values.append(value)
            plain, packed, header = values
        at += 4 + size
    return packed, plain, header


def data_start(file: BinaryIO, member: Member) -> int:
    """Where a member's bytes start; its local header may differ in length from the directory's."""
    header = _read_at(file, member.header, 30)
    if header[:4] != b"PK\3\4":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra


def stored_members(file: BinaryIO) -> dict[str, tuple[int, int]]:
    """Start and size of each stored member by name."""
    return {m.name: (data_start(file, m), m.size) for m in read_directory(file) if m.stored}


# --- WARC records --------------------------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value: control characters would end or split the line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id, url: str | None, payload: bytes, digest: str, revisits: bool,
                refers_to) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if revisits else http + payload
    head = [("WARC-Type", "revisit" if revisits else "response"),
            ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE),
            ("WARC-Target-URI", _clean(url) if url else "about:blank"),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block)))]
    if revisits:
        head[5:5] = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[:int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v for k, v in (
        line.split(": ", 1) for line in http_head.decode("latin-1").split("\r\n")[1:])}
    return warc, http, payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_of(identity: str) -> str | None:
    return identity.removeprefix("<urn:page:").removesuffix(">") or None


# --- packages ------------------------------------------------------------------------------------

def _opened(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def write_package(target: BinaryIO, records: Iterator[tuple[str, bytes]]) -> int:
    """Writes one package from (url, record) pairs and returns their number.

    The WARC member is written as it comes; only index lines are kept until it ends.
    """
    lines, at = [], 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        # The date is fixed: packages depend on their records only.
        entry = zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0))
        with package.open(entry, "w", force_zip64=True) as member:
            for url, record in records:
                packed = gzip.compress(record, 6, mtime=0)
                member.write(packed)
                lines.append(f"{_clean(url or 'about:blank')} " + json.dumps(
                    {"offset": at, "length": len(packed), "filename": "data.warc.gz"}))
                at += len(packed)
        with package.open(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "w") as member:
            for line in lines:
                member.write(line.encode("utf-8") + b"\n")
    return len(lines)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Writes all pages as packages below ``folder``: one row per package, ``path`` and ``records``."""
    payload = F.encode(text_of(payload_col), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= min_payload).groupBy("key").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(groups.where("n > 1").select("key", "first"))
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    planned = checked_join(rows, repeated, "key", "left").select(
        "page_id", "url", "payload", revisits.alias("revisits"), "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        path = f"{root}/part-{task.partitionId():06d}.wacz"
        own = f"{path}.{task.taskAttemptId()}"

        def records():
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, payload, again, first = (
                        batch.column(c)[k].as_py() for c in range(5))
                    yield url, warc_record(page_id, url, payload, sha1_base32(payload), again,
                                           first)
        with files.open_output_stream(own) as target:
            count = write_package(_Unseekable(target), records())
        files.move(own, path)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([count], pa.int64())],
            names=["path", "records"])
    return planned.mapInArrow(write, "path string, records long")


class _Unseekable:
    """A stream that ``zipfile`` only writes to; sizes follow the data, as in a pipe."""

    def __init__(self, target):
        self.target = target

    def write(self, data) -> int:
        self.target.write(data)
        return len(data)

    def flush(self) -> None:
        self.target.flush()


def read_index(packages: DataFrame) -> DataFrame:
    """Places of all records: ``path``, ``at`` (a byte of the package) and ``size``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = _opened(path)
                with files.open_input_file(inner) as file:
                    members = stored_members(file)
                    data, _ = members[DATA]
                    start, size = members[INDEX]
                    for lines in _lines(file, start, size):
                        places = [json.loads(b"{" + line.rsplit(b" {", 1)[1])
                                  for line in lines]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([path] * len(places), pa.string()),
                            pa.array([data + p["offset"] for p in places], pa.int64()),
                            pa.array([p["length"] for p in places], pa.int64())],
                            names=["path", "at", "size"])
    return packages.select("path").mapInArrow(read, "path string, at long, size long")


def _lines(file: BinaryIO, start: int, size: int) -> Iterator[list[bytes]]:
    """Lines of a byte range, a block at a time."""
    left, end = b"", start + size
    while start < end:
        block = left + _read_at(file, start, min(_BLOCK, end - start))
        start = min(start + _BLOCK, end)
        *lines, left = block.split(b"\n")
        yield lines


def read_records(places: DataFrame) -> DataFrame:
    """Records by range: ``page_id`` (text), ``url``, ``record_type``, ``refers_to`` (text),
    ``payload_digest``, ``payload_bytes`` and ``payload`` (null for revisits).

    The payload of each response is held against its digest.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for k in range(batch.num_rows):
                here, at, size = (batch.column(c)[k].as_py() for c in range(3))
                if here != path:
                    if file:
                        file.close()
                    files, inner = _opened(here)
                    path, file = here, files.open_input_file(inner)
                warc, http, payload = parse_record(zlib.decompress(
                    _read_at(file, at, size), wbits=31))
                revisit = warc["warc-type"] == "revisit"
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and sha1_base32(payload) != digest:
                    raise ValueError(f"{here}: the payload at byte {at} does not fit its digest")
                row = (_page_of(warc["warc-record-id"]), warc["warc-target-uri"],
                       warc["warc-type"],
                       _page_of(warc["warc-refers-to"]) if revisit else None, digest,
                       int(http["content-length"]), None if revisit else payload)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                held += len(payload)
                if held > 8 * _BLOCK:
                    yield _record_batch(out)
                    out, held = [[] for _ in range(7)], 0
            if out[0]:
                yield _record_batch(out)
        if file:
            file.close()
    return places.mapInArrow(read, "page_id string, url string, record_type string, "
                             "refers_to string, payload_digest string, payload_bytes long, "
                             "payload binary")


def _record_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
        names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes",
               "payload"])


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id",
               url_col: str = "url", payload_col: str = "html",
               min_payload: int = 0) -> DataFrame:
    """Writes all pages as packages and reads every record back, ids in their own type."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "packages")
    packages = checkpointed(write_packages(pages, _uri(spark, folder), id_col, url_col,
                                           payload_col, min_payload))
    # A place is few bytes but stands for a whole record: dealt out by what will be read.
    places = checkpointed(read_index(packages))
    size = places.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-size // READ_BYTES),
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = places.repartitionByRange(tasks, "path", "at").sortWithinPartitions("path", "at")
    id_type = pages.schema[id_col].dataType
    return read_records(places).withColumn("page_id", F.col("page_id").cast(id_type)).withColumn(
        "refers_to", F.col("refers_to").cast(id_type))


def _uri(spark, folder: str) -> str:
    """The folder with its scheme, as Hadoop would resolve it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    made = path.getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return made.replace("file:/", "file:///", 1) if made.startswith("file:/") and \
        not made.startswith("file://") else made
