"""Web archives: legacy ARC files are read by their own headers and written anew as WARC.

Archives are real files, a gzip member per record.  Tasks write them to the
shared folder under names of their own and hand back a table of what they
wrote; only files that this table names are read later, so what a lost or
repeated task left behind is never seen.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from itertools import batched
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import written

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Slim rows that a task gathers before it hands them on.
ROWS_AT_ONCE = 5_000
#: Equal payloads of fewer bytes are all kept as responses.
REVISIT_BYTES = 1000

#: Fixed values of the formats: field names of the two ARC versions, WARC profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A URL or content type may hold blanks in old files: the other fields decide where they end.
ARC_LINE = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<type>\S.*?) (?P<length>\d+)$"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{8,17}) (?P<type>\S.*?) (?P<code>\d+|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<name>\S+) (?P<length>\d+)$"),
}
PAGE_ID = "X-Page-Id"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def unpacked(path: str) -> Iterator[BinaryIO]:
    """The bytes of an archive as a stream; gzip members are joined."""
    system, name = opened(path)
    with io.BufferedReader(system.open_input_file(name), 1 << 20) as stream:
        yield gzip.GzipFile(fileobj=stream) if stream.peek(2)[:2] == b"\x1f\x8b" else stream


class Archives:
    """Writes the records of one task to archives that end at about ``most`` compressed bytes."""

    def __init__(self, folder: str, ending: str, first: Callable[[str], bytes], most: int):
        self.folder, self.ending, self.first, self.most = folder, ending, first, most
        self.system, self.root = opened(folder)
        self.system.create_dir(self.root, recursive=True)
        self.file, self.name, self.size, self.done = None, "", 0, []

    def place(self) -> tuple[str, int]:
        """Archive name and offset that the next record gets."""
        if self.file is None or self.size >= self.most:
            self.close()
            self.name, self.size = f"{uuid.uuid4().hex}{self.ending}", 0
            self.file = self.system.open_output_stream(f"{self.root}/{self.name}", compression=None, buffer_size=1 << 20)
            self.put(self.first(self.name))
        return self.name, self.size

    def add(self, record: bytes) -> None:
        self.place()
        self.put(record)

    def put(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.file.write(member)
        self.size += len(member)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append({"archive": f"{self.folder}/{self.name}", "bytes": self.size})
        self.file = None


# --- ARC ------------------------------------------------------------------

def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n".encode()
    rest = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} {rest}\n".encode() + body + b"\n"


def arc_record(name: str, offset: int, version: int, url: str, date: str, block: bytes) -> bytes:
    rest = f"text/html {len(block)}" if version == 1 else f"text/html 200 - - {offset} {name} {len(block)}"
    return f"{url} 0.0.0.0 {date} {rest}\n".encode() + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    known = "" if page_id is None else f"{PAGE_ID}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_url(url: str | None) -> str:
    """A URL that fits a header line: blanks and control characters escaped, null as a name without a host."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "http://unknown.invalid/"


def write_arc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20010101000000",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Pages as legacy archives, one record each; the table of written archives (``archive, bytes``).

    Every second task writes version 1, the others version 2.  A null html is an empty payload; a null id
    leaves its header line out.
    """
    slim = pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")))
    schema = StructType.fromDDL("archive string, bytes bigint")
    target = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        out = Archives(folder, ".arc.gz", lambda name: arc_head(name, version, date), archive_bytes)
        for batch in batches:
            for page, url, html in zip(*batch.columns, strict=True):
                block = http_block(page.as_py(), html.as_py().encode())
                out.add(arc_record(*out.place(), version, arc_url(url.as_py()), date, block))
        out.close()
        yield pa.RecordBatch.from_pylist(out.done, schema=target)

    return written(slim.mapInArrow(write, schema), "arc-files")


def arc_records(stream: BinaryIO) -> Iterator[dict]:
    """The records of an ARC file in turn: ``url, ip, date, type, block, cut``.

    The first record is the version block; it says which header lines follow.
    A block ends where its declared length does, whatever it holds; ``cut``
    is true where the file ends before.  Lines between records that are no header are passed over.
    """
    version = 1
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if line.startswith(b"filedesc:"):
            # its own header line has the fields of the version it declares
            head = ARC_LINE[2].match(line) or ARC_LINE[1].match(line)
        else:
            head = ARC_LINE[version].match(line)
        if not head:
            continue
        size = int(head["length"])
        block = stream.read(size)
        found = {k: head[k].decode("utf-8", "replace") for k in ("url", "ip", "date", "type")}
        if line.startswith(b"filedesc:"):
            version = 2 if block.lstrip()[:1] == b"2" else 1
        yield found | {"block": block, "cut": len(block) < size}


# --- WARC -----------------------------------------------------------------

def warc_date(date: str) -> str:
    """An ARC date of 8 to 17 digits as an ISO instant; what it lacks counts as its least value."""
    d = date[:14] + "00000101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, number: int) -> str:
    """The same for every conversion of the same archive."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive.rsplit("/", 1)[-1]}#{number}')}"


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, ident: str, date: str, block: bytes, **more: str | None) -> bytes:
    """Bytes of a record; ``more`` are further header lines, underscores as hyphens, None left out."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{ident}>", "WARC-Date": date, "WARC-Block-Digest": digest32(block)}
    lines |= {k.replace("_", "-"): v for k, v in more.items() if v is not None} | {"Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header lines (names in lower case) and block of each record, by declared length."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP response; bytes that are none are all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    end = found.end() if found else len(block)
    return block[:end], block[end:]


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def page_of(head: bytes) -> int | None:
    value = http_field(head, PAGE_ID)
    return int(value) if value and re.fullmatch(r"-?\d+", value) else None


def each_archive(archives: DataFrame) -> DataFrame:
    """One archive a task: files are of bounded size, and so are the tasks."""
    return archives.repartitionByRange(max(1, archives.count()), "archive")


ARC_INDEX = "archive string, number bigint, page_id bigint, payload_bytes bigint, digest binary, record string, url string, date string, cut boolean"


def index_arc(archives: DataFrame) -> DataFrame:
    """One slim row per ARC record, without the blocks; version blocks are left out."""
    schema = StructType.fromDDL(ARC_INDEX)
    target = to_arrow_schema(schema)

    def rows(archive: str) -> Iterator[dict]:
        with unpacked(archive) as stream:
            for number, r in enumerate(arc_records(stream)):
                if not r["url"].startswith("filedesc:"):
                    head, payload = http_parts(r["block"])
                    yield {
                        "archive": archive, "number": number, "page_id": page_of(head), "payload_bytes": len(payload),
                        "digest": hashlib.sha1(payload).digest(), "record": record_id(archive, number), "url": r["url"], "date": r["date"], "cut": r["cut"],
                    }

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                for some in batched(rows(archive), ROWS_AT_ONCE):
                    yield pa.RecordBatch.from_pylist(list(some), schema=target)

    return each_archive(archives.select("archive")).mapInArrow(index, schema)


def with_originals(index: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """The index with ``origin``: record, url and date of the response that a revisit repeats, null for responses.

    Of records with equal payloads of ``least`` bytes or more the one with the
    largest page id is the response; ids that repeat or are null go by archive and number.
    """
    place = F.struct("page_id", "archive", "number", "record", "url", "date")
    same = index.where(F.col("payload_bytes") >= least).groupBy(F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    # only payloads that repeat; written, so that the join can split a common one
    kept = written(same.agg(F.max(place).alias("kept"), F.count("*").alias("n")).where("n > 1"), "warc-originals")
    joined = index.join(kept, (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    return joined.select(*index.columns, F.when(F.col("kept.record") != F.col("record"), F.struct("kept.record", "kept.url", "kept.date")).alias("origin"))


def convert_arc(archives: DataFrame, folder: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """ARC archives written anew as WARC to ``folder``; the table of written archives (``archive, bytes``).

    ``archives`` has a column ``archive`` of paths or URIs, plain or gzip files
    of either version.  Record ids come from archive and record number, dates,
    types and digests from the legacy header and the block: a version block
    becomes ``warcinfo``, an HTTP answer ``response`` (or ``revisit`` with its
    HTTP head alone, where an equal payload of ``least`` bytes is kept
    elsewhere), anything else ``resource``.  A block that the file cuts short is
    marked ``WARC-Truncated``.  An empty table writes nothing.

    Two passes read the archives: the first yields slim rows, on which equal
    payloads are found; the second writes.  A task holds one record at a time.
    """
    index = written(index_arc(archives), "arc-index")
    judged = with_originals(index, least).where("origin is not null").select("archive", "number", "origin")
    # revisits follow their archive's own row, which comes first: an archive is written by one task
    each = archives.select("archive", F.lit(-1).cast("long").alias("number"), F.lit(None).cast(judged.schema["origin"].dataType).alias("origin"))
    todo = each.unionByName(judged).repartitionByRange(max(1, archives.count()), "archive").sortWithinPartitions("archive", "number")
    schema = StructType.fromDDL("archive string, bytes bigint")
    target = to_arrow_schema(schema)

    begun = datetime.now(UTC).strftime("%Y%m%d%H%M%S")

    def copy(archive: str, origins: dict[int, dict], out: Archives) -> None:
        with unpacked(archive) as stream:
            for number, r in enumerate(arc_records(stream)):
                block, ident, date = r["block"], record_id(archive, number), warc_date(r["date"])
                more = {"WARC_Truncated": "length"} if r["cut"] else {}
                if r["url"].startswith("filedesc:"):
                    out.add(warc_record("warcinfo", ident, date, block, Content_Type="text/plain", WARC_Filename=archive.rsplit("/", 1)[-1], **more))
                    continue
                head, payload = http_parts(block)
                more |= {"WARC_Target_URI": r["url"], "WARC_IP_Address": r["ip"], "WARC_Payload_Digest": digest32(payload)}
                if not head:
                    out.add(warc_record("resource", ident, date, block, Content_Type=r["type"], **more))
                elif number in origins:
                    first = origins[number]
                    out.add(warc_record(
                        "revisit", ident, date, head, Content_Type="application/http; msgtype=response", WARC_Profile=REVISIT_PROFILE,
                        WARC_Refers_To=f"<{first['record']}>", WARC_Refers_To_Target_URI=first["url"], WARC_Refers_To_Date=warc_date(first["date"]), **more))
                else:
                    out.add(warc_record("response", ident, date, block, Content_Type="application/http; msgtype=response", **more))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first(name: str) -> bytes:
            fields = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
            return warc_record("warcinfo", record_id(name, -1), warc_date(begun), fields, Content_Type="application/warc-fields", WARC_Filename=name)

        out, archive, origins = Archives(folder, ".warc.gz", first, archive_bytes), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != archive:
                    if archive is not None:
                        copy(archive, origins, out)
                    archive, origins = row["archive"], {}
                if row["origin"] is not None:
                    origins[row["number"]] = row["origin"]
        if archive is not None:
            copy(archive, origins, out)
        out.close()
        yield pa.RecordBatch.from_pylist(out.done, schema=target)

    return written(todo.mapInArrow(convert, schema), "warc-files")


WARC_ROWS = (
    "archive string, record string, type string, url string, date string, page_id bigint, payload_bytes bigint, payload_sha1 string, "
    "refers_to string, sound boolean"
)


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per captured record (``warcinfo`` left out) of WARC archives, plain or gzip.

    ``payload_sha1`` is the declared digest in lower-case hex.  The payload of a
    revisit is not stored: its size is what its HTTP head declares.  ``sound``
    says whether block and payload have their declared digests.
    """
    schema = StructType.fromDDL(WARC_ROWS)
    target = to_arrow_schema(schema)

    def row(archive: str, head: dict[str, str], block: bytes) -> dict:
        http, payload = http_parts(block)
        stored = head["warc-type"] != "revisit"
        declared = head.get("warc-payload-digest", "")
        size = len(payload) if stored else int(http_field(http, "Content-Length") or 0)
        sound = head.get("warc-block-digest") == digest32(block) and (not stored or declared == digest32(payload))
        return {
            "archive": archive, "record": head["warc-record-id"].strip("<>"), "type": head["warc-type"], "url": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "page_id": page_of(http), "payload_bytes": size, "payload_sha1": base64.b32decode(declared[5:]).hex(),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "sound": sound,
        }

    def rows(archive: str) -> Iterator[dict]:
        with unpacked(archive) as stream:
            for head, block in warc_records(stream):
                if head.get("warc-type") != "warcinfo":
                    yield row(archive, head, block)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                for some in batched(rows(archive), ROWS_AT_ONCE):
                    yield pa.RecordBatch.from_pylist(list(some), schema=target)

    return each_archive(archives.select("archive")).mapInArrow(read, schema)


def with_referred(records: DataFrame) -> DataFrame:
    """WARC rows with ``refers_page``, the page id of the response that a revisit names."""
    names = records.where("refers_to is not null").select(F.col("refers_to").alias("_record")).distinct()
    told = records.where("refers_to is null").join(names, F.col("record") == F.col("_record"), "left_semi")
    pages = written(told.select(F.col("record").alias("_record"), F.col("page_id").alias("refers_page")), "warc-referred")
    return records.join(pages, F.col("refers_to") == F.col("_record"), "left").drop("_record")
