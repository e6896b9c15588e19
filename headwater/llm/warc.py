"""Operator 5: WARC archives as a Spark data source in Python.

Writing: every task writes gzip members, one per record, into files of its own name; the driver's
commit lists the files of the attempts that counted in a manifest, so files of lost executors are
never read. Reading: partitions are planned from the manifest at record boundaries; predicates on
the record type and other headers are pushed into the reader, which unpacks the head of a record
first and steps over the payload, without unpacking it, if the record or its payload is not wanted.
The lengths to step over stand in the gzip header, in the extra field that the WARC standard names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from headwater.llm.common import column, shared_folder, ship, staged
from headwater.llm.store import open_store

# Fixed values of the WARC and gzip formats.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
GZIP_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
BASE32, BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

LENGTH_FIELD = "X-Payload-Length"
MANIFEST = "_manifest.json"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
HEAD_BYTES = 4096
SCHEMA = ", ".join(f"{name} string" for name in FIELDS) + ", payload_bytes long, payload binary"


# -- records -------------------------------------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value) if not value.isprintable() else value


def record_bytes(fields: dict[str, str | None], payload: bytes | None, payload_bytes: int) -> bytes:
    """One record: a response carries its payload below an HTTP head, any other record has an empty block."""
    block = b""
    if payload is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = [f"{FIELDS[name]}: {_clean(value)}" for name, value in fields.items() if value is not None]
    if fields.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"{LENGTH_FIELD}: {payload_bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """``data`` as a gzip member that states its packed and plain length in the extra field ``sl``."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(GZIP_HEAD) + 2 + 12 + len(body) + 8
    lengths = struct.pack("<II", *(min(n, 0xFFFFFFFF) for n in (size, len(data))))
    return GZIP_HEAD + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + lengths + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_head(data: memoryview) -> tuple[int, int]:
    """Where the packed bytes of a gzip member begin, and the member's length (0: not stated)."""
    flags, at, size = data[3], 10, 0
    if flags & 4:
        end = at + 2 + struct.unpack_from("<H", data, at)[0]
        at += 2
        while at + 4 <= end:
            (length,) = struct.unpack_from("<H", data, at + 2)
            if bytes(data[at : at + 2]) == b"sl" and length == 8:
                size = struct.unpack_from("<I", data, at + 4)[0]
            at += 4 + length
    for bit in (8, 16):  # file name and comment, each ended by a zero
        if flags & bit:
            while data[at]:
                at += 1
            at += 1
    return at + (2 if flags & 2 else 0), 0 if size == 0xFFFFFFFF else size


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, by lower-case name."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(b":") for line in lines[1:] if line)
    return {name.decode().strip().lower(): value.decode().strip() for name, _, value in pairs}


def read_records(data: memoryview, wanted, with_payload: bool) -> Iterator[tuple]:
    """Records of ``data`` (gzip members or plain) that ``wanted(fields)`` takes, as rows of ``SCHEMA``.

    The head is unpacked first. Of unwanted records, and of records whose payload is not asked for,
    the rest is stepped over where the length is stated.
    """
    at = 0
    while at < len(data):
        packed = data[at] == 0x1F and data[at + 1] == 0x8B
        if packed:
            start, size = member_head(data[at : at + HEAD_BYTES])
            # Only the member's own bytes are handed over: what is left unread is copied at every step.
            unpacker = zlib.decompressobj(-15)
            plain = unpacker.decompress(data[at + start : at + size] if size else data[at + start :], HEAD_BYTES)
            while b"\r\n\r\n" not in plain and not unpacker.eof:
                plain += unpacker.decompress(unpacker.unconsumed_tail, HEAD_BYTES)
        else:
            size, window = 0, HEAD_BYTES
            while b"\r\n\r\n" not in (plain := bytes(data[at : at + window])) and at + window < len(data):
                window *= 2
        head, _, rest = plain.partition(b"\r\n\r\n")
        named = parse_head(head)
        length = int(named.get("content-length", 0))
        fields = {name: named.get(field.lower()) for name, field in FIELDS.items()}
        take = wanted(fields)
        payload, stated = None, named.get(LENGTH_FIELD.lower())
        needs = take and fields["record_type"] == "response" and (with_payload or stated is None)
        if needs or packed and not size:
            if packed:
                parts = [rest]
                while not unpacker.eof:
                    part = unpacker.decompress(unpacker.unconsumed_tail or b"")
                    parts.append(part)
                    if not part and not unpacker.eof:
                        raise ValueError("a gzip member ends early")
                rest = b"".join(parts)
            else:
                rest = bytes(data[at + len(head) + 4 : at + len(head) + 4 + length])
        if needs:
            payload = rest[:length]
            if payload.startswith(b"HTTP/"):
                payload = payload.partition(b"\r\n\r\n")[2]
        if take:
            known = int(stated) if stated is not None else len(payload or b"")
            yield (*(fields[name] for name in FIELDS), known, payload if with_payload else None)
        if packed:
            at += size or len(data) - at - len(unpacker.unused_data) + 8
        else:
            at += len(head) + 4 + length + 4


# -- data source ------------------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (fields, payload_bytes, payload) as records; a file per task attempt."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = open_store(self.folder)
        store.create_dir(path, recursive=True)
        name, at, splits, since = f"part-{uuid.uuid4().hex}.warc.gz", 0, [], 0
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    fields = {n: row[n] for n in FIELDS}
                    member = gzip_member(record_bytes(fields, row["payload"], row["payload_bytes"]))
                    if since >= SPLIT_BYTES:
                        splits.append(at)
                        since = 0
                    out.write(member)
                    at, since = at + len(member), since + len(member)
        return Written(name, at, splits)

    def commit(self, messages: list) -> None:
        store, path = open_store(self.folder)
        files = [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.size]
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, path = open_store(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/{m.name}")


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, with_payload: bool):
        self.folder, self.with_payload, self.allowed = folder, with_payload, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership tests on header fields; gives the others back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                if None not in values:
                    name = f.attribute[0]
                    self.allowed[name] = self.allowed[name] & values if name in self.allowed else values
                    continue
            if not (isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.allowed):
                yield f

    def partitions(self) -> list[Piece]:
        """Pieces of the manifest's files between record boundaries; without a manifest, whole files."""
        store, path = open_store(self.folder)
        if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{path}/{MANIFEST}") as file:
                listed = json.loads(file.read())
        else:
            found = store.get_file_info(fs.FileSelector(path))
            listed = [{"name": f.base_name, "size": f.size, "splits": []} for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        pieces = []
        for f in listed:
            bounds = [0, *f["splits"], f["size"]]
            pieces += [Piece(f["name"], a, b) for a, b in zip(bounds, bounds[1:])]
        return pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.end == piece.start:
            return
        store, path = open_store(self.folder)
        with store.open_input_file(f"{path}/{piece.name}") as file:
            file.seek(piece.start)
            data = memoryview(file.read(piece.end - piece.start)).cast("B")
        names = [*FIELDS, "payload_bytes", "payload"]
        kinds = pa.schema([*((n, pa.string()) for n in FIELDS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, weight = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for n, c in zip(names, zip(*rows))], schema=kinds)

        wanted = self.allowed
        for row in read_records(data, lambda f: all(f[n] in v for n, v in wanted.items()), self.with_payload):
            rows.append(row)
            weight += 200 + len(row[-1] or b"")
            if weight >= BATCH_BYTES:
                yield batch()
                rows, weight = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``format("warc")``. Options: path; payload (true or false): whether payloads are unpacked."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages --------------------------------------------------------------------------------------------------

def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times ten hexadecimal digits become eight of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def page_records(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A record per row of ``pages``. Of equal payloads of ``least_bytes`` or more, that with the largest key is
    the response and the others revisit it; rows that repeat the key of the response are responses too.

    Null html is an empty payload. A null key is smaller than any other. Payloads move only if the table
    of repeated digests is too large to broadcast.
    """
    payload = F.coalesce(column(html), F.lit("")).cast("binary")
    rows = pages.select(column(key).alias("page_id"), column(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keep"))
    repeated = staged(groups.where("n > 1 AND keep IS NOT NULL").select("sha", "keep"))

    def record_id(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(repeated, "sha", "left").select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), record_id(F.col("page_id")).alias("record_id"),
        F.lit("2020-01-01T00:00:00Z").alias("date"), F.col("url").alias("target_uri"), F.when(revisit, record_id(F.col("keep"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, folder: str | None = None) -> str:
    """Writes records as archives into ``folder`` (a new shared one by default) and returns it."""
    spark = records.sparkSession
    register(spark)
    folder = folder or shared_folder(spark)
    records.write.format("warc").mode("append").save(folder)
    return folder


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def page_number(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads the archives and gives a row per record; each response's payload is checked.

    Responses are read with their payload and must match the stated length and digest, else the job fails.
    Revisits are read by a pushed predicate, without unpacking.
    """
    spark = pages.sparkSession
    folder = write_archives(page_records(pages))
    full = read_archives(spark, folder).where("record_type = 'response'")
    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    sound = (base32_sha1(F.col("payload")) == stated) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = F.when(sound, stated).otherwise(F.raise_error(F.lit("a payload differs from its record's digest")))
    bare = read_archives(spark, folder, payload=False).where("record_type = 'revisit'")
    parts = [
        part.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type",
                    page_number(F.col("refers_to")).alias("refers_to"))
        for part, digest in ((full, checked), (bare, stated))
    ]
    return parts[0].unionByName(parts[1])
