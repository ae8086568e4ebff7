"""WARC archives as a PySpark data source (`quillon_warc`): a reader that skips what it need not decode, and a writer.

Writing: each task writes gzip archives, a member per record, of about `roll_bytes` each, under a temporary name that the
commit takes away; a lost attempt leaves only temporary files, which the commit deletes. Each member's gzip header carries
the skip-lengths field ("sl", compressed and plain length), so that a reader can step over a member it has seen enough of.

Reading: the driver lists the archives and deals whole files out to partitions of about `partition_bytes`. Filters on
record_type, record_id, target_uri, payload_digest and refers_to are pushed down. A record's headers are decoded first, a
kilobyte at a time; if a pushed filter refuses them, or `payload` is "false", its content is stepped over undecoded. Plain
.warc files and members without skip lengths are read too.

Defined cases: a null payload is empty; a null target leaves the header out; malformed headers end the reading with an error.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import common

FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
READ = pa.schema([*((f, pa.string()) for f in FIELDS), ("payload_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])
READ_DDL = ", ".join(f"{f} string" for f in FIELDS) + ", payload_bytes long, archive string, offset long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = "X-Payload-Length"
END = b"\r\n\r\n"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else pafs.FileSystem.from_uri(uri.replace("file:", "", 1))


def hexed(digest: str | None) -> str | None:
    return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None


def record(row: dict) -> bytes:
    """The bytes of one record. row: record_type, record_id, target_uri, payload_digest (hex), refers_to, payload_bytes, payload."""
    clean = lambda x: str(x).replace("\r", " ").replace("\n", " ")
    block = HTTP + (row["payload"] or b"" if row["record_type"] != "revisit" else b"")
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": "1970-01-01T00:00:00Z"}
    if row["target_uri"] is not None:
        head["WARC-Target-URI"] = clean(row["target_uri"])
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    if row["refers_to"] is not None:
        head |= {"WARC-Refers-To": row["refers_to"], "WARC-Profile": PROFILE}
    head |= {LENGTH: row["payload_bytes"], "Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + END


def member(plain: bytes) -> bytes:
    """A gzip member with its skip lengths."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    total = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(plain)) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


@dataclass
class Archives(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files: tuple[str, ...]):
        self.files = files


@dataclass
class Wrote(WriterCommitMessage):
    temporary: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.target = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                values = frozenset(f.value if isinstance(f, In) else [f.value])
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Archives]:
        fs, path = opened(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        out, files, total = [], [], 0
        for name, size in found:
            if files and total + size > self.target:
                out.append(Archives(tuple(files)))
                files, total = [], 0
            files.append(name)
            total += size
        return [*out, Archives(tuple(files))] if files or not out else out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as f:
                for row in self.records(f, name):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=READ)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=READ)

    def records(self, f, name: str) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            start = f.read(min(4096, end - at))
            if start[:2] == b"\x1f\x8b":
                row, following = self.zipped(f, at, start)
            else:
                row, following = self.plain(f, at, start)
            if row is not None:
                yield row | {"archive": name, "offset": at}
            at = following

    def zipped(self, f, at: int, start: bytes) -> tuple[dict | None, int]:
        length = struct.unpack("<I", start[16:20])[0] if start[3] & 4 and start[12:14] == b"sl" else None
        unpacker, plain, given, unread = zlib.decompressobj(31), b"", len(start), start
        while END not in plain:  # headers first: as little as holds them
            plain += unpacker.decompress(unread, 1024)
            unread = unpacker.unconsumed_tail
            if not unread and END not in plain:
                if unpacker.eof or not (unread := f.read(4096)):
                    raise ValueError(f"a record without an end of its headers at {at}")
                given += len(unread)
        head = headers(plain)
        wanted = self.passes(head)
        if length is not None and not (wanted and self.payload):
            return (self.row(head, None) if wanted else None), at + length
        parts, keep = [plain], wanted and self.payload
        while not unpacker.eof:
            if not unread:
                if not (unread := f.read(1 << 16)):
                    raise ValueError(f"a member that breaks off at {at}")
                given += len(unread)
            got = unpacker.decompress(unread, 1 << 20)
            unread = unpacker.unconsumed_tail
            if keep:
                parts.append(got)
        following = at + given - len(unpacker.unused_data)
        if not wanted:
            return None, following
        return self.row(head, content(b"".join(parts), head) if self.payload else None), following

    def plain(self, f, at: int, start: bytes) -> tuple[dict | None, int]:
        while END not in start:
            if not (more := f.read(4096)):
                raise ValueError(f"a record without an end of its headers at {at}")
            start += more
        head, body = headers(start), start.index(END) + 4
        following = at + body + int(head["content-length"]) + 4
        if not self.passes(head):
            return None, following
        if not self.payload:
            return self.row(head, None), following
        f.seek(at)
        return self.row(head, content(f.read(following - at), head)), following

    def passes(self, head: dict[str, str]) -> bool:
        return all(self.value(head, k) in v for k, v in self.wanted.items())

    @staticmethod
    def value(head: dict[str, str], field: str) -> str | None:
        found = head.get(FIELDS[field].lower())
        return hexed(found) if field == "payload_digest" else found

    def row(self, head: dict[str, str], payload: bytes | None) -> dict:
        size = head.get(LENGTH.lower())
        return {k: self.value(head, k) for k in FIELDS} | {"payload_bytes": int(size) if size is not None else None, "payload": payload}


def headers(plain: bytes) -> dict[str, str]:
    lines = plain[: plain.index(END)].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def content(plain: bytes, head: dict[str, str]) -> bytes:
    """The payload: the block without its HTTP headers."""
    at = plain.index(END) + 4
    block = plain[at : at + int(head["content-length"])]
    return block[block.index(END) + 4 :] if head.get("content-type", "").startswith("application/http") and END in block else block


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", 64 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size > self.roll:
                    if out:
                        out.close()
                    names.append(f"{path}/part-{uuid.uuid4().hex}.warc.gz.tmp")
                    out, size = fs.open_output_stream(names[-1]), 0
                size += out.write(packed := member(record(row))) or len(packed)
        if out:
            out.close()
        return Wrote(names)

    def commit(self, messages: list[Wrote | None]) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        kept = [n for m in messages if m for n in m.temporary]
        for name in kept:
            fs.move(name, name.removesuffix(".tmp"))

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, _ = opened(self.path)
        for name in (n for m in messages if m for n in m.temporary):
            fs.delete_file(name)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_warc"

    def schema(self) -> str:
        return READ_DDL

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """A record per page. Of equal payloads of at least `least` bytes the largest page_id is the response (every row that has
    it), the others refer to it; a group whose ids are all null, and smaller payloads, are all responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), body.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies")).where("copies > 1 and keep is not null").select("payload_digest", "keep")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    # Spark sends the digests that several pages share to all tasks if they are small enough, and then no payload moves; else it joins by
    # digest, where a payload that a large share of the pages has is split
    return rows.join(groups, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri", "payload_digest", F.when(revisit, urn("keep")).alias("refers_to"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload")
    )


def archive(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    plan_records(pages).write.format("quillon_warc").mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("quillon_warc").options(**options).load(path)


def page_of(column: str) -> F.Column:
    return F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back: responses with their payloads, revisits by their headers alone."""
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    archive(pages, path)
    responses = read(spark, path).where("record_type = 'response'").withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    revisits = read(spark, path, payload="false").where("record_type = 'revisit'")
    return responses.drop("payload").unionByName(revisits.drop("payload")).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
