"""WARC files as a PySpark data source, and a writer.

The reader plans one partition for some files (long ones alone), takes equality and IN predicates on the record type and on
header fields, reads a record's headers first, and steps over the payload of a record that the predicates reject or whose
payload nobody asked for, without decoding it. Files are opened through pyarrow's file systems, so any store with a URI that
pyarrow knows will do; gzip files may have one member a record or one for all.

The writer lets Spark write text files whose lines are records, so that its committer publishes whole files only and a lost
executor leaves none half-written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from tessera.plans.cut import cut, small

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, date string, payload_bytes long, headers map<string,string>, payload binary"
#: Column of a predicate: the header it is about.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "date": "warc-date"}
PART_BYTES, READ_BYTES, MOST_HEADER = 64 << 20, 1 << 20, 1 << 20
#: Bytes that a byte of a gzip file counts as when partitions are planned.
INFLATED = 8
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


def _open(root: str, path: str):
    from pyarrow import fs

    store = fs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else fs.LocalFileSystem()
    return store.open_input_file(path)


class Bytes:
    """A forward reader over a file: lines, exact reads and skips. Skips of plain files seek; those of gzip files inflate and forget."""

    def __init__(self, file, gzip: bool):
        self.file, self.gzip, self.held, self.at, self.z = file, gzip, b"", 0, None

    def more(self) -> bool:
        if self.gzip and self.z is not None and self.z.unconsumed_tail:
            data = self.z.unconsumed_tail
        elif self.gzip and self.z is not None and self.z.eof and self.z.unused_data:
            data, self.z = self.z.unused_data, None
        else:
            data = self.file.read(READ_BYTES)
        if not data:
            return False
        if self.gzip:
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            data = self.z.decompress(data, 4 * READ_BYTES)
        self.held, self.at = self.held[self.at :] + data, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        found = self.at
        while (end := self.held.find(b"\n", found)) < 0:
            found = len(self.held) - self.at
            if found > MOST_HEADER:
                raise ValueError("a header line of a WARC record is too long")
            if not self.more():
                out, self.held, self.at = self.held[self.at :], b"", 0
                return out or None
        out, self.at = self.held[self.at : end], end + 1
        return out[:-1] if out.endswith(b"\r") else out

    def read(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if self.at == len(self.held) and not self.more():
                raise ValueError("a WARC record ends before its length")
            got = self.held[self.at : self.at + need]
            self.at += len(got)
            need -= len(got)
            parts.append(got)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        have = min(n, len(self.held) - self.at)
        self.at, n = self.at + have, n - have
        if n and not self.gzip:
            self.file.seek(n, 1)
            return
        while n:
            if not self.more():
                raise ValueError("a WARC record ends before its length")
            have = min(n, len(self.held) - self.at)
            self.at, n = self.at + have, n - have


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-cased name; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def http_head(data: Bytes, length: int) -> tuple[bytes, bytes, int]:
    """The HTTP headers of a block of length bytes, what was read beyond them, and how much of the block is left. Lines may end with a bare LF; a block without an empty line is all headers."""
    got = b""
    while length and len(got) <= MOST_HEADER:
        more = data.read(min(length, 4096))
        begin, got, length = max(0, len(got) - 3), got + more, length - len(more)
        if end := EMPTY_LINE.search(got, begin):
            return got[: end.start()], got[end.end() :], length
    return got, b"", length


def records(data: Bytes, wants, payload: bool) -> Iterator[tuple]:
    """The records that wants(headers) accepts, as rows of SCHEMA."""
    while (line := data.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line:
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        head = []
        while line := data.line():
            head.append(line)
        h = fields(head)
        length = int(h.get("content-length", 0))
        if not wants(h):
            data.skip(length)
            continue
        body, size, read = None, length, b""
        if h.get("content-type", "").startswith("application/http"):
            inner, read, length = http_head(data, length)
            said = fields(inner.splitlines()[1:])
            h |= {f"http-{k}": v for k, v in said.items()}
            size = len(read) + length
            if h.get("warc-type") == "revisit" and not size and said.get("content-length", "").isdigit():
                size = int(said["content-length"])  # of the payload that it revisits
        if payload:
            body = read + data.read(length)
        else:
            data.skip(length)
        yield (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), h.get("warc-date"), size, h, body)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.wanted.append((HEADER[f.attribute[0]], ()))
            elif isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.wanted.append((HEADER[f.attribute[0]], (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.wanted.append((HEADER[f.attribute[0]], tuple(f.value)))
            else:
                yield f

    def wants(self, headers: dict[str, str]) -> bool:
        return all(name in headers and (not values or headers[name] in values) for name, values in self.wanted)

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held: list[str] = []
        size = 0
        for path, n in _files(self.path):
            n *= INFLATED if path.endswith(".gz") else 1
            if held and size + n > self.part_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)] if held else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with _open(self.path, path) as file:
                yield from records(Bytes(file, path.endswith(".gz")), self.wants, self.payload)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path). Options: payload (true; false leaves the payload null and skips it), partbytes (bytes of files in a partition, gzip ones counted INFLATED times).

    payload_bytes is what the record holds; for a revisit without a payload, what its HTTP headers say.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """The records under path. Filters on the columns of HEADER reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partbytes", part_bytes).load(path)


def _field(name: str, value: Column) -> Column:
    """A header line; none for null. Control characters cannot end it early."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def write_warc(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """rows (record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload string) as WARC records of HTTP responses.

    A revisit record has the HTTP headers, with the length of the full payload, and no payload.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.coalesce("payload", F.lit(""))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("target_uri")),
        _field("WARC-Payload-Digest", F.col("payload_digest")), _field("WARC-Refers-To", F.col("refers_to")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _field("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    rows.withColumn("block", block).select(head.alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


#: Payloads of fewer bytes are never told apart by digest.
LEAST_SHARED = 1000


def archive_pages(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Writes every page (page_id, url, html) as a record.

    Of the pages with one payload of at least `least` bytes, that with the largest page_id is a response and the others
    revisit it; all others are responses. A null html is an empty payload. A null page_id is the least; rows that repeat the
    largest page_id are responses all. Only the digests that occur twice or more are joined to the pages: as a broadcast if
    a count finds them few, else by a shuffle that splits hot digests.
    """
    p = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    many = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).filter("n > 1 and top is not null").select("payload_digest", "top")
    p = p.join(small(cut(many)), "payload_digest", "left").withColumn("back", F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("payload_bytes") >= least))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c, F.lit("null")), F.lit(">"))
    rows = p.select(
        name(F.col("page")).alias("record_id"), F.when(F.col("back"), "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(F.col("back"), name(F.col("top").cast("string"))).alias("refers_to"), "payload_digest", "payload_bytes", "payload",
    )
    write_warc(rows, path)


def page_records(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of records that `archive_pages` wrote. A response's length and digest are those of the payload read; a revisit's those of its headers."""
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return archive.select(
        number("record_id").alias("page_id"), F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "target_uri",
    )
