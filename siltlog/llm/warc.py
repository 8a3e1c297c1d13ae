"""WARC archives: a writer that makes revisit records of repeated payloads, and a Python data source that reads them."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .common import cut, near, table, work_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, offset long"
#: Records of a file at most, so that files stay small enough to be the unit of work.
RECORDS_A_FILE = 100_000
#: Bytes of files that one task reads, unless a file is larger.
TASK_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BATCH_BYTES = 4 << 20


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hexadecimal digits give 4 characters."""
    code = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, id_column: str, payload: str, least: int = 0) -> DataFrame:
    """pages with payload_digest and refers_to: of rows with equal payloads of at least `least` bytes, the smallest id of them, for all rows but that.

    Repeated digests are counted first, with a partial count before the shuffle; up
    to a bound of them are broadcast, more are joined by a shuffle.
    """
    digested = pages.withColumn("payload_digest", base32_sha1(F.encode(payload, "UTF-8")))
    repeated = digested.filter(F.octet_length(payload) >= least).groupBy("payload_digest").agg(F.min(id_column).alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = cut(repeated.filter("n > 1").drop("n"))
    joined = digested.join(near(repeated), "payload_digest", "left")
    again = (F.octet_length(payload) >= least) & ~F.col("first_id").eqNullSafe(F.col(id_column))
    return joined.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row of pages to files in `path`, by Spark's text writer, so to any store that Spark writes to.

    Of rows with equal payloads of at least `least` bytes, that with the smallest
    id becomes a response record and the others revisit records, which have no payload and refer
    to it; rows with smaller payloads are all responses. A null html is an
    empty payload. Characters of ids and urls that would break a header line are written as %XX, and the reader leaves out a url's outer spaces.
    A null url gives no target; a null id gives a record without an id. Equal rows with the same id all become
    responses. An empty table gives an archive without records.
    """
    fixed = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("payload"))
    marked = with_revisits(fixed, "id", "payload", least)
    size, revisit = F.octet_length("payload"), F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    def plain(value: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(value).cast("string"), "\r", "%0D"), "\n", "%0A"), "\x00", "%00")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), plain("id"), F.lit(">"))),
        line("WARC-Target-URI", plain("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), plain("refers_to"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.concat(F.lit("Content-Length: "), F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size), F.lit("\r\n\r\n")),
        body,
    )
    marked.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


@dataclass
class _Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    if path.startswith("s3a://"):
        path = "s3://" + path.removeprefix("s3a://")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    """Whole files are dealt to tasks. Of each record the headers are read first; its payload is passed over if a pushed filter rejects the headers, or if payloads aren't wanted."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.want_payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        of_headers = {"record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes"}
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith))
            if known and len(f.attribute) == 1 and f.attribute[0] in of_headers:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _file_system(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
        out, held = [], 0
        for name, size in found:
            if not out or held + size > self.task_bytes:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [_Files(p) for p in out] or [_Files([])]

    def passes(self, row: dict) -> bool:
        return all(_holds(f, row[f.attribute[0]]) for f in self.filters)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                stream = gzip.open(raw) if path.endswith(".gz") else raw
                for row in records(stream, path, self.passes, self.want_payload, self.verify):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > _BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)


def _holds(f: Filter, value) -> bool:
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, LessThan) else value <= f.value


_ARROW = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))],
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _ARROW], schema=_ARROW)


class _Lines:
    """Buffered reading from a stream that may be able to seek."""

    def __init__(self, stream):
        self.raw, self.buffer, self.begin, self.at = stream, b"", 0, 0

    @property
    def position(self) -> int:
        return self.begin + self.at

    def _fill(self) -> bool:
        more = self.raw.read(1 << 18)
        self.begin, self.buffer, self.at = self.begin + self.at, self.buffer[self.at :] + more, 0
        return bool(more)

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.buffer) - 1
                break
        out, self.at = self.buffer[self.at : end + 1], end + 1
        return out

    def take(self, n: int) -> bytes:
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        if len(out) == n:
            return out
        parts, n = [out], n - len(out)
        self.begin, self.buffer, self.at = self.position, b"", 0
        while n:
            got = self.raw.read(n)
            if not got:
                raise EOFError("a record ends early")
            parts.append(got)
            self.begin += len(got)
            n -= len(got)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if n <= len(self.buffer) - self.at:
            self.at += n
            return
        if not isinstance(self.raw, gzip.GzipFile):
            to = self.position + n
            self.raw.seek(to)
            self.begin, self.buffer, self.at = to, b"", 0
        else:
            while n:
                n -= len(self.take(min(n, 1 << 18)))


def _header(source: _Lines) -> dict[str, str]:
    out = {}
    while (line := source.line()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream: io.RawIOBase, path: str, passes, want_payload: bool, verify: bool) -> Iterator[dict]:
    """The records of a file, headers first; a payload is read if wanted (or to be verified) and the headers pass."""
    source = _Lines(stream)
    while True:
        offset = source.position
        first = source.line()
        if not first:
            return
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{path}: no WARC record at {offset}")
        header = _header(source)
        rest = int(header["content-length"])
        kind = header.get("warc-type")
        length = rest
        if header.get("content-type", "").startswith("application/http"):
            began = source.position
            source.line()
            http = _header(source)
            rest -= source.position - began
            length = int(http.get("content-length", rest)) if kind == "revisit" else rest
        row = {
            "record_id": header.get("warc-record-id"),
            "record_type": kind,
            "target_uri": header.get("warc-target-uri"),
            "date": header.get("warc-date"),
            "refers_to": header.get("warc-refers-to"),
            "payload_digest": header.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": length,
            "payload": None,
            "file": path,
            "offset": offset,
        }
        if not passes(row):
            source.skip(rest)
            continue
        if kind != "revisit" and (want_payload or verify):
            payload = source.take(rest)
            if verify and b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"]:
                raise ValueError(f"{path}: the payload at {offset} doesn't have the digest in its header")
            row["payload"] = payload if want_payload else None
        else:
            source.skip(rest)
        yield row


class WarcSource(DataSource):
    """spark.read.format("warc"): options path, payload (false: leave payloads out), verify (check payloads against their digests), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of all files in `path`, as SCHEMA. Filters on record_type and other headers are handed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload)).option("verify", str(verify)).load()


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC files in the shared folder and read back, with each payload checked against its digest."""
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path, payload=False, verify=True)

    def page(column: str) -> Column:
        return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri")


OP10_SQL = """
with
pays as (select page_id, url, encode(coalesce(html, '')) as p, sha1(encode(coalesce(html, ''))) as h from pages),
digits as (select page_id, url, octet_length(p) as payload_bytes, h,
    array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(concat('0x', substr(h, cast(5 * i + 1 as integer), 5)) as bigint) >> cast(5 * (3 - j) as integer)) & 31 as integer), 1)), '')), '') as payload_digest from pays),
firsts as (select *, min(page_id) over (partition by h) as first from digits)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as target_uri
from firsts
"""
