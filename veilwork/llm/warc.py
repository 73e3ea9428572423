"""WARC archives as a Spark data source.

Writing: each task writes one archive under a name of its own attempt; the driver gives the archives of successful tasks
their final names, so a lost executor leaves no half archive behind.  Beside an archive lies an index of record offsets.

Reading: the driver plans partitions from the index (an archive without one is a single partition).  A task reads the
headers of a record first.  Predicates on the record type and on header fields are pushed down and tested on them; the
payload of a record that fails, or whose payload no wanted column needs, is skipped with a seek and never decoded.

Archives are reached through Arrow's file systems, so a path may be local, on HDFS or in an object store.  Archives of
others are read as well: plain ones, and ``.warc.gz`` (one partition each, since their members have no index); header names
count in any case, and a payload without a length of its own has that of its block.  A file that is no archive is an error,
never passed over.

Defined results: a null html is an empty payload; a null page id is read back as null; a null url has no target header;
records with equal payloads and equal smallest ids are all responses; an empty table gives no archive and reads as empty.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import shared_path, stored

FIELDS = {  # column: header field, as names are compared
    "record_type": "warc-type", "record_id": "warc-record-id", "url": "warc-target-uri", "payload_digest": "warc-payload-digest",
    "payload_bytes": "warc-payload-length", "refers_to": "warc-refers-to",
}
SCHEMA = "page_id long, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to long, payload string"
ID = "urn:page:"
DATE = "1970-01-01T00:00:00Z"  # records of a table have no time of their own
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        name, out, at, marks = f"{uuid.uuid4().hex}.warc", None, 0, [0]
        for b in iterator:
            rows = zip(*(b.column(b.schema.names.index(n)).to_pylist() for n in ("page_id", "url", "html", "refers_to")))
            for page_id, url, html, refers_to in rows:
                if out is None:
                    out = system.open_output_stream(posixpath.join(folder, f"_{name}"))
                raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                if at - marks[-1] >= self.split_bytes:
                    marks.append(at)
                out.write(raw)
                at += len(raw)
        if out is None:
            return Written([])
        out.close()
        with system.open_output_stream(posixpath.join(folder, f"_{name}.index")) as index:
            index.write(json.dumps(marks + [at]).encode())
        return Written([name])

    def commit(self, messages: list) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            for end in (".index", ""):  # the archive last: once it is there, it is complete
                system.move(posixpath.join(folder, f"_{name}{end}"), posixpath.join(folder, f"{name}{end}"))

    def abort(self, messages: list) -> None:
        system, folder = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            for end in (".index", ""):
                system.delete_file(posixpath.join(folder, f"_{name}{end}"))


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, verify: bool):
        self.path, self.columns, self.verify = path, [(f.name, f.dataType.simpleString()) for f in schema.fields], verify
        self.tests: list[tuple[str, str, object]] = []
        self.wants_length = any(n == "payload_bytes" for n, _ in self.columns)

    def pushFilters(self, filters):
        """Take predicates on header columns; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in FIELDS and column not in ("payload_bytes", "refers_to", "payload_digest") and isinstance(f, (EqualTo, In, StringStartsWith)):
                value = list(f.value) if isinstance(f, In) else f.value
                self.tests.append((FIELDS[column], type(f).__name__, value))
            else:
                yield f

    def partitions(self):
        system, folder = fs.FileSystem.from_uri(self.path)
        found = {x.path: x.size for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not posixpath.basename(x.path).startswith("_")}
        out = []
        for name, size in sorted(found.items()):
            if name.endswith(".index") and name.removesuffix(".index") in found:
                continue
            if not name.endswith((".warc", ".warc.gz")):
                raise ValueError(f"{name} is no WARC archive")
            marks = [0, size]
            if f"{name}.index" in found:
                with system.open_input_stream(f"{name}.index") as index:
                    marks = json.loads(index.read())
            out += [Range(name, a, b) for a, b in zip(marks, marks[1:])]
        return out or [Range("", 0, 0)]

    def _passes(self, header: dict[str, str]) -> bool:
        for field, kind, value in self.tests:
            mine = header.get(field)
            if mine is None or not (mine == value if kind == "EqualTo" else mine in value if kind == "In" else mine.startswith(value)):
                return False
        return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        types = {"bigint": pa.int64(), "string": pa.string()}
        schema = pa.schema([(n, types[t]) for n, t in self.columns])
        wants_payload = any(n == "payload" for n, _ in self.columns)
        rows: list[dict] = []
        size = 0
        if partition.file:
            system, _ = fs.FileSystem.from_uri(self.path)
            with system.open_input_file(partition.file) as raw:
                raw.seek(partition.start)
                packed = partition.file.endswith(".gz")
                f = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 18)
                at = partition.start
                while packed or at < partition.end:
                    line = f.readline()
                    if packed and not line:
                        break
                    at += len(line)
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"no record at {at - len(line)} of {partition.file}")
                    header: dict[str, str] = {}
                    while (line := f.readline()).strip(b"\r\n"):
                        at += len(line)
                        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                        header[name.lower()] = value.strip(" \t\r\n")
                    length = int(header["content-length"])
                    at += len(line) + length + 4
                    payload = None
                    full = header.get("warc-type") == "response"
                    http = header.get("content-type", "").lower().startswith("application/http")
                    if self._passes(header):
                        rest = length + 4
                        if full and (wants_payload or self.verify or (http and self.wants_length and FIELDS["payload_bytes"] not in header)):
                            block = f.read(length)
                            payload = block[block.index(b"\r\n\r\n") + 4:] if http else block
                            rest = 4
                        f.seek(rest, io.SEEK_CUR)
                        header.setdefault(FIELDS["payload_bytes"], str(length if payload is None else len(payload)))
                        rows.append(self._row(header, payload, wants_payload))
                        size += length if payload is not None else 200
                    else:
                        f.seek(length + 4, io.SEEK_CUR)
                    if size > 1 << 24 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, header: dict[str, str], payload: bytes | None, wants_payload: bool) -> dict:
        number = lambda x: int(x[1 + len(ID):-1]) if x and x != f"<{ID}>" and x.startswith(f"<{ID}") else None
        out = {
            "page_id": number(header.get(FIELDS["record_id"])), "record_type": header.get(FIELDS["record_type"]), "record_id": header.get(FIELDS["record_id"]),
            "url": header.get(FIELDS["url"]), "payload_bytes": int(header[FIELDS["payload_bytes"]]),
            "payload_digest": header.get(FIELDS["payload_digest"], "").removeprefix("sha1:"), "refers_to": number(header.get(FIELDS["refers_to"])),
        }
        if payload is not None and self.verify:
            found = {"payload_bytes": len(payload), "payload_digest": digest(payload)}
            if any(out[k] not in (v, "") for k, v in found.items()):
                raise ValueError(f"payload of {out['record_id']} does not match its digest")
        if wants_payload:
            out["payload"] = None if payload is None else payload.decode("utf-8", "surrogatepass")
        return out


class WarcSource(DataSource):
    """``format("warc")``; options ``path``, ``verify`` (check payload digests), ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("split_bytes", 8 << 20)))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A record per page; of equal payloads of at least ``min_bytes`` the smallest page id is written in full."""
    pages.sparkSession.dataSource.register(WarcSource)
    html = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select("page_id", F.sha1(html.cast("binary")).alias("h"), F.octet_length(html).alias("n")).filter(F.col("n") >= min_bytes)
    # digests only, pre-aggregated, so a payload that a third of all pages share is no hot group; then those with a first page
    first = ids.groupBy("h").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    revisits = stored(ids.join(first.select("h", "refers_to"), "h").filter("page_id <> refers_to").select("page_id", "h", "refers_to").distinct(), "revisits")
    named = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("h"))
    named.join(revisits, ["page_id", "h"], "left").select("page_id", "url", "html", "refers_to").write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    """Records of the archives in ``path``; ask only for the columns you need, ``payload`` above all.

    Turns on Spark's filter pushdown for Python sources, which is off by default.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).option("verify", str(verify).lower()).load(path)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, digests checked."""
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", verify=True)
