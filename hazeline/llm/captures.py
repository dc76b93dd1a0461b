"""WARC archives with a two-level capture index (operator 12).

Pages become WARC/1.1 records, each a gzip member of its own, in files below a shared folder; a record whose payload
another record already carries is a revisit of it. The index has one line for each record under the reversed-host key
of its URL. Lines are range-partitioned and sorted by key and page; each partition becomes one index file: compressed
blocks of BLOCK lines, then a sparse directory with the first entry, place and length of each block. A look-up searches
the files' first entries (one for each partition), then the file's directory, reads the range of one block, searches in
it, and hands over the range of the record. Look-ups run in key order and record reads in file order, so neighbours
share a read.

Tasks write files under names of their own and report them as rows; only what committed rows name is ever read, so a
repeated task leaves a file that nothing refers to. Files are read and written through pyarrow's file systems, which
open what spark.checkpoint.dir may name (local, HDFS, S3, GCS).

Defined results: a null html is the empty payload; a null url is the empty URL, a key of its own. Of equal payloads of
at least ``least`` bytes the record with the largest page_id is the response; rows that repeat a page_id are each a
record of their own, and rows without page_id come before all others. White space and control characters of a URL are
percent-encoded in keys and headers. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazeline.session import fresh_path, materialized

BLOCK = 3000
FILE_BYTES = 1 << 30
GAP, MOST_READ = 1 << 16, 1 << 23
PLACE = "file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """The sort key of a URL: reversed host, then port, path and query; no scheme, user or fragment."""
    text = F.coalesce(url, F.lit(""))
    form = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)([^#]*)"
    host = F.lower(F.regexp_extract(text, form, 1))
    turned = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.regexp_extract(text, form, 2))
    key = F.when(text.rlike(form), turned).otherwise(text)
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def _files(folder: str):
    """pyarrow's file system of a folder, and a function from file names to its paths."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        system, base = fs.FileSystem.from_uri(folder)
    else:
        system, base = fs.LocalFileSystem(), folder
    return system, lambda name: f"{base.rstrip('/')}/{name}"


class _Sink:
    """Files of gzip members, begun when there is something to write."""

    def __init__(self, folder: str, stem: str, ending: str):
        self.system, self.path = _files(folder)
        self.stem, self.ending, self.out, self.name, self.at = stem, ending, None, None, 0

    def put(self, data: bytes, packed: bool = True) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at = f"{self.stem}-{uuid.uuid4().hex}.{self.ending}", 0
            self.system.create_dir(self.path(""), recursive=True)
            self.out = self.system.open_output_stream(self.path(self.name), compression=None)
        if packed:
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = member.compress(data) + member.flush()
        self.out.write(data)
        place = self.name, self.at, len(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, when: str) -> bytes:
    """A response record, or a revisit record without payload if it refers to another page."""
    revisit = refers_to is not None
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    body = http if revisit else http + payload
    target = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
             f"WARC-Date: {when}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says: url, page_id, refers_to (as text), record_type, payload_bytes, payload_digest, payload.

    A response's size and digest are taken from its payload and must equal its headers; a revisit's come from them.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    told = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != told or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that it names")
    page, other = (fields.get(k, "<urn:page:>")[len("<urn:page:"):-1] or None for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {"url": fields["WARC-Target-URI"], "page_id": page, "refers_to": other, "record_type": kind,
            "payload_bytes": told, "payload_digest": digest, "payload": None if kind == "revisit" else payload.decode()}


@dataclass(frozen=True)
class CaptureIndex:
    """Where an archive lies, and the first entry of each of its index files, in order."""

    folder: str
    files: list[dict]


def _writer(folder: str, when: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink(folder, "captures", "warc.gz")
        for batch in batches:
            places = []
            for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                payload = (html or "").encode()
                shown = base64.b32encode(bytes.fromhex(digest)).decode()
                if sink.at > FILE_BYTES:
                    sink.close()
                places.append(sink.put(record(page, url or "", payload, shown, refers, when)))
            if places:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, zip(*places))],
                                                 ["key", "page_id", "file", "offset", "length"])
        sink.close()
    return write


def _index_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = _Sink(folder, "index", "cdxj.gz")
        lines: list[str] = []
        directory: list[list] = []

        def close_block() -> None:
            key, page, _ = lines[0].split(" ", 2)
            _, offset, length = sink.put("\n".join(lines).encode())
            directory.append([key, int(page) if page else None, offset, length])
            lines.clear()

        for batch in batches:
            for key, page, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                lines.append(f"{key} {'' if page is None else page} " + json.dumps([file, offset, length]))
                if len(lines) == BLOCK:
                    close_block()
        if lines:
            close_block()
        if directory:
            name, offset, length = sink.put(json.dumps(directory).encode())
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (directory[0][0], name, offset, length)] + [pa.array([directory[0][1]], pa.int64())],
                ["key", "file", "offset", "length", "page_id"])
    return write


def archived(pages: DataFrame, least: int = 0, when: str | None = None) -> CaptureIndex:
    """Write pages (page_id, url, html) as WARC files with their index below the shared folder.

    The driver learns one row for each index file, of which there are as many as shuffle partitions.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    text = F.coalesce("html", F.lit(""))
    rows = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.sha1(text).alias("digest"), (F.octet_length(text) >= least).alias("large"))
    # payloads that occur more than once, written first: the planner sees their size and broadcasts them only if small
    repeated = materialized(
        rows.where("large").groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "holder"), "payloads")
    held = F.when(~F.col("large") | F.col("page_id").eqNullSafe(F.col("holder")), None).otherwise(F.col("holder"))
    records = rows.join(repeated, "digest", "left").select("key", "page_id", "url", "html", "digest", held.alias("refers_to"))
    when = when or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    entries = materialized(records.mapInArrow(_writer(folder, when), f"key string, page_id bigint, {PLACE}"), "captures")
    files = (entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
             .mapInArrow(_index_writer(folder), f"key string, {PLACE}, page_id bigint").collect())
    return CaptureIndex(folder, sorted((r.asDict() for r in files), key=lambda r: _order(r["key"], r["page_id"])))


def _order(key: str, page) -> tuple:
    """Entries in Spark's order: keys by their bytes, missing pages first."""
    return key.encode(), page is not None, page or 0


class _Reader:
    """Looks entries up; keeps the directory and the block that it read last."""

    def __init__(self, index: CaptureIndex):
        self.system, self.path = _files(index.folder)
        self.index = index
        self.bounds = [_order(f["key"], f["page_id"]) for f in index.files]
        self.now, self.block, self.input = None, None, None

    def _directory(self, number: int) -> None:
        if self.now != number:
            file = self.index.files[number]
            self.input = self.system.open_input_file(self.path(file["file"]))
            self.directory = json.loads(_unpacked(self.input.read_at(file["length"], file["offset"])))
            self.firsts = [_order(key, page) for key, page, _, _ in self.directory]
            self.now, self.block = number, None

    def _lines(self, place: int) -> None:
        if self.block != place:
            _, _, offset, length = self.directory[place]
            lines = [line.split(" ", 2) for line in _unpacked(self.input.read_at(length, offset)).decode().split("\n")]
            self.entries = [(_order(key, int(page) if page else None), where) for key, page, where in lines]
            self.block = place

    def find(self, low: tuple, high: tuple) -> Iterator[tuple[int | None, str, int, int]]:
        """Page and place of every entry from low to high, both included."""
        number = max(0, bisect.bisect_left(self.bounds, low) - 1)
        while number < len(self.bounds) and self.bounds[number] <= high:
            self._directory(number)
            place = max(0, bisect.bisect_left(self.firsts, low) - 1)
            while place < len(self.firsts) and self.firsts[place] <= high:
                self._lines(place)
                for at in range(bisect.bisect_left(self.entries, low, key=lambda e: e[0]), len(self.entries)):
                    (_, known, page), where = self.entries[at]
                    if self.entries[at][0] > high:
                        return
                    yield (page if known else None, *json.loads(where))
                place += 1
            number += 1


def _search(index: CaptureIndex, exact: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            found = []
            for key, page in zip(*(batch.column(i).to_pylist() for i in range(2))):
                low, high = (_order(key, page),) * 2 if exact else ((key.encode(),), (key.encode(), True, float("inf")))
                found.extend((key, *entry) for entry in reader.find(low, high))
                if len(found) >= 10_000:
                    yield _found(found)
                    found = []
            if found:
                yield _found(found)
    return search


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["key", "page_id", "file", "offset", "length"])


def _ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (file, offset, length) whose ranges lie close together."""
    group: list[tuple] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + GAP
                      or row[1] + row[2] > group[0][1] + MOST_READ):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _fetch(folder: str, with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_payload

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _files(folder)
        name, source, out = None, None, []
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))
        for group in _ranges(rows):
            if group[0][0] != name:
                name = group[0][0]
                source = system.open_input_file(path(name))
            first = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - first, first)
            for _, offset, length in group:
                said = parsed(_unpacked(data[offset - first: offset - first + length]))
                said |= {k: None if said[k] is None else int(said[k]) for k in ("page_id", "refers_to")}
                out.append([said[n] for n in names])
            if len(out) >= 1000 or with_payload:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    return fetch


def look_up(requests: DataFrame, index: CaptureIndex, exact: bool = True) -> DataFrame:
    """Places (key, page_id, file, offset, length) of the captures that requests name by key and page_id, or by key
    alone if not ``exact``; equal requests count once, and what has no capture gives no row."""
    wanted = requests.select("key", F.col("page_id").cast("long").alias("page_id") if exact else F.lit(None).cast("long").alias("page_id"))
    ordered = wanted.dropDuplicates().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(_search(index, exact), f"key string, page_id bigint, {PLACE}")


def fetched(places: DataFrame, index: CaptureIndex, with_payload: bool = False) -> DataFrame:
    """Read the records at places (file, offset, length) back: what ``parsed`` says of each, payloads if asked for."""
    ordered = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    fields = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
              + ", payload string" * with_payload)
    return ordered.mapInArrow(_fetch(index.folder, with_payload), fields)


def captures_of(urls: DataFrame, index: CaptureIndex, with_payload: bool = True) -> DataFrame:
    """Every capture of the URLs in column ``url``."""
    requests = urls.select(url_key(F.col("url")).alias("key"))
    return fetched(look_up(requests, index, exact=False), index, with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages (page_id, url, html), look each up by URL key and page_id, and tell what its record says:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = archived(pages)
    requests = pages.select(url_key(F.col("url")).alias("key"), "page_id")
    return fetched(look_up(requests, index), index).drop("url")
