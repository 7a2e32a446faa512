"""WARC archives with duplicate payloads resolved to revisit records.

Archives are written through Spark's own writer, so any file system that Spark
reaches will do and a lost executor's files are written again. A record is a
gzip member of its own; members are collected to archives of ARCHIVE_BYTES at
most, by their running sum of bytes, and each archive is a file. (Spark's text
writer ends a row with a separator; an empty gzip member serves as that, so a
file is a plain sequence of members.) The archives are read back by
Content-Length. Only headers are shuffled by payload digest: the largest page
id of a digest is its response, all other records of it become revisits. The
list of revisits then goes back to the archives that hold them, and every
archive is written anew with fresh headers: payloads are never shuffled. For
that, archives lie on shelves of SHELF_RECORDS records, about; a shelf's list is
broadcast while its archives are rewritten, shelf after shelf.

Record ids are urn:uuid, made from a run's number, the archive and the record's
place, so they are unique also where page ids repeat or are null, and a
rewritten record has a new one; the page id is a header field of its own.

Defined cases: a null payload is empty. Payloads under ``least`` bytes are all
responses. Rows that share a page id and a payload are one page: all of them
are responses if that id is the largest. A null page id is smaller than any
other; its records refer like others, and only if every id of a digest is
null are they responses. A null url is written as an empty target. A payload of
over ARCHIVE_BYTES is an archive of its own. Ids must be whole numbers, other
types are an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.errors import EngineError
from tessera.llm import scratch
from tessera.llm.textkit import pieces

#: bytes of an archive's records before compression; a reader task holds one archive at a time
ARCHIVE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: records of a shelf, about: the broadcast list of their revisits has 16 bytes for each at most
SHELF_RECORDS = 4_000_000
#: an empty gzip member
_END = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"

RECORDS = "archive string, place long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
ARCHIVES = "content binary, shelf int"


def _member(archive: str, place: int, page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record as a gzip member."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{place}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    packed = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(lines).encode()) + packed.compress(body + b"\r\n\r\n") + packed.flush()


def _info(archive: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {archive}.warc.gz\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + body + b"\r\n\r\n") + packed.flush()


class _Shelf:
    """Collects records to archives; names them by run, task and number, so that a repeated task writes the same."""

    def __init__(self, run: str, most: int, shelves: int = 1, first: int = 0):
        from pyspark import TaskContext

        self.most, self.shelves, self.first = most, shelves, first
        self.name, self.number = f"{run}-{TaskContext.get().partitionId():06d}", -1
        self._open()

    def _open(self) -> None:
        self.number += 1
        self.archive = f"{self.name}-{self.number:06d}"
        self.members, self.bytes, self.records = [], 0, 0

    def put(self, *record) -> Iterator[pa.RecordBatch]:
        size = len(record[-1]) + 500
        if self.records and self.bytes + size > self.most:
            yield self.close()
        self.members.append(_member(self.archive, self.records, *record))
        self.bytes += size
        self.records += 1

    def close(self) -> pa.RecordBatch:
        content, shelf = _info(self.archive) + b"".join(self.members), self.first + zlib.crc32(self.archive.encode()) % self.shelves
        self._open()
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary()), pa.array([shelf], pa.int32())], names=["content", "shelf"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            yield self.close()


def _records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive, one gzip member each."""
    while len(content):
        member = zlib.decompressobj(31)
        data = member.decompress(content)
        if not member.eof:
            raise ValueError("an archive ends inside a record")
        content = memoryview(member.unused_data)
        if not data:
            continue
        head = data.index(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in data[:head].decode("utf-8").split("\r\n")[1:])
        body = data[head + 4 : head + 4 + int(fields["Content-Length"])]
        if data[head + 4 + len(body) :] != b"\r\n\r\n":
            raise ValueError(f"{fields['WARC-Record-ID']} does not end where its length says")
        yield fields, body


def _number(text: str | None) -> int | None:
    return None if text in (None, "null") else int(text)


def _reader(payloads: bool):
    names = ["archive", "place", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string()] * payloads

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for archive, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
                place = 0
                for head, body in _records(memoryview(content.as_buffer())):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != n):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                    rows.append((archive, place, _number(head["X-Page-ID"]), head["WARC-Target-URI"], kind, _number(head.get("X-Refers-To-Page-ID")), digest, n, *([body.decode("utf-8")] if payloads else [])))
                    place += 1
                    size += len(body) if payloads else 0
                    if len(rows) >= 5_000 or size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``; payload digests of responses are checked."""
    return _archives(spark, path).mapInArrow(_reader(payloads), RECORDS + (", payload string" if payloads else ""))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


def _store(archives: DataFrame, path: str) -> None:
    rows = archives.select(F.col("content").cast("string").alias("value"), "shelf")
    rows.write.partitionBy("shelf").mode("append").option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _shelves(spark: SparkSession, path: str) -> list[str]:
    """The folders of a folder; as many as SHELF_RECORDS go into the records."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(x.getPath().toString() for x in found if x.isDirectory())


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write each row as a response record."""
    if pages.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise EngineError(f"page ids must be whole numbers, {id_col} is {pages.schema[id_col].dataType.simpleString()}")
    url = F.coalesce(F.regexp_replace(F.col(f"`{url_col}`"), "[\r\n]", ""), F.lit(""))
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"))
    run_id, most, shelves = uuid.uuid4().hex, ARCHIVE_BYTES, max(1, -(-pages.count() // SHELF_RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = _Shelf(run_id, most, shelves)
        for part in pieces(batches, "payload"):
            for page_id, link, text in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("payload"), strict=True):
                body = text.as_buffer().to_pybytes()
                yield from shelf.put(page_id, link, "response", None, hashlib.sha1(body).hexdigest(), len(body), body)
        yield from shelf.rest()

    _store(src.mapInArrow(run, ARCHIVES), path)


def verdicts(headers: DataFrame, least: int = 1000) -> DataFrame:
    """``shelf, archive, place, refers_to`` of the records that become revisits."""
    long = headers.filter(F.col("payload_bytes") >= least).select("shelf", "archive", "place", "page_id", "payload_digest")
    original = long.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 and original is not null").drop("n")
    return long.join(original, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("original"))).select("shelf", "archive", "place", F.col("original").alias("refers_to"))


def _rewriter(run_id: str, most: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = _Shelf(run_id, most, first=number)
        for b in batches:
            for content, places, to in zip(b.column("content"), b.column("places").to_pylist(), b.column("to").to_pylist(), strict=True):
                again, place = dict(zip(places or [], to or [], strict=True)), 0
                for head, body in _records(memoryview(content.as_buffer())):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    kind = "revisit" if place in again else "response"
                    yield from shelf.put(_number(head["X-Page-ID"]), head["WARC-Target-URI"], kind, again.get(place), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), body if kind == "response" else b"")
                    place += 1
        yield from shelf.rest()

    return run


def resolve(spark: SparkSession, source: str, target: str, least: int = 1000) -> None:
    """Read the archives under ``source`` and write them to ``target`` with duplicates as revisits."""
    headers = scratch.table(read(spark, source).withColumn("shelf", F.regexp_extract("archive", "/shelf=([0-9]+)/", 1).cast("int")), "headers")
    lists = verdicts(headers, least).groupBy("shelf", "archive").agg(F.collect_list(F.struct("place", "refers_to")).alias("again"))  # of one archive, so bounded
    lists = scratch.table(lists, "revisits")
    for folder in _shelves(spark, source):
        number = int(folder.rpartition("=")[2])
        mine = F.broadcast(lists.filter(F.col("shelf") == number).select("archive", "again"))  # bounded by SHELF_RECORDS
        met = _archives(spark, folder).join(mine, "archive", "left").select("content", F.transform("again", lambda x: x["place"]).alias("places"), F.transform("again", lambda x: x["refers_to"]).alias("to"))
        _store(met.mapInArrow(_rewriter(uuid.uuid4().hex, ARCHIVE_BYTES, number), ARCHIVES), target)


def deduplicated(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Archive ``pages``, resolve the archives, and return the records of the result as read back."""
    spark = pages.sparkSession
    raw, done = scratch.new_path(spark, "raw"), scratch.new_path(spark, "warc")
    archive(pages, raw)
    if not _shelves(spark, raw):  # no rows
        return spark.createDataFrame([], RECORDS)
    resolve(spark, raw, done, least)
    scratch.delete(spark, raw)
    return read(spark, done)
