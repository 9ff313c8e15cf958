"""WARC archives: a writer, and a reader that splits gzip files at any byte.

Every record is a gzip member of its own.  A reading task scans its byte range
for the magic bytes of gzip, takes a candidate for a record only if it decodes
to a WARC header, and owns the records that start inside its range; from a
record's end it goes on at the next without scanning.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, unused

MAGIC = b"\x1f\x8b\x08"
RECORD_ID = "urn:page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never replaced by a revisit.
REVISIT_BYTES = 1000
SPLIT_BYTES = 32 << 20
_BLOCK = 1 << 20
_HEADER_MOST = 1 << 20


def _record(kind: str, record_id: str, date: str, fields: dict[str, str], block: bytes, level: int) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **fields, "Content-Length": str(len(block))}.items())]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with what the writer needs: payload, its digest, and refers_to (null: a response of its own).

    Of equal payloads of at least ``least`` bytes the one with the largest
    page_id is the response.  Rows that repeat this id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top"))
    groups = cut(groups.where("n > 1").select("digest", "top"))
    # Both sides are plain exchanges, so adaptive execution splits the partition of a hot payload.
    joined = rows.join(groups, "digest", "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("top")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``; returns (file, bytes, records).

    A null html is an empty payload, a null url an empty target.  A null page_id
    gives a record id without a number.  An empty table writes nothing.  Further
    columns are ignored.  Files appear under their final names only when they
    are whole, and a repeated task replaces them with the same ones.
    """
    rows = revisits(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        files, at = pafs.FileSystem.from_uri(path)
        files.create_dir(at, recursive=True)
        out, size, count, roll, unnamed, done = None, 0, 0, 0, 0, []

        def close() -> None:
            nonlocal out, size, count, roll
            if out is not None:
                out.close()
                final = f"{at}/part-{task:06d}-{roll:04d}.warc.gz"
                files.move(f"{at}/.part-{task:06d}-{roll:04d}-{attempt}", final)
                done.append((final, size, count))
                out, size, count, roll = None, 0, 0, roll + 1

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{at}/.part-{task:06d}-{roll:04d}-{attempt}")
                    size += out.write(_record("warcinfo", f"urn:archive:{task}-{roll}", date, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", level)) or 0
                    size = out.tell()
                fields = {"WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}", "Content-Type": "application/http;msgtype=response"}
                if page_id is None:
                    name = f"{RECORD_ID}:{task}-{unnamed}"
                    unnamed += 1
                else:
                    name = f"{RECORD_ID}{page_id}"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if refers is None:
                    out.write(_record("response", name, date, fields, http + payload, level))
                else:
                    out.write(_record("revisit", name, date, fields | {"WARC-Refers-To": f"<{RECORD_ID}{refers}>", "WARC-Profile": IDENTICAL}, http, level))
                size, count = out.tell(), count + 1
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    return cut(rows.mapInArrow(run, "file string, bytes bigint, records bigint"))


class _Bytes:
    """A file read in blocks; ``at`` gives bytes of any place."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.held = handle, size, 0, b""

    def at(self, place: int, n: int) -> memoryview:
        n = min(n, self.size - place)
        if n <= 0:
            return memoryview(b"")
        if place < self.start or place + n > self.start + len(self.held):
            self.held, self.start = self.handle.read_at(min(max(n, _BLOCK), self.size - place), place), place
        return memoryview(self.held)[place - self.start : place - self.start + n]


def _member(source: _Bytes, place: int) -> tuple[dict[str, str], str, bytes, int] | None:
    """The WARC record whose gzip member starts at ``place``: (fields, version, block, end); None if there is none."""
    inflate, out, at = zlib.decompressobj(31), bytearray(), place
    head = -1
    fields: dict[str, str] = {}
    try:
        while not inflate.eof:
            chunk = source.at(at, 1 << 16)
            if not len(chunk):
                return None
            at += len(chunk)
            out += inflate.decompress(chunk)
            if head < 0:
                if not out.startswith(b"WARC/"[: len(out)]):
                    return None
                head = out.find(b"\r\n\r\n")
                if head < 0 and len(out) > _HEADER_MOST:
                    return None
                if head >= 0:
                    lines = out[:head].decode("utf-8", "replace").split("\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
                        return None
    except zlib.error:
        return None
    if head < 0 or len(out) < head + 4 + int(fields["content-length"]):
        return None
    return fields, lines[0], bytes(out[head + 4 : head + 4 + int(fields["content-length"])]), at - len(inflate.unused_data)


def _records(source: _Bytes, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, bytes, fields, block) of the records that start in [start, end)."""
    place = start
    while place < end:
        if bytes(source.at(place, 3)) != MAGIC:
            piece = bytes(source.at(place, min(_BLOCK, end + 2 - place)))
            found = piece.find(MAGIC)
            if found < 0:
                place += max(1, len(piece) - 2)
                continue
            place += found
            if place >= end:
                return
        record = _member(source, place)
        if record is None:
            place += 1
            continue
        fields, _, block, after = record
        yield place, after - place, fields, block
        place = after


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the .warc.gz files below ``path``.

    Columns: file, offset, length (of the member), record_type, record_id,
    refers_to, target_uri, fields (all of the header, names in lower case),
    http_length (Content-Length of the HTTP head, null without one) and payload
    (behind the HTTP head where there is one).  A folder without archives gives
    no rows.  Bytes that belong to no record are skipped.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    splits = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    n = splits.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for name, length, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                files, at = pafs.FileSystem.from_uri(name)
                with files.open_input_file(at) as handle:
                    for offset, size, fields, block in _records(_Bytes(handle, length), start, min(start + split_bytes, length)):
                        http, payload = None, block
                        if fields.get("content-type", "").startswith("application/http"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            sizes = [line.partition(b":")[2].strip() for line in head.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
                            http = int(sizes[0]) if sizes and sizes[0].isdigit() else None
                        bare = lambda x: x.strip("<>") if x else None
                        rows.append((name, offset, size, fields["warc-type"], bare(fields.get("warc-record-id")), bare(fields.get("warc-refers-to")), fields.get("warc-target-uri"), list(fields.items()), http, payload))
                        held += len(payload) + 1000
                        if held > 8_000_000:
                            yield _record_rows(rows)
                            rows, held = [], 0
        yield _record_rows(rows)

    schema = "file string, offset bigint, length bigint, record_type string, record_id string, refers_to string, target_uri string, fields map<string,string>, http_length bigint, payload binary"
    return splits.repartition(max(1, min(n, 100_000))).mapInArrow(run, schema)


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "http_length": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def whole_records(records: DataFrame) -> DataFrame:
    """Drop records that lie inside another record of their file.

    Only archives that store other archives uncompressed can have such: a task
    whose range begins inside the stored one takes its records for its own.
    """
    own = unused(records, "inner")["inner"]
    spans = records.select("file", "offset", (F.col("offset") + F.col("length")).alias("end"))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    inner = spans.withColumn(own, F.max("end").over(before) > F.col("offset")).where(own).select("file", "offset")
    return records.join(inner, ["file", "offset"], "left_anti")


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of pages."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(RECORD_ID) + 1}) AS bigint)")
    response = F.col("record_type") == "response"
    stated = F.col("fields").getItem("warc-payload-digest")
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(_hex_of_base32(F.substring(stated, 6, 32))).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def _hex_of_base32(text):
    """Base 32 in, lower-case hexadecimal out: 8 characters are 10 digits."""
    alphabet, bits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv"
    digits = F.translate(text, alphabet, bits)
    parts = [F.lpad(F.lower(F.conv(F.substring(digits, 1 + 8 * i, 8), 32, 16)), 10, "0") for i in range(4)]
    return F.concat(*parts)


