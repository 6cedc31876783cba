"""WARC archives: a writer of one gzip member per record, and a reader that splits files.

Reading tasks get byte ranges.  A task looks for the gzip magic in its range, takes a candidate
for a member only if it decodes to a WARC header, and owns the records that start inside,
reading on past the range's end to finish its last one.  No index is needed.

Defined results: a null payload is an empty one; null urls are written as an empty target;
records with equal page_id are kept; an empty table gives no files and no rows; further columns
are ignored.  Of records with equal payloads of at least `revisit_bytes`, that with the largest
page_id is the response and the others revisit it; without a page_id (null) a record is always
a response."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import open_fs, partitions, stored, table, workspace

GZIP = b"\x1f\x8b\x08"
SALTS = 16
RECORD = "record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to of each record.  Groups of equal
    payloads are summed before the shuffle, and met again over salted keys: a group may hold
    most rows."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    large = F.length("payload") >= revisit_bytes
    groups = rows.filter(large & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").select(F.col("payload_digest").alias("d"), "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(groups, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")) & large, "left")
    target = F.when(F.col("response") != F.col("page_id"), F.col("response"))
    return met.select("page_id", "url", "payload", "payload_digest", target.alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def member(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member.  A revisit carries the HTTP header with the length of the
    payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head += [f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{coded}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    # a stored archive inside the payload must not look like a member of this one
    for make in (_deflated, _fixed, _split):
        out = make(data)
        if not any(header_at(out, at) for at in _magics(out, 1)):
            return out
    raise ValueError(f"record {record_id(page_id)} can't be written so that no archive shows inside")


def _deflated(data: bytes, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31, 9, strategy)
    return z.compress(data) + z.flush()


def _fixed(data: bytes) -> bytes:
    return _deflated(data, zlib.Z_FIXED)


def _split(data: bytes) -> bytes:
    """Stored, with a block's header inside every magic."""
    z = zlib.compressobj(0, zlib.DEFLATED, 31, 9)
    cuts = [0, *(at + 1 for at in _magics(data, 0)), len(data)]
    parts = [z.compress(data[a:b]) + z.flush(zlib.Z_FULL_FLUSH) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return b"".join(parts) + z.flush()


def _magics(data: bytes, start: int) -> Iterator[int]:
    while (start := data.find(GZIP, start)) >= 0:
        yield start
        start += 1


def header_at(data, at: int) -> dict[str, str] | None:
    """Fields of the WARC header that a gzip member at this place decodes to, else None."""
    z = zlib.decompressobj(31)
    try:
        text = z.decompress(bytes(data[at : at + 8192]), 16384)
    except zlib.error:
        return None
    return _fields(text)[0] if text.startswith(b"WARC/1.") else None


def _fields(record: bytes) -> tuple[dict[str, str], int]:
    end = record.find(b"\r\n\r\n")
    lines = record[: end if end >= 0 else len(record)].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


MANIFEST = "path string, bytes long, records long"


def write_warc(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes planned records, a file per task, and returns the stored manifest.  A task that runs
    again writes another file; only files in the manifest count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    fs, at = open_fs(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                data = member(*(batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), date)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return stored(records.mapInArrow(write, MANIFEST), "warc-manifest")


class Window:
    """Bytes of a file from a place on, read as needed and forgotten behind."""

    def __init__(self, f, start: int, size: int, step: int = 1 << 20):
        self.f, self.base, self.size, self.step, self.data = f, start, size, step, bytearray()
        f.seek(start)

    def reach(self, end: int) -> int:
        """Reads up to `end` at least, unless the file ends before; returns the end of what is there."""
        while self.base + len(self.data) < min(end, self.size):
            more = self.f.read(max(self.step, min(end, self.size) - self.base - len(self.data)))
            if not more:
                break
            self.data += more
        return self.base + len(self.data)

    def forget(self, before: int) -> None:
        if before - self.base > self.step:
            del self.data[: before - self.base]
            self.base = before


def read_range(f, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records that start in [start, end) of an open file."""
    w, at, aligned = Window(f, start, size), start, start == 0
    while at < end:
        w.forget(at)
        if not aligned:
            there = w.reach(min(at + (1 << 20), end + 2))
            k = w.data.find(GZIP, at - w.base)
            if k < 0:
                at = there - 2 if there < min(end + 2, size) else end
                continue
            at = w.base + k
            if at >= end:
                return
            w.reach(at + 8192)
            if header_at(memoryview(w.data), at - w.base) is None:
                at += 1
                continue
        z, parts, p = zlib.decompressobj(31), [], at
        while not z.eof:
            there = min(w.reach(p + 1), p + (1 << 16))
            if p >= there:
                raise EOFError(f"a record at {at} is cut short")
            parts.append(z.decompress(bytes(memoryview(w.data)[p - w.base : there - w.base])))
            p = there
        at, record = p - len(z.unused_data), b"".join(parts)
        aligned = True
        if not record.startswith(b"WARC/1."):
            raise ValueError("a member holds no WARC record")
        fields, head = _fields(record)
        block = record[head : head + int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is shorter than its header says")
        yield fields, block


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").rstrip(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """Records of the files (path, bytes), read by ranges of split_bytes.  The payload of a
    response is held against its digest."""
    spark = files.sparkSession
    steps = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(steps).alias("begin"))
    schema = RECORD if payloads else RECORD.rpartition(",")[0]
    names = [c.split()[0] for c in RECORD.split(", ")][: None if payloads else -1]
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[: len(names)], strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                fs, path = open_fs(r["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for fields, block in read_range(f, r["bytes"], r["begin"], min(r["begin"] + split_bytes, r["bytes"])):
                        cut = block.find(b"\r\n\r\n") + 4
                        http, payload, kind = _fields(block[:cut])[0], block[cut:], fields["warc-type"]
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("a payload does not match its digest")
                        rows.append((fields["warc-record-id"], kind, fields.get("warc-target-uri"), _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to")), int(http["content-length"]), digest, payload)[: len(names)])
                        held += len(payload) if payloads else 100
                        if held > 8 << 20:
                            yield given(rows)
                            rows, held = [], 0
                if rows:
                    yield given(rows)

    return ranges.repartition(partitions(spark), "path", "begin").mapInArrow(read, schema)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    files = write_warc(plan_records(table(spark, sf_dir, "pages")), workspace(spark, "warc"))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS response FROM p WHERE strlen(h) >= 1000 GROUP BY d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND strlen(h) >= 1000
"""
