"""WARC archives with an index of byte ranges.

Writing: each task appends gzip members (one a record) to archive files of its
own and returns one index row for each record: file, offset, length, URL and
digest. The index is a Spark table, so only the files of tasks that committed
are ever referred to; what a lost executor left behind is never read.

Reading: index rows are sorted by file and offset, neighbouring ranges are
joined into larger reads, and only those bytes are fetched.

Payloads that occur more than once are stored once. The table of such digests
is written first, so that the planner knows its size: small, it is broadcast
and the payloads are not shuffled; large, both sides are shuffled by digest and
adaptive execution splits a digest that holds many rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexforge.session import shared_path, uri, written

INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, record_id long"
RECORD_SCHEMA = "record_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Largest gap between two ranges that one read still spans, and the most bytes of a read (a longer record is read alone).
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: A task begins another archive beyond this size.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(record_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    name = "" if record_id is None else str(record_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers (names in lower case) and, under ``payload``, the HTTP body of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    found["payload"] = rest[: int(found["content-length"])].partition(b"\r\n\r\n")[2]
    return found


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes one WARC record for each row of ``pages`` under ``folder``; returns the index, written as a table.

    A null payload is empty. Of rows with equal payloads of at least
    ``min_revisit_bytes``, the one with the largest id is a response and the
    others are revisits of it; a row with a null id revisits too, unless all of
    them are null. Repeated rows of that largest id are all responses. A null
    URL has no target header. A payload of any length is one record. An empty
    table writes nothing and has an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    base = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    heads = written(
        base.where(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max("record_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("head").isNotNull())
        .select("digest", "head"),
        "warc-heads",
    )
    rows = base.join(heads, "digest", "left").select(
        "record_id", "url", "payload", "digest",
        F.when(F.col("head").isNotNull() & (F.col("record_id").isNull() | (F.col("record_id") < F.col("head"))), F.col("head")).alias("refers_to"),
    )
    target = uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(target)
        fs.create_dir(path, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_id", pa.int64())])
        try:
            for batch in batches:
                found: list[tuple] = []
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    record_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(_record(record_id, url, payload, digest, refers_to, date)) + packer.flush()
                    out.write(data)
                    found.append((name, at, len(data), url, digest, record_id))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (any selection of index rows) points to under ``folder``.

    A response's digest and length are those of the payload as read, and a
    digest that differs from its header is an error. A revisit has them in its
    headers, and a null payload. An index row that is given twice is read twice;
    null ids and URLs come back as nulls, and without index rows nothing is read.
    A record of any length is read whole, by one task.
    """
    source = uri(folder)
    # the number is given: index rows are few bytes, and would be put into one task by size
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(source)
        schema = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        name, stream = None, None
        for batch in batches:
            ranges = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            first = 0
            while first < len(ranges):
                file, start, length = ranges[first]
                end, last = start + length, first + 1
                while last < len(ranges) and ranges[last][0] == file and ranges[last][1] <= end + GAP_BYTES and ranges[last][1] + ranges[last][2] - start <= READ_BYTES:
                    end, last = max(end, ranges[last][1] + ranges[last][2]), last + 1
                if file != name:
                    if stream is not None:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{path}/{file}")
                data = stream.read_at(end - start, start)
                found = [_parsed(zlib.decompress(data[at - start : at - start + n], 31)) for _, at, n in ranges[first:last]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)
                first = last
        if stream is not None:
            stream.close()

    return rows.mapInArrow(read, RECORD_SCHEMA)


def _parsed(data: bytes) -> tuple:
    record = parse_record(data)
    number = lambda x: int(x) if (x := x[len("<urn:record:") : -1]) else None
    digest = base64.b32decode(record["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload, size, refers_to = record["payload"], int(record["x-payload-length"]), None
    if record["warc-type"] == "revisit":
        payload, refers_to = None, number(record["warc-refers-to"])
    elif hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
        raise ValueError(f"record {record['warc-record-id']}: its payload differs from its digest")
    return number(record["warc-record-id"]), record.get("warc-target-uri"), record["warc-type"], digest, size, refers_to, payload


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archives of ``pages`` into the shared folder and reads every record back: a row for each row of ``pages``.

    Nulls, empty and very long payloads, ties and repeated rows are as :func:`write_archives`
    says; an empty table gives no rows, and other columns, whatever their names, aren't read.
    """
    folder = shared_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, **options), folder)
