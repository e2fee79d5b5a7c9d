"""WARC archives of pages: an index first, then coalesced range reads of chosen records.

Writing gives one gzip member per record and one index row per record (file,
offset, length, url, digest). Reading takes index rows, sorts them by place,
joins neighbouring byte ranges into one read and parses the records.

Edge cases: a null payload is empty; an empty payload has a digest and may be
revisited like any other. A null id is written as an empty one, read back as null
and is smaller than any id. Of repeated rows with the largest id one is the
response. Control characters and spaces in a url are percent-encoded. An empty
table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridverify.llm.common import shared_folder, small_batches, staged

INDEX = "file string, offset long, length long, url string, digest string, id long, type string"
RECORDS = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes of an archive file before the writer starts the next.
FILE_BYTES = 1 << 28
#: Byte ranges with gaps up to this are read at once, up to RANGE_BYTES in all.
GAP_BYTES, RANGE_BYTES = 1 << 16, 1 << 22
#: Bytes of an archive file that one task reads at least.
SLICE_BYTES = 1 << 24


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(rid, url, payload: bytes, digest: str, refers) -> bytes:
    """One record; rid and refers are ids, refers is None for a response."""
    name = lambda i: f"<urn:x-record:{'' if i is None else i}>"
    revisit = refers is not None
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(rid)}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name(refers)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(v) if (v := x.removeprefix("<urn:x-record:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, size, digest, kind, refers


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _writer(folder: str):
    def write(batches):
        store, path = _filesystem(folder)
        store.create_dir(path, recursive=True)
        # A repeated attempt writes its own files; only the index of the one that counts is kept.
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, part, at = None, 0, 0
        for batch in batches:
            columns = {k: [] for k in ("file", "offset", "length", "url", "digest", "id", "type")}
            for rid, url, payload, revisit, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and at >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    name = f"{stem}-{part}.warc.gz"
                    out, part, at = store.open_output_stream(f"{path}/{name}", compression=None), part + 1, 0
                payload = payload or b""
                digest = base32_sha1(payload)
                data = gzip.compress(_record(rid, url, payload, digest, refers if revisit else None), 1, mtime=0)
                out.write(data)
                kind = "revisit" if revisit else "response"
                for k, v in zip(columns, (name, at, len(data), url, digest, rid, kind)):
                    columns[k].append(v)
                at += len(data)
            yield pa.RecordBatch.from_pydict(columns, schema=_INDEX_ARROW)
        if out is not None:
            out.close()

    return write


_INDEX_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("id", pa.int64()), ("type", pa.string())])
_RECORDS_ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def write_archives(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", min_revisit_bytes: int = 0,
) -> tuple[DataFrame, str]:
    """Write a record per row; returns the index, already stored, and the folder.

    Of rows with equal payloads of at least min_revisit_bytes the one with the
    largest id is a response and the others are revisits that refer to it. The
    rows must read the same each time, as tables do.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = rows.where(F.length("payload") >= min_revisit_bytes).select("id", "row", F.sha1("payload").alias("sha"))
    groups = keys.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
    # Only rows without payloads meet here, so a payload with many copies is a few bytes a row.
    revisits = (
        keys.join(groups.where("n > 1").select("sha", "best"), "sha")
        .where(F.col("row") != F.col("best.row"))
        .select("row", F.lit(True).alias("revisit"), F.col("best.id").alias("refers"))
    )
    marked = rows.join(revisits, "row", "left").select(
        "id", "url", "payload", F.coalesce("revisit", F.lit(False)).alias("revisit"), F.coalesce("refers", F.lit(None)).alias("refers")
    )
    index = staged(marked.mapInArrow(_writer(folder), INDEX), "warc-index")
    return index, folder


def _reader(folder: str):
    def read(batches):
        store, path = _filesystem(folder)
        name, file, spans, size = None, None, [], 0

        def records():
            """Read the collected ranges at once and cut the records out."""
            start = spans[0][0]
            data = file.read_at(spans[-1][0] + spans[-1][1] - start, start)
            rows = [_parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in spans]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), _RECORDS_ARROW.types)], schema=_RECORDS_ARROW
            )

        for batch in batches:
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns)):
                end = sum(spans[-1]) if spans else 0
                if spans and (f != name or o - end > GAP_BYTES or o + n - spans[0][0] > RANGE_BYTES):
                    yield records()
                    spans = []
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, store.open_input_file(f"{path}/{f}")
                spans.append((o, n))
        if spans:
            yield records()
        if file is not None:
            file.close()

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, by coalesced range reads in order of place.

    Files are cut into slices, and there is a task for about SLICE_BYTES of chosen records:
    the index says little about the size of what it points to, so Spark must not merge tasks by that.
    """
    small_batches(index.sparkSession)
    places = index.select("file", "offset", "length")
    chosen = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = 1 + chosen // SLICE_BYTES
    cut = places.repartition(tasks, "file", F.floor(F.col("offset") / SLICE_BYTES))
    ordered = cut.sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(folder), RECORDS)
