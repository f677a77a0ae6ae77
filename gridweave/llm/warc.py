"""WARC archives: written with an index of records, read back by coalesced byte ranges.

Writing: each task streams its rows into archives of its own (one gzip member a record) through a file system opened by
URI, and returns offset, length, URL and digest of every record. The returned rows are the index; a task that is run
again writes new files, and what a lost attempt left behind is in no index. Reading: the selected index rows are dealt out
by ranges of (archive, offset), neighbours less than GAP apart are read as one range, and each record is cut out of it.

Of records with equal payloads of at least `least` bytes the one with the largest id is the response and the others
revisit it; smaller payloads are all responses. Defined results: null payload counts as empty, null URL is left out of the
header, null ids count as smallest (if a group has no other, all are responses), rows that share the largest id are all
responses, an empty table makes an empty index, and columns besides the three that are named are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import column_list, fresh_dir, settle

GAP, RANGE, ARCHIVE = 64 << 10, 8 << 20, 1 << 30
INDEX = "page_id long, path string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (or of a plain local path) and the path in it."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def _urn(page_id: int | None, digest: str) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}")).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record; a revisit has the HTTP header of its response but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [b"WARC/1.1", b"WARC-Type: revisit" if revisit else b"WARC-Type: response", b"WARC-Record-ID: " + _urn(page_id, digest), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to, digest), b"X-Refers-To-Page: %d" % refers_to]
    if page_id is not None:
        head.append(b"X-Page: %d" % page_id)
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one uncompressed record, `payload` None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields[b"warc-type"].decode()
    if kind == "response" and len(payload) != size:
        raise ValueError("the payload is cut off")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get(b"warc-target-uri")
    return {
        "page_id": number(b"x-page"),
        "url": None if url is None else url.decode(),
        "record_type": kind,
        "refers_to": number(b"x-refers-to-page"),
        "payload_bytes": size,
        "payload_digest": fields[b"warc-payload-digest"].decode().removeprefix("sha1:"),
        "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit of every row.

    The groups that share a payload are found on digests alone; their join with the pages leaves a hot payload's rows
    to the adaptive split of skewed partitions, and rows of one page need no shuffle if the groups are few.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id"))), F.lit(False))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, out: str | None = None, least: int = 1000, level: int = 4) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the settled index."""
    out = out or fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(out)
        fs.create_dir(base, recursive=True)
        stream, path, at = None, "", 0
        for b in batches:
            found = []
            for page_id, url, payload, digest, refers_to, revisit in zip(*(column_list(b, n) for n in b.schema.names), strict=True):
                if stream is None or at >= ARCHIVE:
                    if stream is not None:
                        stream.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    stream, path, at = fs.open_output_stream(f"{base}/{name}", compression=None), f"{out}/{name}", 0
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, payload, digest, refers_to, revisit)) + z.flush()
                stream.write(data)
                found.append((page_id, path, at, len(data), url, digest, "revisit" if revisit else "response", refers_to))
                at += len(data)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*found, strict=True)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if stream is not None:
            stream.close()

    return settle(with_revisits(pages, least).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(path, start, end, places of rows) of the reads that cover (path, offset, length) rows sorted by path and offset."""
    i = 0
    while i < len(rows):
        path, start, n = rows[i]
        end, own = start + n, [i]
        while (i := i + 1) < len(rows) and rows[i][0] == path and rows[i][1] - end <= GAP and rows[i][1] + rows[i][2] - start <= RANGE:
            own.append(i)
            end = max(end, rows[i][1] + rows[i][2])
        yield path, start, end, own


def read(selected: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """The records of the selected index rows, as RECORD. Rows may repeat; only their ranges of the archives are read."""
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile | None] = ("", None)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for b in batches:
            rows = list(zip(*(column_list(b, n) for n in ("path", "offset", "length")), strict=True))
            for path, start, end, own in ranges(rows):
                if path != opened[0]:
                    fs, at = file_system(path)
                    opened = (path, fs.open_input_file(at))
                data = opened[1].read_at(end - start, start)
                found = [parse(zlib.decompress(data[rows[i][1] - start : rows[i][1] - start + rows[i][2]], 31)) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array([x[n.split()[0]] for x in found], k) for n, k in zip(RECORD.split(", "), kinds, strict=True)], names=[n.split()[0] for n in RECORD.split(", ")])

    placed = selected.select("path", "offset", "length").repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(run, RECORD)
