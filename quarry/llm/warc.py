"""WARC archives, index first.

Each task writes its rows as gzip members of WARC records to a file of its own in the
shared folder and returns an index row per record: file, offset, length, URL, digest.
The index is a table.  Reading starts from the index alone: selected records are dealt
by file and range, sorted by offset, and neighbouring byte ranges are read at once.

Files open with a warcinfo record; records have dates, ids that follow from the row, and
revisits name the response's id, URL and date (WARC/1.1).  The page_id may be of any type.

Records with equal payloads of at least ``MIN_REVISIT`` bytes: the one with the least
page_id (then the first row) is the response, the others are revisits of it that carry
no payload.

Scale: the payload moves once (left join with the groups of equal digests, which Spark
splits where a digest is hot); files are named by attempt and only those in the index
count, so retried or lost tasks leave nothing wrong.  Memory is a range of at most
``RANGE_BYTES`` plus one record.

Defined results: a null html is the empty payload; null page_ids come last in a group
and refer nowhere; repeated rows are records of their own; a null URL is written as an
empty header; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import UID, read_table, shared_path, with_uid, written

MIN_REVISIT = 100
RANGE_BYTES = 8_000_000
GAP_BYTES = 65_536
FILE_BYTES = 1_000_000_000

RECORD = pa.schema(
    [("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
)
_INDEX_DDL = "url string, path string, offset bigint, length bigint, digest string, record_type string"
_RECORD_DDL = "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record_id(digest: str, uid: int) -> str:
    """The same for a row whoever computes it, so that a revisit can name the response's."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{digest}-{uid}')}>"


def _uri(url: str | None) -> str:
    url = url or ""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in url for c in "\r\n") else url


def _member(head: list[str], block: bytes) -> bytes:
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=3, mtime=0)


def info(date: str, name: str) -> bytes:
    """The record that opens each file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: quarry\r\nformat: WARC File Format 1.1\r\n")


def record(row: dict, date: str) -> bytes:
    """One WARC record as a gzip member.  A revisit carries the headers only; length and digest are those of the full payload."""
    payload, digest, kind = row["payload"], row["digest"], row["record_type"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(digest, row[UID])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(row['url'])}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["page"] is not None:
        head.append(f"WARC-Page-Id: {quote(row['page'])}")
    if kind == "revisit":
        first = row["first"]
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(digest, first[UID])}", f"WARC-Refers-To-Target-URI: {_uri(first['url'])}", f"WARC-Refers-To-Date: {date}"]
        if first["page_id"] is not None:
            head.append(f"WARC-Refers-To-Page: {quote(first['page_id'])}")
    return _member(head, block)


def parse(member: bytes) -> dict:
    """The record in one gzip member; raises if a payload isn't what its headers say."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {fields.get('WARC-Page-Id')} is not the one that was written")
    id_ = lambda name: unquote(fields[name]) if name in fields else None
    return {
        "page_id": id_("WARC-Page-Id"),
        "url": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": id_("WARC-Refers-To-Page"),
    }


def _write(batches, folder: str, date: str):
    fs, root = _file_system(folder)
    sink, path, at = None, None, 0
    try:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if sink is None or at > FILE_BYTES:
                    if sink is not None:
                        sink.close()
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, sink = f"{folder}/{name}", fs.open_output_stream(f"{root}/{name}", compression=None)
                    at = sink.write(info(date, name))
                member = record(r, date)
                sink.write(member)
                rows.append((r["url"], path, at, len(member), r["digest"], r["record_type"]))
                at += len(member)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], names=["page_id", "url", "path", "offset", "length", "digest", "record_type"])
    finally:
        if sink is not None:
            sink.close()


def _read(batches):
    """Rows (path, offset, length), sorted within the task: neighbours are read together."""
    fs = source = opened = None
    for batch in batches:
        rows = list(zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
        i, out = 0, []
        while i < len(rows):
            path, start, end = rows[i][0], rows[i][1], rows[i][1] + rows[i][2]
            j = i + 1
            while j < len(rows) and rows[j][0] == path and 0 <= rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - start <= RANGE_BYTES:
                end = rows[j][1] + rows[j][2]
                j += 1
            if path != opened:
                fs, local = _file_system(path)
                source, opened = fs.open_input_file(local), path
            data = source.read_at(end - start, start)
            out += [parse(data[o - start : o - start + n]) for _, o, n in rows[i:j]]
            if sum(r["payload_bytes"] for r in out) > RANGE_BYTES or j == len(rows):
                yield pa.RecordBatch.from_pylist(out, RECORD)
                out = []
            i = j


def with_revisits(pages: DataFrame) -> DataFrame:
    """Of page_id, url, html: page_id, row number, url, payload, digest, record_type and of a revisit the first row of its group."""
    rows = (
        with_uid(pages)
        .select(UID, "page_id", F.col("url").cast("string").alias("url"), "html")
        .withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
        .drop("html")
        .withColumn("digest", F.sha2("payload", 256))
    )
    first = (
        rows.filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", UID, "url")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    again = F.col("first").isNotNull() & (F.octet_length("payload") >= MIN_REVISIT) & (F.col(UID) != F.col("first")[UID])
    return rows.join(first, "digest", "left").select(
        "page_id", UID, "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("first")
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns the index, a table in the shared folder."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_revisits(pages)
    kind = rows.schema["page_id"].dataType.simpleString()
    text = F.col("first.page_id").cast("string")
    rows = rows.withColumn("first", F.when(F.col("first").isNotNull(), F.struct(text.alias("page_id"), F.col(f"first.{UID}").alias(UID), F.col("first.url").alias("url"))))
    rows = rows.withColumn("page", F.col("page_id").cast("string"))
    return written(rows.mapInArrow(lambda it: _write(it, folder, date), f"page_id {kind}, " + _INDEX_DDL), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of an index select, read by byte range."""
    kind = index.schema["page_id"].dataType
    ranges = index.select("path", "offset", "length").withColumn("block", F.floor(F.col("offset") / RANGE_BYTES))
    found = ranges.repartition("path", "block").sortWithinPartitions("path", "offset").select("path", "offset", "length").mapInArrow(_read, _RECORD_DDL)
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(read_table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""
