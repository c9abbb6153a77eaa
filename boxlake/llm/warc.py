"""WARC archives with an index: records are written once, and read back by coalesced byte ranges of the index.

A writing task gives its archives names of their own attempt and returns one index row a record (archive, offset, length,
URL, digest). The index, stored as a table, is what commits them: archives of attempts that were lost are in no index.
Readers sort the selected rows of an archive by offset, join ranges with small gaps, and read each range once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pa_schema, stored

#: Bytes after which a task begins a new archive; the widest gap that a read goes over; bytes of a read (one record at least).
ARCHIVE, GAP, READ = 64 << 20, 64 << 10, 4 << 20
#: Bytes of records that a reading task is dealt, about.
TASK = 128 << 20
INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> tuple[bytes, str, str]:
    """A gzip member with one record, its payload digest and its type. Line ends in the URL become %0D and %0A."""
    payload = (html or "").encode()
    digest, kind = _digest(payload), "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0), digest, kind


def parse_record(member: bytes) -> tuple:
    """The columns of RECORD; a block whose length or digest is not as its header says raises ValueError."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if fields.get(k) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if len(rest) != len(block) + 4 or payload is not None and (len(payload) != number("X-Payload-Length") or _digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number("X-Page-Id"), fields["WARC-Target-URI"], payload, number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page-Id")


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def first_copies(pages: DataFrame) -> DataFrame:
    """page_id and refers_to of those pages whose payload a page of smaller page_id has as well."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digests = stored(pages.select("page_id", F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size")), "payloads")
    groups = digests.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    # The hash as a further key deals both sides anew, so that Spark can split a payload of very many pages.
    key = F.xxhash64("sha")
    found = digests.withColumn("k", key).join(groups.withColumn("k", key), ["k", "sha", "size"])
    return found.where("not page_id <=> refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes every row of pages as a record to archives in folder (any URI that pyarrow opens) and returns the index.

    Of equal payloads the record of the smallest page_id is a response, the others revisit it. Rows that repeat that
    page_id and payload are all responses, as are those with no page_id in their group. A null html is an empty payload,
    a null url an empty one; other columns are ignored; an empty table gives an empty index and no archive. A payload of
    any length is one record, held whole by the task that writes it. The index is stored, so records are written once
    however often it is read.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    copies = first_copies(pages).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to")
    sha = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    rows = pages.withColumn("sha", sha).join(copies, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")

    names = [f.split()[0] for f in INDEX.split(", ")]
    schema = pa_schema(pages.sparkSession, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _opened(folder)
        disk.create_dir(root, recursive=True)
        sink, name, offset = None, "", 0
        for batch in batches:
            out = []
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if sink is None or offset >= archive_bytes:
                    if sink is not None:
                        sink.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = disk.open_output_stream(f"{root}/{name}", compression=None)
                member, digest, kind = make_record(page_id, url, html, refers_to)
                sink.write(member)
                out.append((page_id, name, offset, len(member), url, digest, kind, refers_to))
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], names=names)
        if sink is not None:  # before the task ends, so before its index rows count
            sink.close()

    return stored(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX), "warc-index")


def _ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) pairs joined to (from, to, members)."""
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


def read_records(index: DataFrame, folder: str, gap: int = GAP, most: int = READ) -> DataFrame:
    """The records (columns of RECORD) that the rows of index select; each archive is read in order, by joined ranges.

    An empty index gives an empty result. A record longer than `most` is read alone, whole.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = pa_schema(index.sparkSession, RECORD)

    def run(batches):
        disk, root = _opened(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            for name in dict.fromkeys(r[0] for r in rows):
                with disk.open_input_file(f"{root}/{name}") as f:
                    for a, b, members in _ranges([r[1:] for r in rows if r[0] == name], gap, most):
                        data = f.read_at(b - a, a)
                        found = [parse_record(data[o - a : o - a + n]) for o, n in members]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], schema.field(n).type) for i, n in enumerate(names)], schema=schema)

    # Whole archives are dealt out; within a task rows come by archive and offset. Tasks are counted by the bytes to be
    # read: left to the size of the index rows, which are tiny, adaptive execution would make one task of many archives.
    archives, size = index.agg(F.count_distinct("archive"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(math.ceil(size / TASK), min(archives, index.sparkSession.sparkContext.defaultParallelism), 1)
    return index.select("archive", "offset", "length").repartition(tasks, "archive").sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; edge cases as at write_archives()."""
    folder = new_path(spark, "archives")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB, without archives: five hex digits of a SHA-1 are four of base32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS least FROM p),
r AS (SELECT page_id, payload, CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS twenty FROM q)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform(twenty, lambda v: [v // 32768, v // 1024 % 32, v // 32 % 32, v % 32])), lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(d + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
