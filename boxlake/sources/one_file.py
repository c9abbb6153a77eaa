"""One ordered file, or one archive of it, written by many tasks.

Rows are sorted by range; each task writes its part beside the target and says how long it is, which gives every part its
place in the file. A second job copies the parts to their places, and the file gets its name last. An archive of it is made of
ranges of the file, each deflated by itself; their CRC-32s combine to that of the whole. A task that is run again writes a part
of another name, or the same bytes to the same place. The target's folder must be one that driver and tasks share.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 8 << 20
#: CRC-32's polynomial, reversed.
_POLYNOMIAL = 0xEDB88320
_NAMES = {"part": pa.int32(), "path": pa.string(), "rows": pa.int64(), "size": pa.int64()}
_SCHEMA = "part int, path string, rows long, size long"
#: A last deflate block that holds nothing: it ends what full flushes have left open.
_LAST = b"\x03\x00"


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for row in matrix:
        if not v:
            break
        out ^= row * (v & 1)
        v >>= 1
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two texts one after the other, from that of each and the second's length: zeros move the first by a matrix."""
    step = [_POLYNOMIAL, *(1 << i for i in range(31))]  # what one zero bit does
    for _ in range(3):
        step = [_times(step, row) for row in step]
    while length:
        if length & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        length >>= 1
    return first ^ second


def _parts(rows: DataFrame, order: list[str], text: str, folder: str, parts: int | None) -> list[dict]:
    """Writes the parts and returns what is said of them, in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        path = f"{folder}/{part:07d}-{uuid.uuid4().hex}"
        with open(path, "wb") as sink:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    sink.write(data)
                    size += len(data)
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({k: pa.array([v], t) for (k, t), v in zip(_NAMES.items(), (part, path, n, size), strict=True)})

    ranged = rows.select(*order, F.col(text).alias("_text"))
    ranged = ranged.repartitionByRange(parts, *order) if parts else ranged.repartitionByRange(*order)
    made = ranged.sortWithinPartitions(*order).select("_text").mapInArrow(write, _SCHEMA)
    return [r.asDict() for r in sorted(made.collect(), key=lambda r: r["part"]) if r["rows"]]


def _assemble(df: DataFrame, target: str, pieces: list[tuple[str, int, int]], around: list[tuple[int, bytes]]) -> None:
    """Copies files to their places in target, (path, place, bytes left out at its start), by tasks; around is little and written here."""
    draft = f"{target}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        for place, data in around:
            f.seek(place)
            f.write(data)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(draft, "r+b") as sink:
                for path, place, skip in zip(*(batch.column(c).to_pylist() for c in ("path", "place", "skip")), strict=True):
                    with open(path, "rb") as source:
                        source.seek(skip)
                        sink.seek(place)
                        shutil.copyfileobj(source, sink, PIECE)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    spark = df.sparkSession
    if pieces:
        table = spark.createDataFrame(pieces, "path string, place long, skip long").repartition(max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism)))
        table.mapInArrow(copy, "n long").agg(F.sum("n")).first()
    os.replace(draft, target)


def write(rows: DataFrame, order: list[str], text: str, target: str, head: bytes = b"", between: bytes = b"", tail: bytes = b"", archive: str | None = None, parts: int | None = None) -> int:
    """Writes head, the column text of rows in order with `between` between them, and tail to target; returns the rows' number.

    archive: also an archive whose only member is the file, deflated by the tasks and put together like the file. parts:
    into how many ranges the rows are dealt (else as Spark does). Rows that tie in order follow in any order; a null text is no row.
    """
    folder = f"{os.path.dirname(os.path.abspath(target))}/.{os.path.basename(target)}-{uuid.uuid4().hex}"
    Path(folder).mkdir(parents=True)
    try:
        # Each text brings what stands before it; the very first leaves it out.
        prefixed = rows.where(F.col(text).isNotNull()).withColumn("_said", F.concat(F.lit(bytearray(between)), F.col(text).cast("binary")))
        made = _parts(prefixed, order, "_said", folder, parts)
        pieces, at = [], len(head)
        for i, p in enumerate(made):
            skip = len(between) if i == 0 else 0
            pieces.append((p["path"], at, skip))
            at += p["size"] - skip
        _assemble(rows, target, pieces, [(0, head), (at, tail)])
        if archive:
            _archive(rows, target, archive, folder)
        return sum(p["rows"] for p in made)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _archive(df: DataFrame, target: str, archive: str, folder: str, piece: int = 64 << 20) -> None:
    """An archive of target alone: ranges of it are deflated by tasks, each from a fresh start, and joined."""
    size, spark = os.path.getsize(target), df.sparkSession
    name = os.path.basename(target).encode()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                path, crc, packer, left = f"{folder}/z{at:015d}-{uuid.uuid4().hex}", 0, zlib.compressobj(6, zlib.DEFLATED, -15), min(piece, size - at)
                with open(target, "rb") as source, open(path, "wb") as sink:
                    source.seek(at)
                    while left and (data := source.read(min(PIECE, left))):
                        left, crc = left - len(data), zlib.crc32(data, crc)
                        sink.write(packer.compress(data))
                    sink.write(packer.flush(zlib.Z_FULL_FLUSH))
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "path": pa.array([path], pa.string()), "crc": pa.array([crc], pa.int64()), "packed": pa.array([os.path.getsize(path)], pa.int64())})

    ranges = spark.range(0, size, piece, max(1, -(-size // piece)))
    made = sorted(ranges.mapInArrow(pack, "at long, path string, crc long, packed long").collect(), key=lambda r: r["at"])
    crc, packed = 0, sum(r["packed"] for r in made) + len(_LAST)
    for r in made:
        crc = joined_crc(crc, r["crc"], min(piece, size - r["at"]))
    # The sizes stand in eight bytes, so that no file is too large; time is the format's first day.
    wide = struct.pack("<HHQQ", 1, 16, size, packed)
    fixed = struct.pack("<HHHHHIIIHH", 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide))
    local = b"PK\x03\x04" + fixed + name + wide
    entry = b"PK\x01\x02" + struct.pack("<H", 45) + fixed + struct.pack("<HHHII", 0, 0, 0, 0o644 << 16, 0) + name + wide
    at, pieces = len(local), []
    for r in made:
        pieces.append((r["path"], at, 0))
        at += r["packed"]
    start = at + len(_LAST)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start) + b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), min(start, 0xFFFFFFFF), 0)
    _assemble(df, archive, pieces, [(0, local), (at, _LAST + entry + (end64 if start >= 0xFFFFFFFF else b"") + end)])
