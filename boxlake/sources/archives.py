"""ZIP archives as tables of their members, dealt to tasks by what they hold rather than an archive a task.

The driver walks an archive's central directory once, in constant memory, and cuts it into slices of members with about
PARTITION compressed bytes or at most MEMBERS members. A task reads its slice of the directory and then its members only. Archives
beyond 4 GB or 65,535 members (ZIP64) are read like any other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DatasetError

#: Compressed bytes and members of a slice; bytes of the directory that are read at once; bytes that are unpacked at once.
PARTITION, MEMBERS, WINDOW, PIECE = 64 << 20, 20_000, 1 << 20, 1 << 20
SCHEMA = "archive string, pos int, name string, is_dir boolean, size bigint, crc_ok boolean, method int, compressed bigint, offset bigint, crc bigint"
#: Fixed values of the format: signatures, and the lengths of the records' fixed parts.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _LOCATOR_SIZE, _END64_SIZE, _ENTRY_SIZE, _LOCAL_SIZE = 22, 20, 56, 46, 30


class Member(NamedTuple):
    name: str
    flags: int
    method: int
    crc: int
    compressed: int
    size: int
    offset: int


@dataclass
class Slice(InputPartition):
    archive: str
    at: int  # where in the file the slice's first directory entry begins
    first: int  # its number
    count: int
    shift: int  # what all offsets lack, in a file with something before its archive


def directory(f: BinaryIO, path: str) -> tuple[int, int, int]:
    """(place, members, shift) of an archive's central directory."""
    size = f.seek(0, 2)
    f.seek(max(0, size - _END_SIZE - 65_535))
    tail = f.read()
    at = tail.rfind(_END)
    if at < 0 or len(tail) - at < _END_SIZE:
        raise DatasetError(f"{path} is no ZIP archive")
    end = size - len(tail) + at
    _, _, _, count, length, start = struct.unpack("<HHHHII", tail[at + 4 : at + 20])
    stop = end
    if end >= _LOCATOR_SIZE:
        f.seek(end - _LOCATOR_SIZE)
        locator = f.read(_LOCATOR_SIZE)
        if locator[:4] == _LOCATOR:
            stop = end - _LOCATOR_SIZE - _END64_SIZE
            f.seek(stop)
            record = f.read(_END64_SIZE)
            if record[:4] != _END64:
                raise DatasetError(f"{path} has a damaged end")
            count, length, start = struct.unpack("<QQQ", record[32:56])
    shift = stop - length - start
    if shift < 0:
        raise DatasetError(f"{path} has a damaged end")
    return start + shift, count, shift


def entries(f: BinaryIO, path: str, at: int, count: int) -> Iterator[tuple[int, Member]]:
    """(place, member) of count directory entries from place at on; some WINDOW of bytes is held at a time."""
    f.seek(at)
    data, i = f.read(WINDOW), 0

    def held(n: int) -> bool:
        nonlocal data, i
        if i + n > len(data):
            data, i = data[i:] + f.read(max(WINDOW, n)), 0
        return i + n <= len(data)

    for _ in range(count):
        if not held(_ENTRY_SIZE) or data[i : i + 4] != _ENTRY:
            raise DatasetError(f"{path} has a damaged directory")
        flags, method, _, _, crc, compressed, size, n, m, k = struct.unpack("<HHHHIIIHHH", data[i + 8 : i + 34])
        (offset,) = struct.unpack("<I", data[i + 42 : i + 46])
        whole = _ENTRY_SIZE + n + m + k
        if not held(whole):
            raise DatasetError(f"{path} has a damaged directory")
        name = data[i + _ENTRY_SIZE : i + _ENTRY_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0]
        extra = data[i + _ENTRY_SIZE + n : i + _ENTRY_SIZE + n + m]
        size, compressed, offset = _large(extra, size, compressed, offset)
        yield at, Member(name, flags, method, crc, compressed, size, offset)
        at, i = at + whole, i + whole


def _large(extra: bytes, *values: int) -> list[int]:
    """Size, compressed size and offset, with those that say so taken from the ZIP64 field."""
    out = list(values)
    while len(extra) >= 4:
        kind, length = struct.unpack("<HH", extra[:4])
        if kind == 1:
            wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
            out = [next(wide, v) if v == 0xFFFFFFFF else v for v in out]
        extra = extra[4 + length :]
    return out


def slices(path: str, partition: int = PARTITION, members: int = MEMBERS) -> list[Slice]:
    out: list[Slice] = []
    with open(path, "rb") as f:
        at, count, shift = directory(f, path)
        held = 0
        for i, (place, m) in enumerate(entries(f, path, at, count)):
            if not out or out[-1].count and (held + m.compressed > partition or out[-1].count == members):
                out.append(Slice(path, place, i, 0, shift))
                held = 0
            out[-1].count += 1
            held += m.compressed
    return out


def content(f: BinaryIO, offset: int, method: int, compressed: int, crc: int, name: str = "") -> Iterator[bytes]:
    """Pieces of the member that begins at offset; a damaged one raises DatasetError, at its end if only its CRC is wrong."""
    f.seek(offset)
    head = f.read(_LOCAL_SIZE)
    if head[:4] != _LOCAL or len(head) < _LOCAL_SIZE:
        raise DatasetError(f"member {name} is not where the directory says")
    f.seek(offset + _LOCAL_SIZE + sum(struct.unpack("<HH", head[26:30])))
    if method not in (0, 8) or struct.unpack("<H", head[6:8])[0] & 1:
        raise DatasetError(f"member {name} is encrypted or packed by method {method}")
    inflate, seen, left = zlib.decompressobj(-15) if method else None, 0, compressed
    while left:
        data = f.read(min(PIECE, left))
        if not data:
            break
        left -= len(data)
        try:
            while data:
                piece = inflate.decompress(data, PIECE) if inflate else data
                data = inflate.unconsumed_tail if inflate else b""
                seen = zlib.crc32(piece, seen)
                yield piece
        except zlib.error as e:
            raise DatasetError(f"member {name}: {e}") from e
    if left or seen != crc or inflate and not inflate.eof:
        raise DatasetError(f"member {name} is damaged")


class ZipEntries(DataSource):
    """spark.read.format('zip_entries'): the members of archives, with their CRC checked if option crc is true."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.crc = options["path"].split(","), options.get("crc", "false").lower() == "true"
        self.partition, self.members = int(options.get("partition", PARTITION)), int(options.get("members", MEMBERS))

    def partitions(self):
        return [s for p in self.paths for s in slices(p, self.partition, self.members)] or [Slice(self.paths[0], 0, 0, 0, 0)]

    def read(self, partition):
        with open(partition.archive, "rb") as f, open(partition.archive, "rb") as data:
            for i, (_, m) in enumerate(entries(f, partition.archive, partition.at, partition.count), partition.first):
                ok = None
                if self.crc:
                    try:
                        for _ in content(data, m.offset + partition.shift, m.method, m.compressed, m.crc, m.name):
                            pass
                        ok = True
                    except DatasetError:
                        ok = False
                yield partition.archive, i, m.name, m.name.endswith("/"), m.size, ok, m.method, m.compressed, m.offset + partition.shift, m.crc


def zip_entries(spark: SparkSession, *archives: str, crc: bool = False, partition: int = PARTITION, members: int = MEMBERS) -> DataFrame:
    """The members of archives, in slices of about `partition` compressed bytes and at most `members`; see SCHEMA."""
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").option("crc", str(crc).lower()).option("partition", partition).option("members", members).load(",".join(archives))
