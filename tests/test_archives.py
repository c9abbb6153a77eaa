"""Archives read by slices of their members, against the standard library."""

import io
import struct
import zipfile

import pytest
from boxlake.errors import DatasetError
from boxlake.operators import integrity
from boxlake.sources import archives, readers, sinks


def packed(path, n, before=b"", comment=b""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("pics/", b"")
        for i in range(n):
            z.writestr(zipfile.ZipInfo(f"pics/{i:05d}é.bin" if i % 3 else f"pics/{i:05d}.bin"), f"{i}," * (i % 90 + 1), zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
        z.comment = comment
    path.write_bytes(before + data.getvalue())
    return str(path)


def test_an_archive_of_many_members(spark, tmp_path):
    """Ten thousand members in many tasks; one damaged byte is found; the audit of what is unpacked is clean."""
    path = packed(tmp_path / "many.zip", 10_000)
    entries = readers.zip_entries(spark, path, crc=True, members=1500)
    assert entries.rdd.getNumPartitions() == 7
    with zipfile.ZipFile(path) as z:
        there = [(i, m.filename, m.is_dir(), m.file_size, m.compress_size, m.CRC) for i, m in enumerate(z.infolist())]
        at = z.getinfo("pics/00077.bin" if 77 % 3 == 0 else "pics/00077é.bin").header_offset
    rows = entries.orderBy("pos").collect()
    assert [(r.pos, r.name, r.is_dir, r["size"], r.compressed, r.crc) for r in rows] == there and all(r.crc_ok for r in rows)
    target = tmp_path / "out"
    few = entries.where("pos < 400")
    assert sinks.unpack(few, path, str(target)) == 399 and sinks.unpack(few, path, str(target)) == 0
    assert (target / "pics/00089é.bin").read_text() == "89," * 90
    found = integrity.audit_extraction(few, readers.listing(spark, str(target))).first()
    assert (found.file_count, found.missing_count, found.size_mismatch_count, found.collision_count) == (399, 0, 0, 0)
    data = bytearray((tmp_path / "many.zip").read_bytes())
    data[at + 30 + 20] ^= 255
    (tmp_path / "bad.zip").write_bytes(data)
    found = integrity.verify_archives(readers.zip_entries(spark, str(tmp_path / "bad.zip"), path, crc=True)).orderBy("archive").collect()
    assert [(r.entry_count, r.bad_member) for r in found] == [(10_001, "pics/00077é.bin"), (10_001, None)]
    with pytest.raises(Exception, match="damaged|77"):
        sinks.unpack(readers.zip_entries(spark, str(tmp_path / "bad.zip")).where("pos = 78"), str(tmp_path / "bad.zip"), str(tmp_path / "bad"))


def read(path):
    with open(path, "rb") as f:
        at, count, shift = archives.directory(f, path)
        out = []
        for _, m in list(archives.entries(f, path, at, count)):
            try:
                out.append((m.name, m.size, b"".join(archives.content(f, m.offset + shift, m.method, m.compressed, m.crc))))
            except DatasetError as e:
                out.append((m.name, m.size, str(e)))
        return out


@pytest.mark.parametrize("before, comment", ((b"", b""), (b"#!/bin/sh\n", b"a comment with PK\x05 in it")))
def test_something_before_and_after(tmp_path, before, comment):
    path = packed(tmp_path / "x.zip", 5, before, comment)
    with zipfile.ZipFile(path) as z:
        assert read(path) == [(m.filename, m.file_size, z.read(m)) for m in z.infolist()]


def test_wide_fields(tmp_path):
    """ZIP64: sizes and offset of a member, and the end of the directory, in eight bytes."""
    name, data = b"a.bin", b"0123456789" * 10
    import zlib

    wide = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name + data
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(entry), 1)
    path = tmp_path / "wide.zip"
    path.write_bytes(local + entry + end + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    assert read(str(path)) == [("a.bin", 100, data)]
    assert zipfile.ZipFile(path).read("a.bin") == data


def test_slices_by_bytes_and_members(tmp_path):
    path = packed(tmp_path / "s.zip", 200)
    for found in (archives.slices(path, 2000), archives.slices(path, members=50), archives.slices(path)):
        assert [s.first for s in found] == [sum(x.count for x in found[:i]) for i in range(len(found))] and sum(s.count for s in found) == 201
    assert [len(archives.slices(path, members=50)), len(archives.slices(path))] == [5, 1] and len(archives.slices(path, 2000)) > 5
    assert archives.slices(packed(tmp_path / "dir.zip", 0))[0].count == 1


@pytest.mark.parametrize("data", (b"", b"PK", b"no archive at all" * 10, b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 9, 9, 500, 3, 0)))
def test_no_archive(tmp_path, data):
    (tmp_path / "x.zip").write_bytes(data)
    with pytest.raises(DatasetError):
        archives.slices(str(tmp_path / "x.zip"))
