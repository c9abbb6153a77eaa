"""One file by many tasks: bytes as if one had written it, and an archive that the standard library reads."""

import json
import os
import random
import zipfile
import zlib

import pytest
from boxlake.operators import submission
from boxlake.sources import one_file
from pyspark.sql import functions as F


@pytest.mark.parametrize("n, parts", ((0, 3), (1, 4), (1000, 7)))
def test_bytes_and_archive(spark, tmp_path, n, parts):
    rows = spark.range(n, numPartitions=5).select((n - F.col("id")).alias("k"), F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), "id").alias("text"))
    target, archive = str(tmp_path / "all.txt"), str(tmp_path / "all.zip")
    assert one_file.write(rows, ["k"], "text", target, b"<", b"; ", b">\n", archive, parts) == n
    whole = "<" + "; ".join(f"é{'x' * (i % 50)}{i}" for i in range(n - 1, -1, -1)) + ">\n"
    assert (tmp_path / "all.txt").read_text() == whole
    with zipfile.ZipFile(archive) as z:
        assert z.namelist() == ["all.txt"] and z.testzip() is None and z.read("all.txt").decode() == whole
    assert sorted(os.listdir(tmp_path)) == ["all.txt", "all.zip"]


def test_archive_of_many_pieces(spark, tmp_path):
    data = random.Random(1).randbytes(5000) + b"abc" * 9000
    (tmp_path / "d.bin").write_bytes(data)
    (tmp_path / "f").mkdir()
    one_file._archive(spark.range(1), str(tmp_path / "d.bin"), str(tmp_path / "d.zip"), str(tmp_path / "f"), piece=1 << 10)
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        assert z.testzip() is None and z.read("d.bin") == data


def test_crc_of_joined_texts():
    r = random.Random(2)
    for _ in range(60):
        a, b = r.randbytes(r.randint(0, 300)), r.randbytes(r.randint(0, 3000))
        assert one_file.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_submission_in_many_parts(spark, tmp_path):
    rows = [(i, f"q{99 - i}", json.dumps({"query": f'say "{i}"', "bbox": None, "more": [i]} if i % 2 else {"query": "é"}), [0.1, 0.2, 0.3, i / 100]) for i in range(100)]
    df = spark.createDataFrame(rows, "pos int, query_id string, source_json string, bbox array<double>")
    assert submission.write(df, str(tmp_path / "s.json"), str(tmp_path / "s.zip"), parts=6) == 100
    found = json.loads((tmp_path / "s.json").read_text())
    assert list(found) == [r[1] for r in rows]
    assert list(found.values()) == [json.loads(s) | {"bbox": b} for _, _, s, b in rows] and list(found["q98"]) == ["query", "bbox", "more"]
    assert zipfile.ZipFile(tmp_path / "s.zip").read("s.json") == (tmp_path / "s.json").read_bytes()
