"""Lines by number through the stored index, against plain reading."""

import json

import pytest
from boxlake.errors import DatasetError
from boxlake.sources import line_index
from pyspark.sql import functions as F


def written(folder):
    folder.mkdir()
    every, n = [], 0
    for name, size in (("a.jsonl", 700), ("b.jsonl", 0), ("c.jsonl", 33)):
        own = [json.dumps({"i": n + i, "t": "é" * ((n + i) % 40)}, ensure_ascii=False) for i in range(size)]
        every, n = every + own, n + size
        text = "\n".join(x + ("\n  \n" if i % 50 == 7 else "") for i, x in enumerate(own))
        (folder / name).write_text(text + ("\n" if size == 33 else ""), encoding="utf-8")
    return every


@pytest.mark.parametrize("step, span", ((16, 997), (256, 64 << 20)))
def test_fetch_by_number(spark, tmp_path, step, span):
    every = written(tmp_path / "m")
    index = str(tmp_path / "index")
    assert line_index.build(spark, str(tmp_path / "m"), index, step=step, span=span) == len(every)
    lines = line_index.Lines(spark, index)
    assert len(lines) == len(every) and (lines[0], lines[-1], lines[700]) == (every[0], every[-1], every[700])
    for bad in (len(every), -len(every) - 1):
        with pytest.raises(IndexError):
            lines[bad]
    asked = spark.range(0, 2000, 3).select(F.col("id").alias("number"))
    for gap in (0, 200, 1 << 20):
        found = {r.number: r.value for r in lines.fetch(asked.union(asked), gap).collect()}
        assert found == {i: every[i] for i in range(0, len(every), 3)}


def test_one_file_and_a_changed_one(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\r\n".join(f'{{"i": {i}}}' for i in range(300)))
    index = str(tmp_path / "index")
    assert line_index.build(spark, str(path), index, step=100) == 300
    assert line_index.Lines(spark, index)[123] == '{"i": 123}'
    path.write_text('{"i": 0}\n')
    with pytest.raises(Exception, match=DatasetError.__name__):
        line_index.Lines(spark, index).fetch(spark.range(250, 251).select(F.col("id").alias("number"))).collect()


def test_nothing_to_index(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert line_index.build(spark, str(tmp_path / "none"), str(tmp_path / "index")) == 0
    assert line_index.Lines(spark, str(tmp_path / "index")).fetch(spark.range(3).select(F.col("id").alias("number"))).count() == 0
