"""Sinks: JSON lines, split manifests, summaries, failure tables and unpacked archives."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..operators.splits import SPLITS
from . import one_file


def jsonl(rows: DataFrame, path: str) -> int:
    """Writes rows as JSON lines, nulls included; returns how many, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def split_manifests(rows: DataFrame, folder: str, name: str) -> dict[str, int]:
    """folder/name_<split> for each split, written and counted in one pass over rows; one without rows is an empty folder.

    The splits' files get their names when all are written, so a failed job leaves what was there before.
    """
    from pyspark.sql import Observation

    seen, draft, spark = Observation(), f"{folder}/.{name}-{uuid.uuid4().hex}", rows.sparkSession
    known = rows.where(F.col("split").isin(*SPLITS)).observe(seen, *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    known.withColumn("_split", F.col("split")).write.partitionBy("_split").option("ignoreNullFields", False).json(draft)
    path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in SPLITS:
        source, target = path(f"{draft}/_split={s}"), path(f"{folder}/{name}_{s}")
        fs.delete(target, True)
        if not (fs.exists(source) and fs.rename(source, target)):
            fs.mkdirs(target)
        fs.create(path(f"{folder}/{name}_{s}/_SUCCESS"), True).close()
    fs.delete(path(draft), True)
    return {s: int(seen.get[s]) for s in SPLITS}


def summary(row: DataFrame | dict[str, Any], path: str) -> dict[str, Any]:
    """A one-row table or a dict as a JSON file."""
    found = row if isinstance(row, dict) else row.first().asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return found


def failures(rows: DataFrame, path: str) -> None:
    """query_id, error and box of fallback rows as one CSV file with a byte order mark and a header, in order of the ids.

    Tasks write it together, see one_file.write().
    """
    table = rows.where("fallback_used").select("query_id", "error", F.to_json(F.array("box.x1", "box.y1", "box.x2", "box.y2")).alias("fallback_bbox"))

    def line(values: list[Any]) -> str:
        out = io.StringIO()
        csv.writer(out).writerow(values)
        return out.getvalue()

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [line(r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id"), "text": pa.array(texts, pa.string())})

    texts = table.mapInArrow(said, "query_id string, text string")
    one_file.write(texts, ["query_id"], "text", path, b"\xef\xbb\xbf" + line(table.columns).encode())


def settings(found: dict[str, Any], path: str) -> None:
    """A configuration as YAML; as JSON, which YAML has in it, where no YAML library is."""
    try:
        import yaml

        said = yaml.safe_dump(found, allow_unicode=True, sort_keys=False)
    except ImportError:
        said = json.dumps(found, ensure_ascii=False, indent=2) + "\n"
    Path(path).write_text(said, encoding="utf-8")


def unpack(entries: DataFrame, archive: str, target: str, overwrite: bool = False) -> int:
    """Unpacks the files of zip_entries() of one archive to their safe paths below target; returns how many were new.

    Unsafe members fail the job before anything is written. A file of the same size is left; one of another size is an
    error unless overwrite. Members are read in the slices that entries has, each where the directory says it is, and
    checked; files appear under their name only when complete.
    """
    from ..functions import text as t
    from .archives import content

    files = entries.where("not is_dir").withColumn("error", t.path_error(F.col("name"))).withColumn("target", t.safe_path(F.col("name")))
    bad = files.where("error is not null").select("name", "error").limit(1).collect()
    if bad:
        raise DatasetError(f"unsafe member {bad[0].name}: {bad[0].error}")

    def write(rows):
        n = 0
        with open(archive, "rb") as source:
            for r in rows:
                path = Path(target, r.target)
                if path.exists() and path.stat().st_size == r["size"]:
                    continue
                if path.exists() and not overwrite:
                    raise FileExistsError(path)
                path.parent.mkdir(parents=True, exist_ok=True)
                part = path.with_name(f".{path.name}.{os.getpid()}")
                with part.open("wb") as sink:
                    for piece in content(source, r.offset, r.method, r.compressed, r.crc, r["name"]):
                        sink.write(piece)
                part.replace(path)
                n += 1
        yield n

    return files.select("name", "size", "target", "offset", "method", "compressed", "crc").rdd.mapPartitions(write).sum()
