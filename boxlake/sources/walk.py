"""Folders walked by tasks, level by level, with what each name stands for on the disk.

The driver only knows how deep it is: a level's folders are a table, dealt to tasks, which list them; what they find is
written, and its folders are the next level. Links are followed. A folder that a link leads to is not entered again from
within itself, so cycles end. The walk is for folders that driver and tasks share.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import shared_path

#: Folders a task, at least, if that makes fewer tasks than there is room for.
FOLDERS = 16
SCHEMA = "path string, kind string, size bigint, target string, chain array<string>"
_TYPES = {"path": pa.string(), "kind": pa.string(), "size": pa.int64(), "target": pa.string(), "chain": pa.list_(pa.string())}


def local(root: str) -> str | None:
    """root as a path of the machine, null if it lies in another store."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return None if "://" in root else os.path.abspath(root)


def below(target: str, root: str) -> str | None:
    """A real path relative to a real root, null if it is not below it."""
    return target[len(root) + 1 :] if target.startswith(root.rstrip("/") + "/") and target != root else "" if target == root else None


def _listed(root: str, real: str):
    """For mapInArrow over folders(path, chain): what is in them."""

    def entries(path: str, chain: list[str]) -> Iterator[tuple]:
        with os.scandir(os.path.join(root, path)) as found:
            for e in found:
                name = f"{path}/{e.name}" if path else e.name
                try:
                    target = os.path.realpath(e.path) if e.is_symlink() else os.path.join(chain[-1], e.name)
                    if e.is_dir():
                        yield name, "loop" if target in chain else "folder", 0, below(target, real), [*chain, target]
                    elif e.is_file():
                        yield name, "file", e.stat().st_size, below(target, real), []
                    else:
                        yield name, "broken" if e.is_symlink() else "other", 0, None, []
                except OSError:  # it went meanwhile, or may not be looked at
                    yield name, "broken", 0, None, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, chain in zip(batch.column("path").to_pylist(), batch.column("chain").to_pylist(), strict=True):
                for row in entries(path, chain):
                    rows.append(row)
                    if len(rows) == 5000:  # a folder may have any number of names
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_TYPES.items())})


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size, target) of everything below root, by names relative to it.

    kind is file, folder, loop (a folder that leads back to one it is in; not entered), broken or other. target is what the
    name stands for, relative to the real root, and null if that lies outside it. A file that two names stand for is there
    twice, with one target. Hidden and empty files are files.
    """
    top = local(root)
    if top is None or not os.path.isdir(top):
        raise FileNotFoundError(root)
    real, tasks, levels = os.path.realpath(top), 4 * spark.sparkContext.defaultParallelism, []
    folders = spark.createDataFrame([("", [real])], "path string, chain array<string>")
    while True:
        place = shared_path(spark, "walk")
        folders.mapInArrow(_listed(top, real), SCHEMA).write.parquet(place)
        found = spark.read.schema(SCHEMA).parquet(place)
        levels.append(found.drop("chain"))
        folders = found.where("kind = 'folder'").select("path", "chain")
        n = folders.count()
        if not n:
            return reduce(DataFrame.union, levels)
        folders = folders.repartition(max(1, min(tasks, n // FOLDERS)))


def files(spark: SparkSession, root: str, glob: str | None = None, content: bool = False) -> DataFrame:
    """(path, size[, content], location, target) of the files of walk(); a glob is for names. Contents are read by tasks, one at a time."""
    top = local(root)
    rows = walk(spark, root).where("kind = 'file'")
    if glob:
        rows = rows.where(F.regexp_extract("path", "[^/]*$", 0).rlike(f"^{fnmatch.translate(glob)}$".replace("\\Z", "").replace("\\z", "")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = os.path.join(top, path)
                held = {"path": [path], "size": [size]}
                if content:
                    with open(place, "rb") as f:
                        held["content"] = [f.read()]
                held |= {"location": ["file://" + quote(place)], "target": [target]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, {"size": pa.int64(), "content": pa.binary()}.get(k, pa.string())) for k, v in held.items()})

    if content:
        return rows.select("path", "size", "target").mapInArrow(run, "path string, size bigint, content binary, location string, target string")
    # The bytes of a name that a URI keeps as they are (fixed by its grammar); url_encode() writes blanks as +.
    escaped = F.regexp_replace(F.regexp_replace(F.url_encode(F.concat(F.lit(top.rstrip("/") + "/"), "path")), "%2F", "/"), r"\+", "%20")
    return rows.select("path", "size", F.concat(F.lit("file://"), escaped).alias("location"), "target")


def resolved(paths: DataFrame, root: str, column: str = "path") -> DataFrame:
    """paths with target and exists: what a path below root stands for on the disk, links and .. followed in order, relative to the
    real root; null if it is absolute, empty or leads outside. Each different path is resolved once, by a task."""
    top = local(root)
    real = os.path.realpath(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(0).to_pylist()
            found = [None if not p or not p.strip() or os.path.isabs(p) else os.path.realpath(os.path.join(real, p)) for p in said]
            inside = [None if f is None else below(f, real) for f in found]
            there = [i is not None and os.path.isfile(f) for f, i in zip(found, inside, strict=True)]
            yield pa.RecordBatch.from_pydict({"_path": pa.array(said, pa.string()), "target": pa.array(inside, pa.string()), "exists": pa.array(there, pa.bool_())})

    known = paths.select(F.col(column).alias("_path")).distinct().mapInArrow(run, "_path string, target string, exists boolean")
    return paths.join(known, F.col(column).eqNullSafe(F.col("_path")), "left").drop("_path")
