"""Digests and archive audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def file_sha256(path: str) -> str:
    """Upper-case digest of a file of any size."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(8 << 20):
            h.update(piece)
    return h.hexdigest().upper()


def content_sha256(content: Column) -> Column:
    return F.upper(F.sha2(content.cast("binary"), 256))


def folder_digest(files: DataFrame) -> DataFrame:
    """One row: digest of files(path, size, content), folded in order of their path's parts.

    Contents are hashed where they are read. A digest over lines has an order, so one task folds them: they are sorted
    there, on disk if need be, and streamed through it, a line of about a hundred bytes a file; nothing is gathered.
    """
    line = F.concat("path", F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), content_sha256(F.col("content")), F.lit("\n"))
    lines = files.select(F.split("path", "/").alias("parts"), line.alias("line")).repartition(1).sortWithinPartitions("parts").select("line")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for said in batch.column(0).to_pylist():
                digest.update(said.encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"artifact_sha256": [digest.hexdigest().upper()], "file_count": pa.array([n], pa.int64())})

    found = lines.mapInArrow(fold, "artifact_sha256 string, file_count long")
    # Of no files Spark makes no task, or an empty one.
    none = hashlib.sha256().hexdigest().upper()
    return found.agg(F.coalesce(F.max_by("artifact_sha256", "file_count"), F.lit(none)).alias("artifact_sha256"), F.coalesce(F.max("file_count"), F.lit(0).cast("long")).alias("file_count"))


def verify_archives(entries: DataFrame) -> DataFrame:
    """archive, entry_count (folders included) and bad_member, the first whose CRC fails."""
    return entries.groupBy("archive").agg(F.count("*").alias("entry_count"), F.min_by(F.when(~F.col("crc_ok"), F.col("name")), F.when(~F.col("crc_ok"), F.col("pos"))).alias("bad_member"))


def audit_extraction(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: files of an archive against what listing(path, size) has at their safe paths."""
    files = entries.where("not is_dir").withColumn("path", t.safe_path(F.col("name")))
    rows = files.join(listing.select("path", F.col("size").alias("found")), "path", "left")
    counts = rows.agg(F.count("*").alias("file_count"), F.count_if(F.col("found").isNull()).alias("missing_count"), F.count_if(F.col("found") != F.col("size")).alias("size_mismatch_count"), F.count_if(t.posix(F.col("name")) != F.col("path")).alias("sanitized_count"))
    return counts.join(files.groupBy("path").count().where("count > 1").agg(F.count("*").alias("collision_count")), how="cross")
