"""Records of JSON-lines files by number: an index of where lines begin, and reads of just the lines that are asked for.

The index has a row a block of STEP lines and a file: the number of the block's first line, where it begins, and how many
lines it has. It is built by tasks over byte ranges and stored in a folder of its own, which later sessions open. A fetch finds each number's block, joins neighbouring blocks to one read, and reads no others.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from . import walk

#: Lines of a block; bytes that a task scans for line ends; bytes between blocks that are read rather than skipped.
STEP, RANGE, GAP = 256, 64 << 20, 64 << 10
BLOCKS = "file string, at bigint, length bigint, lines int"
_TYPES = {"file": pa.string(), "at": pa.int64(), "length": pa.int64(), "lines": pa.int32()}


def _blocks(step: int, span: int):
    """For mapInArrow over (file, start): blocks of the lines that begin in the range, blank ones left out of the count."""

    def lines(f, start: int) -> Iterator[tuple[int, bytes]]:
        at = start
        if start:
            f.seek(start - 1)
            at += len(f.readline()) - 1  # the rest of a line that began before, if any
        while at < start + span and (line := f.readline()):
            yield at, line
            at += len(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out, first, end, n = [], None, 0, 0
                with open(file, "rb") as f:
                    for at, line in lines(f, start):
                        if not line.strip():
                            continue
                        if n == step:
                            out.append((file, first, end - first, n))
                            first, n = None, 0
                        first, end, n = at if first is None else first, at + len(line), n + 1
                if n:
                    out.append((file, first, end - first, n))
                yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(_TYPES.items())})

    return run


def build(spark: SparkSession, path: str, index: str, glob: str = "*.json*", step: int = STEP, span: int = RANGE) -> int:
    """Indexes the files at path (one, or those of a folder, in the order of their names) into the folder index; returns the lines.

    Line numbers run over all files, without gaps; blank lines have none. The first number of each block comes from running
    sums over the blocks of a file, and over files: a file has one row for each `step` lines, and sums go file by file.
    """
    top = walk.local(path)
    if os.path.isfile(top):
        files = spark.createDataFrame([(top, os.path.getsize(top))], "file string, size long")
    else:
        files = walk.files(spark, path, glob).where(~F.col("path").rlike(r"(^|/)[._]")).select(F.concat(F.lit(top.rstrip("/") + "/"), "path").alias("file"), "size")
    ranges = files.where("size > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long"))).alias("start"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    ranges.repartition(max(1, min(tasks, ranges.count())), "file", "start").mapInArrow(_blocks(step, span), BLOCKS).write.mode("overwrite").parquet(f"{index}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{index}/blocks")
    own = F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    sums = blocks.groupBy("file").agg(F.sum("lines").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    sums = sums.select(F.col("file").alias("_file"), F.coalesce(before, F.lit(0)).alias("_before"))
    found = blocks.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, F.col("file") == F.col("_file")).select("file", "at", "length", "lines", (F.col("_own") + F.col("_before")).alias("first"))
    found.write.mode("overwrite").parquet(f"{index}/numbered")
    return Lines(spark, index).count()


@dataclass(frozen=True)
class Lines:
    """An index opened: count() lines, and rows of them by number."""

    spark: SparkSession
    index: str

    def _numbered(self) -> DataFrame:
        return self.spark.read.schema(f"{BLOCKS}, first bigint").parquet(f"{self.index}/numbered")

    def count(self) -> int:
        return self._numbered().agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]

    def __len__(self) -> int:
        return self.count()

    def __getitem__(self, number: int) -> str:
        """One line; negative numbers count from the end."""
        n = self.count() if number < 0 else 0
        found = self.fetch(self.spark.createDataFrame([(number + n,)], "number long")).collect() if number + n >= 0 else []
        if not found:
            raise IndexError(number)
        return found[0].value

    def fetch(self, numbers: DataFrame, gap: int = GAP) -> DataFrame:
        """(number, value) of the lines that numbers(number) names, each once; numbers beyond the lines have none.

        A number finds its block by an equality of cells of STEP numbers, of which a block touches a few. Blocks of a file
        that lie within gap bytes of each other are one read.
        """
        blocks = self._numbered()
        wanted = numbers.select(F.col("number").cast("long").alias("number")).where("number >= 0").distinct()
        cell = lambda c: F.floor(c / STEP)
        cells = blocks.withColumn("_cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("lines") - 1))))
        met = wanted.withColumn("_cell", cell(F.col("number"))).join(cells, "_cell").where("number >= first and number < first + lines")
        own = met.groupBy("file", "at", "length", "first").agg(F.collect_list((F.col("number") - F.col("first")).cast("int")).alias("wanted"))  # at most the block's lines
        ordered = own.repartition("file", F.floor(F.col("at") / RANGE)).sortWithinPartitions("file", "at")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def lines(run: list[tuple]) -> pa.RecordBatch:
                """Of neighbouring blocks, by one read."""
                file, start = run[0][0], run[0][1]
                with open(file, "rb") as f:
                    f.seek(start)
                    data = f.read(run[-1][1] + run[-1][2] - start)
                numbers, values = [], []
                for _, at, length, first, picked in run:
                    kept = [x for x in data[at - start : at - start + length].split(b"\n") if x.strip()]
                    if max(picked) >= len(kept):
                        raise DatasetError(f"{file} is not as it was when it was indexed")
                    numbers += [first + i for i in picked]
                    values += [kept[i].rstrip(b"\r").decode() for i in picked]
                return pa.RecordBatch.from_pydict({"number": pa.array(numbers, pa.int64()), "value": pa.array(values, pa.string())})

            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length", "first", "wanted")), strict=True):
                    last = held[-1] if held else None
                    if last and (row[0] != last[0] or row[1] - (last[1] + last[2]) > gap or row[1] - held[0][1] > RANGE):
                        yield lines(held)
                        held = []
                    held.append(row)
            if held:
                yield lines(held)

        return ordered.select("file", "at", "length", "first", "wanted").mapInArrow(read, "number long, value string")
