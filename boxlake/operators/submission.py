"""Submissions: identifiers checked both ways, boxes merged into the original records, one file in one archive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SubmissionError
from ..functions import geometry as g
from ..sources import one_file


def id_difference(original: DataFrame, predicted: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, side) of identifiers that only one side has: missing (no prediction) or extra."""
    a, b = original.select(key).distinct(), predicted.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def build(original: DataFrame, predicted: DataFrame) -> DataFrame:
    """original(pos, query_id, source_json) with bbox (array) of predicted(query_id, box); raises on any difference of ids."""
    wrong = id_difference(original, predicted).orderBy("side", "query_id").limit(5).collect()
    if wrong:
        raise SubmissionError("identifiers differ: " + ", ".join(f"{r.side} {r.query_id}" for r in wrong))
    return original.join(predicted.select("query_id", g.to_array(F.col("box")).alias("bbox")), "query_id")


def write(rows: DataFrame, target: str, archive: str, parts: int | None = None) -> int:
    """Writes rows of build() as one JSON object in order of pos and an archive with just that file; returns their number.

    Tasks write it together, see one_file.write(). Every field of the original is kept; bbox is replaced in place or comes last.
    """

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for query_id, source, box in zip(*(batch.column(c).to_pylist() for c in ("query_id", "source_json", "bbox")), strict=True):
                record = json.loads(source) | {"bbox": list(box)}
                texts.append(json.dumps(query_id, ensure_ascii=False) + ": " + json.dumps(record, ensure_ascii=False))
            yield pa.RecordBatch.from_pydict({"pos": batch.column("pos").cast(pa.int64()), "text": pa.array(texts, pa.string())})

    texts = rows.select("pos", "query_id", "source_json", "bbox").mapInArrow(said, "pos long, text string")
    return one_file.write(texts, ["pos"], "text", target, b"{\n", b",\n", b"\n}\n", archive, parts)
