"""The extension point: any object with predict(image=..., query=...) is run over rows of image bytes and queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from ..errors import BoxError, OutputError
from .images import opened
from .pictures import size

OUT = "query_id string, raw_output string, boxes array<array<double>>, labels array<string>, error string, latency_ms double"
SIZED = OUT + ", width int, height int"


class Grounder(Protocol):
    def predict(self, *, image: bytes, query: str) -> dict[str, Any]:
        """raw_output, boxes (pixel xyxy) and labels; OutputError or BoxError for an output that cannot be used.

        A model may have predict_batch(images=, queries=) besides, and batch_size: then it is given so many at once, and
        answers each in order with such a dict or such an error. One with peak_memory() tells the most bytes of its device
        that it has used in this process.
        """


class FixedGrounder:
    """A stand-in that answers every query with the same boxes; for tests."""

    def __init__(self, boxes: list[list[float]], labels: list[str] | None = None) -> None:
        self.boxes, self.labels = boxes, labels or []

    def predict(self, *, image: bytes, query: str) -> dict[str, Any]:
        if not self.boxes:
            raise OutputError("none")
        return {"raw_output": query, "boxes": self.boxes, "labels": self.labels}


class Most(AccumulatorParam):
    """For accumulators that keep the largest value: a task that is run again changes nothing."""

    def zero(self, value: int) -> int:
        return value

    def addInPlace(self, a: int, b: int) -> int:  # noqa: N802
        return max(a, b)


def run(rows: DataFrame, make: Callable[[], Grounder], sizes: bool = False, seen: Any = None, peak: Any = None, carried: tuple[str, ...] = (), profile: ResourceProfile | None = None) -> DataFrame:
    """OUT of rows(query_id, query, content or location), or SIZED with the image's size; carried names further string columns
    of rows to keep. make() is called once a task that has rows, where a model is loaded. Of rows with a location the image is read there,
    so that no batch holds more than names and one image.

    Unusable outputs give an error in their row; any other failure (an unreadable image whose size is asked for, too) fails
    the job, and what was not committed is redone. A model with predict_batch gets batches. seen, an accumulator, gets the
    number of rows done; peak, one of Most, the peak_memory() of a model that has it. profile says what a task of the model's
    stage needs (cores, memory, GPUs), where the cluster manager takes such profiles.
    """

    schema, image = SIZED if sizes else OUT, "location" if "location" in rows.columns else "content"
    schema += "".join(f", {c} string" for c in carried)

    def one(model: Grounder, content: bytes, query: str) -> tuple[dict[str, Any], str | None]:
        try:
            return model.predict(image=content, query=query), None
        except (OutputError, BoxError) as e:
            return {}, str(e)

    def answers(model: Grounder, asked: list[tuple[str, bytes, str]]) -> list[tuple]:
        """Rows of OUT for (query_id, image, query); a batch's time is shared out evenly."""
        began = time.perf_counter()
        if hasattr(model, "predict_batch"):
            found = [({}, str(f)) if isinstance(f, Exception) else (f, None) for f in model.predict_batch(images=[c for _, c, _ in asked], queries=[q for _, _, q in asked])]
            if len(found) != len(asked):
                raise ValueError("predict_batch must answer every query")
            took = [1000 * (time.perf_counter() - began) / len(asked)] * len(asked)
        else:
            found, took = [], []
            for _, content, query in asked:
                began = time.perf_counter()
                found.append(one(model, content, query))
                took.append(1000 * (time.perf_counter() - began))
        return [(i, f.get("raw_output"), f.get("boxes"), f.get("labels"), error, ms, *(size(content) if sizes else ())) for (i, content, _), (f, error), ms in zip(asked, found, took, strict=True)]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            model = make() if model is None else model  # not for a task without rows
            step = getattr(model, "batch_size", 1) if hasattr(model, "predict_batch") else 1
            out, rows = [], list(zip(part["query_id"], part["query"], part[image], strict=True))
            kept = list(zip(*(part[c] for c in carried), strict=True)) if carried else [()] * len(rows)
            for a in range(0, len(rows), step):  # no more images are held than a batch has
                out += answers(model, [(i, opened(c) if image == "location" else c, q) for i, q, c in rows[a : a + step]])
            if seen is not None:
                seen.add(len(part))
            if peak is not None and hasattr(model, "peak_memory"):
                peak.add(int(model.peak_memory()))
            yield pd.DataFrame([r + k for r, k in zip(out, kept, strict=True)], columns=[f.split()[0] for f in schema.split(", ")])

    names = dict.fromkeys(("query_id", "query", image, *carried))
    return rows.select(*names).mapInPandas(work, schema, profile=profile)
