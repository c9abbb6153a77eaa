"""Checkpoint and resume: what a run may reuse, what is left to do, and the gate of its fingerprint."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SettingsError
from ..functions import geometry as g

LINE = "query_id string, visible string, source_suffix string, candidates array<struct<pixel_bbox:array<double>,label:string>>, normalized_bbox array<double>, fallback_used boolean, error string, latency_ms double"


def selection(queries: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` queries by pos; None and 0 mean all, a negative number none."""
    return queries if not limit else queries.where(F.col("pos") < limit)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) as (line_no, query_id, box, ..., prediction_ok, invalid), blank ones left out.

    A line is invalid if it is no object, lacks an id or a sound box, or has no latency; with id and box its prediction
    is still used.
    """
    rows = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))
    rows = rows.select("line_no", "r.*").withColumn("box", g.from_array(F.col("normalized_bbox")))
    ok = F.col("query_id").isNotNull() & F.col("box").isNotNull() & g.normalized_error(F.col("box")).isNull()
    return rows.withColumn("prediction_ok", ok).withColumn("invalid", ~(ok & F.col("latency_ms").isNotNull()))


def parse_checkpoint(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """parsed_lines() without ids that are not selected, which are not invalid; lines without an id stay."""
    rows = parsed_lines(lines)
    known = selected.select(F.col("query_id").alias("_id"), F.lit(True).alias("_known")).distinct()
    return rows.join(known, F.col("query_id") == F.col("_id"), "left").where("query_id is null or _known").drop("_id", "_known")


def reused(parsed: DataFrame) -> DataFrame:
    """One row an id: its last sound prediction. Metrics are over the lines, so repeated ids count there each time."""
    return parsed.where("prediction_ok").groupBy("query_id").agg(F.max_by("box", "line_no").alias("box"), F.max("line_no").alias("line_no"))


def remaining(selected: DataFrame, done: DataFrame) -> DataFrame:
    return selected.join(done.select("query_id").distinct(), "query_id", "left_anti")


def gate(folder: str, fingerprint: dict[str, Any] | None, resume: bool, log: str = "predictions_debug.jsonl") -> None:
    """Lets a run into folder: a resumed one needs a fingerprint equal to the stored one, or a folder without a log."""
    path = Path(folder, "run_fingerprint.json")
    text = None if fingerprint is None else json.dumps(fingerprint, sort_keys=True, ensure_ascii=False, indent=2)
    if resume:
        if text is None:
            raise SettingsError("a resumed run needs a fingerprint")
        if path.exists():
            if json.loads(path.read_text()) != fingerprint:
                raise SettingsError("the fingerprint differs from that of the run to resume")
            return
        if Path(folder, log).exists():
            raise SettingsError("a log without a fingerprint cannot be resumed")
    if text is not None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        path.write_text(text + "\n")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; without one named, only a local master has a temporary one,
    which goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise SettingsError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
