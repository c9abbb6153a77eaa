"""A whole run: selected queries through a model, a log that later runs resume from, predictions, summary and failures."""

from __future__ import annotations

import json
import platform
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyspark
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..sources import one_file, readers, sinks
from . import grounding, integrity, outputs, run_state, runs

LOG = "predictions_debug.jsonl"
#: Queries between two lines about a run's progress, at least.
EVERY = 100
#: Options of a run and what they are where a configuration says nothing (the seed and the number of tokens: fixed values).
DEFAULTS = {"grounder": "", "prompt": "", "device": "cpu", "dtype": "float16", "seed": 20260729, "max_new_tokens": 256, "num_beams": 1, "selection_strategy": "first", "fallback_mode": "error"}


def fingerprint(spark: SparkSession, config: dict[str, Any]) -> dict[str, Any]:
    """What must not change between a run and its resumption: the queries, the model's files, what makes the model and with
    which options, and every setting that changes an output. The model's folder is read by Spark; without a model_path the
    model counts as none."""
    found: dict[str, Any] = {"schema_version": 2, "grounder_options": config.get("grounder_options", {}), "queries_path": config["queries_path"], "queries_sha256": integrity.file_sha256(config["queries_path"]), "model_path": config.get("model_path")}
    if config.get("model_path"):
        files = readers.listing(spark, config["model_path"], content=True)
        found["model_artifacts_sha256"] = integrity.folder_digest(files).first().artifact_sha256
    return found | {k: type(v)(config.get(k, v)) for k, v in DEFAULTS.items()}


def record_environment(folder: str, config: dict[str, Any], stamp: dict[str, Any]) -> None:
    """environment.json and resolved_config.yaml in folder."""
    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__}
    sinks.summary(versions | {k: v for k, v in stamp.items() if k.endswith("sha256") or k.endswith("_path")}, f"{folder}/environment.json")
    sinks.settings(config, f"{folder}/resolved_config.yaml")


@contextmanager
def progress(seen: Any, before: int, total: int, every: int, say: Callable[[str], None] = lambda s: print(s, flush=True), pause: float = 0.5) -> Iterator[None]:
    """While a job runs, says how many of total are done: before, and what its finished tasks have added to the accumulator seen.

    At most a line for each `every` records. A task that is run again may add twice, so no more than total is ever said.
    """
    over, said = threading.Event(), before // every

    def look() -> None:
        nonlocal said
        done = min(before + seen.value, total)
        if done // every > said:
            said = done // every
            say(f"{done} of {total} queries done")

    def watch() -> None:
        while not over.wait(pause):
            look()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        look()


def _log_rows(todo: DataFrame, files: DataFrame, make: Callable[[], grounding.Grounder], mode: str, strategy: str, seen: Any = None, peak: Any = None, profile: ResourceProfile | None = None) -> DataFrame:
    """Log lines of todo(query_id, query, visible). A missing or unreadable image fails the job.

    Only names are joined; a task opens its images itself, one at a time, and query and path go through with each row.
    """
    paths = files.select(F.col("path").alias("_path"), "location")
    rows = todo.join(paths, t.inner_path(F.col("visible")) == F.col("_path"), "left").withColumn("location", F.coalesce("location", F.raise_error(F.concat(F.lit("missing image: "), F.col("visible"))).cast("string")))
    found = grounding.run(rows, make, sizes=True, seen=seen, peak=peak, carried=("query", "visible"), profile=profile).withColumnRenamed("error", "_refused")
    found = outputs.predictions(found, mode, strategy)
    # What the model says of an output it refused tells more than that there were no candidates.
    error = F.when(F.col("error") == "no_candidates", F.coalesce("_refused", "error")).otherwise(F.col("error"))
    return found.select(
        "query_id", F.col("query").alias("query_original"), "visible", t.suffix(F.col("visible")).alias("source_suffix"), F.array("width", "height").alias("image_size"), "raw_output",
        "candidates", g.to_array(F.col("box")).alias("normalized_bbox"), "fallback_used", error.alias("error"), "latency_ms",
    )


def summary_of(found: run_state.Parts, selected: int, total: int, new: int, peak: int = 0) -> dict[str, Any]:
    """The summary of a run from what its log says in aggregate, see run_state."""
    counts = run_state.metrics(found)
    for part, name in (("valid_bbox_count", "valid_bbox_rate"), ("fallback_count", "fallback_rate"), ("multi_candidate_count", "multi_candidate_rate"), ("bbox_area_over_50_count", "bbox_area_over_50_rate")):
        counts[name] = counts[part] / selected if selected else 0.0
    return counts | {
        "records_in_dataset": total, "records_processed": selected, "records_processed_this_run": new, "records_reused_from_checkpoint": selected - new,
        "is_full_dataset_run": selected == total, "system_error_count": 0, "gpu_peak_memory_bytes": peak,
    }


def summarise(parsed: DataFrame, selected: int, total: int, new: int, peak: int = 0) -> dict[str, Any]:
    """summary_of() lines of a log, which are parsed once."""
    return summary_of(run_state.store(parsed, runs.shared_path(parsed.sparkSession, "run-state")), selected, total, new, peak)


def _write_predictions(done: DataFrame, target: Path) -> None:
    """One JSON object of done(line_no, query_id, box) in the log's order: that of each id's last sound line. Tasks write it together."""

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [json.dumps(q, ensure_ascii=False) + ": " + json.dumps(b) for q, b in zip(batch.column("query_id").to_pylist(), batch.column("bbox").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"line_no": batch.column("line_no"), "text": pa.array(texts, pa.string())})

    rows = done.select("line_no", "query_id", g.to_array(F.col("box")).alias("bbox"))
    kind = rows.schema["line_no"].dataType.simpleString()
    one_file.write(rows.mapInArrow(said, f"line_no {kind}, text string"), ["line_no"], "text", str(target), b"{\n", b",\n", b"\n}\n")


def run(rows: DataFrame, files: DataFrame, make: Callable[[], grounding.Grounder], folder: str, limit: int | None = None, mode: str = "error", strategy: str = "first", resume: bool = False, stamp: dict[str, Any] | None = None, profile: ResourceProfile | None = None) -> dict[str, Any]:
    """Runs rows of readers.strict() over images files(path, location) and returns the summary, written to folder as well.

    resume keeps the sound predictions of folder's log and does the others; stamp is the fingerprint that guards it. The
    log grows by committed tasks, so a lost executor leaves no half lines, and a failed job leaves none of its own. What it
    says is kept in aggregate, and a resumed run adds its own lines to that; only where the log has lines of ids that are
    not selected now, whose counts can't be taken out, is it read whole. profile is for the model's stage.
    """
    outputs.check_options(mode, strategy)
    began, spark = time.perf_counter(), rows.sparkSession
    total = rows.count()
    selected = runs.selection(rows.select("pos", "query_id", F.col("fields")["query"].alias("query"), F.col("fields")["visible"].alias("visible")), limit)
    runs.gate(folder, stamp, resume, LOG)
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = Path(folder, LOG)
    state = run_state.RunState(spark, f"{folder}/run_state", str(log))
    todo = selected
    if resume:
        state.cover()
        todo = runs.remaining(selected, state.parts().ids.where("sound"))
    else:
        state.clear()
    new, selected_count = todo.count(), selected.count()
    peak = spark.sparkContext.accumulator(0, grounding.Most())
    if new or not log.exists() or not resume:
        print(f"{selected_count - new} of {selected_count} queries done before, {new} to do", flush=True)
        seen = spark.sparkContext.accumulator(0)
        with progress(seen, selected_count - new, selected_count, EVERY):
            _log_rows(todo, files, make, mode, strategy, seen, peak, profile).write.mode("append" if resume else "overwrite").option("ignoreNullFields", False).json(str(log))
        print(f"{selected_count} of {selected_count} queries done", flush=True)
    state.cover()
    whole, names = state.parts(), selected.select("query_id").distinct()
    if whole.ids.join(names, "query_id", "left_anti").isEmpty():
        found = summary_of(whole, selected_count, total, new, peak.value)
    else:
        found = summarise(runs.parse_checkpoint(readers.lines(spark, str(log)), selected), selected_count, total, new, peak.value)
    done = whole.ids.where("sound").join(names, "query_id", "left_semi")
    _write_predictions(done, Path(folder, "predictions.json"))
    sinks.failures(done, f"{folder}/failure_cases.csv")
    return sinks.summary(found | {"wall_time_seconds_this_invocation": time.perf_counter() - began}, f"{folder}/inference_summary.json")


def evaluate(rows: DataFrame, done: DataFrame) -> DataFrame:
    """query_id, query, both boxes, iou and accurate of the labelled rows of readers.strict() that done(query_id, box) has."""
    truth = rows.where("box is not null").select("query_id", F.col("fields")["query"].alias("query"), F.col("fields")["visible"].alias("visible"), F.col("box").alias("_truth"))
    both = truth.join(done.select("query_id", F.col("box").alias("_box")), "query_id")
    return both.select("query_id", "query", "visible", g.to_array(F.col("_truth")).alias("true_bbox"), g.to_array(F.col("_box")).alias("prediction_bbox"), g.iou(F.col("_box"), F.col("_truth")).alias("iou"), g.accurate(F.col("_box"), F.col("_truth")).alias("acc_at_05"))
