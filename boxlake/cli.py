"""Command line: validate, infer and sample on a dataset, audit it, and verify, extract and prepare annotated ones."""

from __future__ import annotations

import argparse
import importlib
import json
import random
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DatasetError, SettingsError
from .operators import annotations, audit, inference, integrity, pictures, preparation, published, runs, splits, submission
from .sources import readers, sinks, walk


def validate(spark: SparkSession, root: str, queries: str) -> dict:
    """Strict reading of the records, and which of their files are missing (the first 20 in order).

    A path is what it stands for on the disk: names of one image that links lead to count once, and one that leads out of
    the root is an error.
    """
    rows = readers.strict(readers.record_errors(readers.queries(spark, queries)))
    paths = rows.select("pos", F.posexplode(F.array(*(F.col("fields")[n] for n in readers.REQUIRED[:3]))).alias("at", "path"))
    paths = walk.resolved(paths, root)
    out = paths.where("target is null").orderBy("pos", "at").select("path").limit(1).collect()
    if out:
        raise DatasetError(f"{out[0].path} leads out of {root}")
    missing = paths.where("not exists")
    counts = paths.agg(F.count_distinct("pos").alias("query_count"), F.count_distinct(F.when(F.col("at") == 0, F.col("target"))).alias("image_count")).first()
    return counts.asDict() | {"missing_count": missing.count(), "missing_preview": [r.target for r in missing.orderBy("pos", "at").limit(20).collect()]}


def grounder(config: dict[str, Any]) -> Callable[[], Any]:
    """What makes the model in a task: config's grounder, 'module:callable', called with grounder_options there. The seed is
    set once the model is loaded, so that loading uses up none of its numbers."""
    module, _, name = str(config.get("grounder", "")).partition(":")
    if not name:
        raise SettingsError("a configuration names its grounder as module:callable")
    options = config.get("grounder_options", {})
    seed = int(config.get("seed", inference.DEFAULTS["seed"]))

    def make() -> Any:
        model = getattr(importlib.import_module(module), name)(**options)
        if hasattr(model, "load"):
            model.load()
        random.seed(seed)
        np.random.seed(seed % (1 << 32))
        if "torch" in sys.modules:
            sys.modules["torch"].manual_seed(seed)
        return model

    return make


def task_profile(config: dict[str, Any]) -> ResourceProfile | None:
    """What a task of the model's stage needs, from config's task_resources {cores, gpus} and executor_resources {cores, memory,
    python_memory, gpus, gpu_discovery}; None where neither is there. Not every cluster manager takes such profiles."""
    task, executor = config.get("task_resources"), config.get("executor_resources")
    if not task and not executor:
        return None
    builder = ResourceProfileBuilder()
    if task:
        wanted = TaskResourceRequests()
        if "cores" in task:
            wanted.cpus(int(task["cores"]))
        if "gpus" in task:
            wanted.resource("gpu", float(task["gpus"]))
        builder.require(wanted)
    if executor:
        has = ExecutorResourceRequests()
        if "cores" in executor:
            has.cores(int(executor["cores"]))
        if "memory" in executor:
            has.memory(executor["memory"])
        if "python_memory" in executor:
            has.pysparkMemory(executor["python_memory"])
        if "gpus" in executor:
            has.resource("gpu", int(executor["gpus"]), executor.get("gpu_discovery", ""))
        builder.require(has)
    return builder.build


def _loaded(spark: SparkSession, config: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Strict records with their order, and where the images are."""
    rows = readers.strict(readers.record_errors(readers.queries(spark, config["queries_path"])))
    return rows, readers.listing(spark, config["dataset_root"])


def _started(spark: SparkSession, config: dict[str, Any], mode: str) -> dict[str, Any]:
    stamp = inference.fingerprint(spark, config | {"fallback_mode": mode})
    inference.record_environment(config["output_dir"], config, stamp)
    return stamp


def _log_boxes(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    return runs.reused(runs.parse_checkpoint(readers.lines(spark, f"{folder}/{inference.LOG}"), rows))


def infer(spark: SparkSession, config: dict[str, Any], limit: int | None = None, build_submission: bool = False, resume: bool = False) -> dict[str, Any]:
    """A run of config, and the submission if asked for, which only a run over the whole dataset can give."""
    rows, files = _loaded(spark, config)
    mode, folder = config.get("fallback_mode", "error"), config["output_dir"]
    found = inference.run(rows, files, grounder(config), folder, limit, mode, config.get("selection_strategy", "first"), resume, _started(spark, config, mode), task_profile(config))
    if build_submission:
        if not found["is_full_dataset_run"]:
            raise SettingsError("only a run over the whole dataset can be submitted")
        submission.write(submission.build(rows, _log_boxes(spark, folder, rows)), f"{folder}/submission.json", f"{folder}/submission.zip")
    return found


def sample(spark: SparkSession, config: dict[str, Any]) -> dict[str, Any]:
    """The one labelled record of config through the model: its IoU, sample_evaluation.json and a picture of both boxes."""
    rows, files = _loaded(spark, config)
    if [r.has for r in rows.select(F.col("box").isNotNull().alias("has")).limit(2).collect()] != [True]:
        raise DatasetError("a sample is exactly one record, with a box")
    folder = config["output_dir"]
    inference.run(rows, files, grounder(config), folder, stamp=_started(spark, config, "error"), profile=task_profile(config))
    found = inference.evaluate(rows, _log_boxes(spark, folder, rows)).first().asDict()
    image = Path(config["dataset_root"], found.pop("visible")).read_bytes()
    Path(folder, "gt_vs_prediction.png").write_bytes(pictures.comparison(image, found["true_bbox"], found["prediction_bbox"]))
    return sinks.summary(found | {"interpretation": "One record is a check of the set-up and says nothing of accuracy."}, f"{folder}/sample_evaluation.json")


def verify(spark: SparkSession, archives: list[str], crc: bool, pinned: dict[str, str] | None = None, output: str | None = None) -> list[dict]:
    """Size, digest, entries and the first damaged member of each archive; raises where one is damaged or not as pinned."""
    rows = integrity.verify_archives(readers.zip_entries(spark, *archives, crc=crc)).orderBy("archive").collect()
    found = [r.asDict() | {"bytes": Path(r.archive).stat().st_size, "sha256": integrity.file_sha256(r.archive)} for r in rows]
    if pinned is not None:
        for r in found:
            if r["bad_member"] or r["sha256"] != pinned.get(r["archive"], r["sha256"]).upper():
                raise DatasetError(f"{r['archive']} is damaged or not the archive named")
    if output:
        sinks.summary({"archives": found}, f"{output}/archive_verification.json")
    return found


def extract(spark: SparkSession, archives: dict[str, str], output: str) -> dict:
    """Unpacks each archive to its folder and audits what lies there; raises if a file is missing, of another size or shared."""
    found = {}
    for archive, target in archives.items():
        entries = readers.zip_entries(spark, archive)
        new = sinks.unpack(entries, archive, target)
        found[archive] = {"new_files": new} | integrity.audit_extraction(entries, readers.listing(spark, target)).first().asDict()
        if any(found[archive][n] for n in ("missing_count", "size_mismatch_count", "collision_count")):
            raise DatasetError(f"{archive} was not unpacked whole: {found[archive]}")
    return sinks.summary(found, f"{output}/extraction_audit.json")


def prepare(spark: SparkSession, name: str, refs: str, instances: str, output: str) -> dict:
    """Split manifests and counters of one dataset of which only the annotations are at hand."""
    found = readers.references(spark, refs)
    images, boxes = readers.instances(spark, instances)
    resolved = annotations.resolve_refs(found.drop("sentences"), images, boxes)
    assigned = splits.isolated(annotations.manifest(resolved, readers.sentences(found), name))
    written = sinks.split_manifests(assigned, output, name)
    return sinks.summary(annotations.dataset_summary(resolved).first().asDict() | {"splits": written}, f"{output}/preparation_summary.json")


def prepare_all(spark: SparkSession, config: dict[str, Any], n_previews: int = 3) -> dict:
    """Every dataset of config with its files below data_root, and the union of those that core names; where a
    configuration names no datasets, the published ones."""
    own = "datasets" in config
    specs = [preparation.Spec(**d) for d in config["datasets"]] if own else list(published.DATASETS)
    core = tuple(config.get("core", () if own else published.CORE))
    return preparation.prepare(spark, config["data_root"], specs, config["output_dir"], core, config.get("core_name", "core" if own else published.CORE_NAME), n_previews)


def everything(spark: SparkSession, config: dict[str, Any]) -> dict:
    """verify with checksums, extract, prepare with three previews. config: archives {path: {target, sha256}}, and prepare_all()'s."""
    at = lambda name: str(Path(config["data_root"], name))
    archives = config.get("archives", {} if "datasets" in config else {at(a): {"target": at(folder)} for a, folder in published.ARCHIVES.items()})
    if archives:
        verify(spark, list(archives), True, {a: v["sha256"] for a, v in archives.items() if v.get("sha256")}, config["output_dir"])
        extract(spark, {a: v["target"] for a, v in archives.items()}, config["output_dir"])
    return prepare_all(spark, config)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="boxlake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "audit"):
        a = sub.add_parser(name)
        a.add_argument("--root", required=True)
        a.add_argument("--queries", required=True)
        if name == "audit":
            a.add_argument("--output")
    for name in ("infer", "sample", "extract", "prepare", "all"):
        a = sub.add_parser(name)
        a.add_argument("--config", required=name != "prepare")
        if name in ("infer", "sample"):
            a.add_argument("--output-dir")
        if name == "infer":
            a.add_argument("--limit", type=int)
            a.add_argument("--build-submission", action="store_true")
            a.add_argument("--resume", action="store_true")
        if name == "prepare":
            a.add_argument("--preview-count", type=int, default=3)
            for part in ("name", "refs", "instances", "output"):
                a.add_argument(f"--{part}")
    a = sub.add_parser("verify")
    a.add_argument("archives", nargs="+")
    a.add_argument("--skip-crc", action="store_true")
    a.add_argument("--pin", action="append", default=[], metavar="ARCHIVE=SHA256")
    a.add_argument("--output")
    return p


def main(args: list[str] | None = None) -> int:
    """0, or 2 if files are missing or an archive is damaged."""
    o = parser().parse_args(args)
    spark = SparkSession.builder.appName("boxlake").getOrCreate()
    config = readers.config(o.config) if getattr(o, "config", None) else {}
    if getattr(o, "output_dir", None):
        config["output_dir"] = o.output_dir
    bad: Any = False
    if o.command == "validate":
        found = validate(spark, o.root, o.queries)
        bad = found["missing_count"]
    elif o.command == "audit":
        found = audit.report(spark, o.root, o.queries)
        if o.output:
            sinks.summary(found, o.output)
    elif o.command == "infer":
        found = infer(spark, config, o.limit, o.build_submission, o.resume)
    elif o.command == "sample":
        found = sample(spark, config)
    elif o.command == "verify":
        try:
            found = verify(spark, o.archives, not o.skip_crc, dict(p.rsplit("=", 1) for p in o.pin), o.output)
        except DatasetError as e:
            found, bad = {"error": str(e)}, True
    elif o.command == "extract":
        found = extract(spark, {a: v["target"] for a, v in config["archives"].items()}, config["output_dir"])
    elif o.command == "prepare":
        found = prepare_all(spark, config, o.preview_count) if o.config else prepare(spark, o.name, o.refs, o.instances, o.output)
    else:
        found = everything(spark, config)
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 2 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
