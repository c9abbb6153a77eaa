"""Several annotated datasets made ready for training: manifests, leak-free splits, previews, totals and digests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions import text as t
from ..sources import readers, sinks
from . import annotations, integrity, pictures, splits

#: What a manifest's rows are written with.
COLUMNS = tuple(f.split()[0] for f in readers.MANIFEST.replace("array<double>", "a").replace("array<bigint>", "a").split(", "))


@dataclass(frozen=True)
class Spec:
    """Where a dataset lies below the root. Datasets on one set of images share a namespace, and so their splits' keys."""

    name: str
    refs: str
    instances: str
    refs_sha256: str | None = None
    namespace: str = ""
    prefix: str = ""
    depth_prefix: str | None = None


def records(spark: SparkSession, root: str, spec: Spec, listing: DataFrame) -> tuple[DataFrame, dict[str, Any]]:
    """Manifest rows (with order) of a dataset, and its counters. A pickle needs its digest; another file's is checked if given."""
    path = f"{root}/{spec.refs}"
    if Path(path).suffix in (".p", ".pkl", ".pickle"):
        refs = readers.pickled_references(spark, path, spec.refs_sha256)
    else:
        if spec.refs_sha256 and integrity.file_sha256(path) != spec.refs_sha256.upper():
            raise DatasetError(f"SHA-256 of {path} is not as given")
        refs = readers.references(spark, path)
    images, boxes = readers.instances(spark, f"{root}/{spec.instances}")
    resolved = annotations.resolve_refs(refs.drop("sentences"), images, boxes)
    rows = annotations.manifest(resolved, readers.sentences(refs), spec.name, spec.namespace, spec.prefix, keep=("ref_pos", "depth_file_name"))
    rows = annotations.with_files(rows, listing, spec.depth_prefix).withColumn("order", F.struct("ref_pos", "query_id")).drop("ref_pos")
    found = annotations.dataset_summary(resolved).first().asDict()
    # A file that is absent counts like an image that is in no table, but its records stay.
    kept = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("image_exists")).alias("absent")).first()
    return rows, found | {"expression_count": kept.n, "missing_image_count": found["missing_image_count"] + kept.absent}


def split_summary(assigned: DataFrame) -> dict[str, Any]:
    """record_counts of the splits that have any, image_counts of all three, and the overlap, which is none."""
    rows = {r.split: r for r in splits.summary(assigned).collect()}
    return {
        "record_counts": {s: rows[s].record_count for s in splits.SPLITS if rows[s].record_count},
        "image_counts": {s: rows[s].image_count for s in splits.SPLITS},
        "image_overlap_count": splits.overlap(assigned).first().overlap_count,
    }


def previews(rows: DataFrame, root: str, folder: str, name: str, n: int) -> int:
    """Pictures of the first n images that exist, each with a record's box; those of an earlier call go first.

    At most n rows reach the driver, which draws them. JPEGs need the imaging library; without it they are left out.
    """
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    for old in target.glob(f"{name}_*.png"):
        old.unlink()
    chosen = annotations.first_distinct(rows.where("image_exists"), "image_key", "order", n).withColumn("label", t.preview_label(F.col("query_id"), F.col("query")))
    drawn = 0
    for r in chosen.orderBy("preview").select("preview", "split", "image_relpath", "bbox_xyxy_normalized", "label").collect():
        try:
            picture = pictures.preview(Path(root, r.image_relpath).read_bytes(), r.bbox_xyxy_normalized, r.label)
        except DatasetError:
            continue
        (target / f"{name}_{r.preview:02d}_{r.split}.png").write_bytes(picture)
        drawn += 1
    return drawn


def prepare(spark: SparkSession, root: str, specs: list[Spec], output: str, core: tuple[str, ...] = (), core_name: str = "core", n_previews: int = 3) -> dict[str, Any]:
    """Writes split manifests of each dataset and of the union of core, previews, preparation_summary.json and
    manifest_sha256.json below output; then raises DatasetError if records name files that are missing.

    A dataset's splits and those of the union are made apart, so a record may be in different ones.
    """
    listing = readers.listing(spark, root).select("path").persist()
    made: dict[str, DataFrame] = {}
    summary: dict[str, Any] = {"schema_version": 1, "datasets": {}, "preview_counts": {}}
    try:
        for spec in specs:
            rows, found = records(spark, root, spec, listing)
            made[spec.name] = splits.isolated(rows).persist()
            summary["datasets"][spec.name] = found | {"split_summary": split_summary(made[spec.name])}
            sinks.split_manifests(made[spec.name].select(*COLUMNS), output, spec.name)
            summary["preview_counts"][spec.name] = previews(made[spec.name], root, f"{output}/previews", spec.name, n_previews)
        if core:
            union = splits.isolated(reduce(DataFrame.unionByName, (made[n].drop("split") for n in core))).persist()
            sinks.split_manifests(union.select(*COLUMNS), output, core_name)
            summary[core_name] = {"datasets": list(core), "split_summary": split_summary(union)}
            union.unpersist()
        every = reduce(DataFrame.unionByName, made.values())
        totals = every.agg(F.count("*").alias("total_expression_count"), F.count_if(~F.col("image_exists")).alias("missing_image_record_count"), F.count_if(F.col("depth_exists") == F.lit(False)).alias("missing_depth_record_count")).first().asDict()
    finally:
        for df in (listing, *made.values()):
            df.unpersist()
    sinks.summary(summary | totals, f"{output}/preparation_summary.json")
    names = [f"{n}_{s}" for n in (*made, *([core_name] if core else ())) for s in splits.SPLITS]
    sinks.summary({n: {"bytes": sum(p.stat().st_size for p in Path(output, n).glob("part-*")), "sha256": integrity.folder_digest(readers.listing(spark, f"{output}/{n}", "part-*", content=True)).first().artifact_sha256} for n in names}, f"{output}/manifest_sha256.json")
    if totals["missing_image_record_count"] or totals["missing_depth_record_count"]:
        raise DatasetError(f"missing images: {totals['missing_image_record_count']}, missing depth images: {totals['missing_depth_record_count']}")
    return summary | totals
