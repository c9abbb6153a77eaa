"""A report on a dataset of image triples and queries: fields, texts, files, formats, anomalies and sizes."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import readers
from . import images

MODALITIES = readers.REQUIRED[:3]
#: The rare word whose queries are listed (a fixed value), and the report's notes on how to read it.
RARE_WORD = "typhlosolis"
NOTES = {
    "jpeg_depth": "A JPEG of three uint8 channels does not give depth in millimetres.",
    "alignment": "Equal sizes do not mean aligned pixels.",
    "query_flags": "Lists of odd texts come from automatic screening, not from annotators.",
}


def located(path: Column, root: str) -> Column:
    """Path below root: absolute paths stay, unless they are below root; nothing else is resolved."""
    p = F.regexp_replace(t.posix(path), r"\A(\./)+", "")
    base = root.rstrip("/").removeprefix("file://") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).otherwise(p)


def record_flags(rows: DataFrame, root: str) -> DataFrame:
    """rows of readers.queries(lenient=True) with bad_id, absent (fields), blank, cjk, rare and the three paths.

    A record that lacks a field has its id judged and nothing else; its flags and paths are null.
    """
    f = F.col("fields")
    absent = F.array_except(F.array(*map(F.lit, readers.REQUIRED)), F.coalesce(F.map_keys(f), F.array().cast("array<string>")))
    whole = F.size(absent) == 0
    query = F.coalesce(F.try_element_at(f, F.lit("query")), F.lit("None"))
    flags = {"blank": t.is_blank(query), "cjk": t.has_cjk(query), "rare": t.mentions(query, RARE_WORD)} | {m: located(F.coalesce(F.try_element_at(f, F.lit(m)), F.lit("None")), root) for m in MODALITIES}
    return rows.select("pos", "query_id", (~t.is_query_id(F.col("query_id"))).alias("bad_id"), absent.alias("absent"), *(F.when(whole, c).alias(n) for n, c in flags.items()))


def referenced(flags: DataFrame) -> DataFrame:
    """Distinct (modality, path) that records name."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), F.col(m).alias("path")) for m in MODALITIES)))
    return flags.where(F.size("absent") == 0).select(pairs.alias("p")).select("p.*").distinct()


def scanned(paths: DataFrame, files: DataFrame) -> DataFrame:
    """images.INFO, modality and anomalous of those paths that files(path, location) has; each image is read once a modality,
    by the task that inspects it: what is joined are names."""
    parts = []
    for m in MODALITIES:
        wanted = files.join(paths.where(F.col("modality") == m).select("path"), "path", "left_semi")
        parts.append(images.inspect(wanted, m).withColumn("modality", F.lit(m)))
    found = reduce(DataFrame.unionByName, parts)
    odd = images.anomalous(F.col("modality"), F.col("format"), F.col("dtype"), F.col("channels"), F.col("max_value"), F.col("min_value"))
    return found.withColumn("anomalous", F.when(F.col("error").isNull(), odd))


def report(spark: SparkSession, root: str, queries: str) -> dict[str, Any]:
    """The whole report. Lists hold what is wrong, which is what a report is for; counts are made by Spark.

    Texts and files are judged without resolving paths. An image that cannot be decoded is listed and the scan goes on.
    """
    flags = record_flags(readers.queries(spark, queries, lenient=True), root).persist()
    listing = readers.listing(spark, root)
    paths = referenced(flags).persist()
    info = scanned(paths, listing).persist()
    ids = lambda condition: [r.query_id for r in flags.where(condition).orderBy("pos").select("query_id").collect()]
    triples = flags.where(F.size("absent") == 0).select(*MODALITIES)
    missing = paths.join(listing, "path", "left_anti").select("path").distinct().orderBy("path")
    good = info.where("error is null")
    key = t.format_key(t.suffix(F.col("path")), F.col("format"), F.col("dtype"), F.concat(F.col("channels").cast("string"), F.lit("ch")), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))
    formats: dict[str, dict[str, int]] = {m: {} for m in MODALITIES}
    for r in good.groupBy("modality", key.alias("key")).count().orderBy("modality", "key").collect():
        formats[r.modality][r.key] = r["count"]
    per_modality = {r.modality: r["count"] for r in paths.groupBy("modality").count().collect()}
    wrong = images.groups(triples, *(good.where(F.col("modality") == m) for m in MODALITIES)).where("size_mismatch").orderBy(*MODALITIES)
    shape = lambda s: [s["width"], s["height"]]
    try:
        return {
            "dataset_root": root, "queries_path": queries, "query_count": flags.count(), "image_group_count": triples.distinct().count(), "unique_image_counts": {m: per_modality.get(m, 0) for m in MODALITIES},
            "json": {
                "missing_fields": [{"query_id": r.query_id, "fields": r.absent} for r in flags.where(F.size("absent") > 0).orderBy("pos").collect()],
                "invalid_query_ids": ids("bad_id"), "empty_queries": ids("blank"), "cjk_query_ids": ids("cjk"), f"{RARE_WORD}_query_ids": ids("rare"),
            },
            "missing_files": [r.path for r in missing.collect()],
            "image_format_counts": formats,
            "decode_failures": [r.asDict() for r in info.where("error is not null").select("modality", "path", "error").orderBy("modality", "path").collect()],
            "image_anomalies": [r.asDict() for r in info.where("anomalous").drop("anomalous", "error").orderBy("modality", "path").collect()],
            "modality_size_mismatches": [{"visible": r.visible, "sizes": {m: shape(r[f"{m}_size"]) for m in MODALITIES}} for r in wrong.collect()],
            "interpretation": NOTES,
        }
    finally:
        for df in (info, paths, flags):
            df.unpersist()
