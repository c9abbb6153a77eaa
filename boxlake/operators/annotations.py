"""Referring expressions, images and annotations joined to one flat manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t


def last_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by position: a later one replaces an earlier one."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), position).alias("_r")).select(key, "_r.*")


def resolve_refs(refs: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """refs with image, union box and reject_reason (null: kept).

    refs(ref_pos, image_id, ann_ids array<bigint>, n_sentences, no_target), images(image_id, width, height, ...) and
    annotations(ann_id, x, y, w, h), the last two one row an id. Reasons in order: no_target, missing_image,
    missing_annotation (none named, or not all found), invalid_bbox. Duplicate ids in ann_ids count each time. A member
    box of no size is fine if the union has one; which number wins over NaN follows Spark's max.
    """
    named = refs.select("ref_pos", F.explode("ann_ids").alias("ann_id"))
    found = named.join(annotations.withColumn("_hit", F.lit(1)), "ann_id", "left")
    union = found.groupBy("ref_pos").agg(F.count("*").alias("n_named"), F.count("_hit").alias("n_found"), *g.union_xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    rows = refs.join(images.withColumn("_image", F.lit(1)), "image_id", "left").join(union, "ref_pos", "left")
    valid = g.xywh_valid(*map(F.col, ("x", "y", "w", "h", "width", "height")))
    reason = F.when(F.coalesce("no_target", F.lit(False)), "no_target").when(F.col("_image").isNull(), "missing_image")
    reason = reason.when(F.coalesce("n_named", F.lit(0)) != F.coalesce("n_found", F.lit(-1)), "missing_annotation").when(~valid, "invalid_bbox")
    return rows.withColumn("reject_reason", reason).drop("_image")


def dataset_summary(resolved: DataFrame) -> DataFrame:
    """One row of counters; all but reference_count are by sentence."""
    n = F.coalesce("n_sentences", F.lit(0))
    of = lambda reason, name: F.coalesce(F.sum(F.when(F.col("reject_reason") == reason, n)), F.lit(0)).cast("long").alias(name)
    return resolved.agg(
        F.count("*").alias("reference_count"),
        F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), n)), F.lit(0)).cast("long").alias("expression_count"),
        of("no_target", "excluded_no_target_count"), of("missing_image", "missing_image_count"), of("missing_annotation", "missing_annotation_count"), of("invalid_bbox", "invalid_bbox_count"),
    )


def manifest(resolved: DataFrame, sentences: DataFrame, dataset: str, namespace: str = "", prefix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each kept sentence: sentences(ref_pos, sent_id, sent, raw); image file names in column file_name.

    keep names columns of resolved that are wanted besides.
    """
    kept = resolved.where("reject_reason is null")
    box = g.xywh_normalized(*map(F.col, ("x", "y", "w", "h", "width", "height")))
    rows = kept.join(sentences, "ref_pos").withColumn("query", t.query_text(F.col("sent"), F.col("raw"))).where("query <> ''")
    return rows.select(
        F.lit(1).alias("schema_version"), F.lit(dataset).alias("dataset"), t.record_id(F.lit(dataset), F.col("sent_id")).alias("query_id"), t.image_key(F.lit(namespace), F.lit(dataset), F.col("image_id")).alias("image_key"),
        "image_id", "ref_id", "ann_ids", F.size("ann_ids").alias("target_count"), "query", "source_split", t.join_prefix(F.lit(prefix), t.posix(F.col("file_name"))).alias("image_relpath"), "width", "height",
        F.array("x", "y", "w", "h").alias("bbox_xywh_pixels"), g.to_array(box).alias("bbox_xyxy_normalized"), *keep,
    )


def with_existence(rows: DataFrame, listing: DataFrame, path: str, name: str) -> DataFrame:
    """rows with a boolean column name: whether path is in listing(path). The listing is joined once, nothing is probed a row."""
    known = listing.select(F.col("path").alias(path), F.lit(True).alias(name)).distinct()
    return rows.join(known, path, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_files(rows: DataFrame, listing: DataFrame, depth_prefix: str | None = None) -> DataFrame:
    """Rows of manifest(keep=("depth_file_name", ...)) with image_exists, depth_relpath and depth_exists.

    depth_exists is null where a row has no depth image or depth_prefix is None: then there is none to miss.
    """
    out = with_existence(rows, listing, "image_relpath", "image_exists")
    depth = t.join_prefix(F.lit(depth_prefix or ""), t.posix(F.nullif(F.col("depth_file_name"), F.lit(""))))
    known = listing.select(F.col("path").alias("depth_relpath"), F.lit(True).alias("_depth")).distinct()
    out = out.withColumn("depth_relpath", depth).join(known, "depth_relpath", "left")
    has = F.col("depth_relpath").isNotNull() & F.lit(depth_prefix is not None)
    return out.withColumn("depth_exists", F.when(has, F.coalesce("_depth", F.lit(False)))).drop("_depth", "depth_file_name")


def first_distinct(rows: DataFrame, key: str, position: str, n: int) -> DataFrame:
    """The first row of each key by position, of these the first n, numbered from 1 in column preview. Filter rows before."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(position))).where("_k = 1").drop("_k")
    return first.orderBy(position).limit(n).withColumn("preview", F.row_number().over(Window.orderBy(position)))
