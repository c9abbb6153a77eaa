"""Readers: nested queries files, references, instances, manifests, checkpoints, archives and directories."""

from __future__ import annotations

import hashlib
import io
import pickle
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions import geometry as g
from ..functions import text as t
from . import json_values, walk
from .archives import zip_entries  # noqa: F401

REQUIRED = ("visible", "infrared", "depth", "query")
REFS = "ref_id bigint, image_id bigint, ann_id string, split string, no_target boolean, sentences array<struct<sent_id:string,sent:string,raw:string>>"
IMAGE, ANNOTATION = "id bigint, file_name string, width int, height int, depth_file_name string", "id bigint, image_id bigint, bbox array<double>"
#: What stands before a member's value that is an array.
_MEMBER = r'^\s*\{?\s*"(images|annotations)"\s*:\s*$'
MANIFEST = "schema_version int, dataset string, query_id string, image_key string, image_id bigint, ref_id bigint, ann_ids array<bigint>, target_count int, query string, source_split string, image_relpath string, image_exists boolean, depth_relpath string, depth_exists boolean, width int, height int, bbox_xywh_pixels array<double>, bbox_xyxy_normalized array<double>, split string"


def queries(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(pos, query_id, fields map<string,string>, source_json) of a JSON object of records, in the file's order.

    Of a repeated id the last record counts, at the first's place. A byte order mark is taken off unless lenient. A file
    that is no object raises DatasetError. Many tasks read a large file; see json_values.elements().
    """
    whole = json_values.elements(spark, path, "{", mark=not lenient)
    parsed = whole.select("pos", F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")).alias("e"))
    if not parsed.where("e is null or size(e) <> 1").isEmpty():
        raise DatasetError(f"{path} is not a JSON object")
    rows = parsed.select("pos", F.col("e")[0]["key"].alias("query_id"), F.col("e")[0]["value"].alias("source_json"))
    rows = rows.groupBy("query_id").agg(F.min("pos").alias("pos"), F.max_by("source_json", "pos").alias("source_json"))
    return rows.select("pos", "query_id", F.from_json("source_json", "map<string,string>").alias("fields"), "source_json")


def record_errors(rows: DataFrame) -> DataFrame:
    """rows of queries() with error_code, the first rule a record breaks (null: none), and its box (null if it has none)."""
    f = F.col("fields")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys(f))
    raw = F.try_element_at(f, F.lit("bbox"))
    box = g.from_array(F.from_json(raw, "array<string>"))
    bad_path = lambda n: t.inner_path(F.coalesce(f[n], F.lit(""))).isNull()
    error = F.when(t.is_blank(F.col("query_id")), "id").when(f.isNull(), "not_object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).when(t.is_blank(f["query"]), "query")
    error = error.when(raw.isNotNull() & (raw != "null") & (box.isNull() | g.normalized_error(box).isNotNull()), "bbox")
    for n in REQUIRED[:3]:
        error = error.when(bad_path(n), f"path {n}")
    return rows.withColumn("error_code", error).withColumn("box", F.when(raw.isNotNull() & (raw != "null"), box))


def strict(rows: DataFrame) -> DataFrame:
    """rows of record_errors() if none has an error; else the first error is raised."""
    first = rows.where("error_code is not null").orderBy("pos").select("query_id", "error_code").limit(1).collect()
    if first:
        raise DatasetError(f"record {first[0].query_id}: {first[0].error_code}")
    return rows


def _structs(elements: DataFrame, fields: str, path: str) -> DataFrame:
    """elements(pos, text) with r, what they are as JSON; an element that is none raises DatasetError."""
    rows = elements.select("*", F.from_json("text", f"struct<{_inline(fields)},_wrong:string>", {"columnNameOfCorruptRecord": "_wrong"}).alias("r"))
    if not rows.where("r._wrong is not null and trim(r._wrong) <> 'null'").isEmpty():
        raise DatasetError(f"{path} is not JSON")
    return rows


def references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_pos, ref_id, image_id, ann_ids, source_split, no_target, n_sentences, sentences) of a JSON array, read by many tasks."""
    rows = _structs(json_values.elements(spark, path, "["), REFS, path)
    return _references(rows.select(F.col("pos").cast("int").alias("ref_pos"), "r.*"))


def _inline(ddl: str) -> str:
    return re.sub(r"(^|, )(\w+) ", lambda m: ("," if m[1] else "") + m[2] + ":", ddl)


def _references(rows: DataFrame) -> DataFrame:
    return rows.select("ref_pos", "ref_id", "image_id", t.scalar_or_list(F.col("ann_id")).alias("ann_ids"), F.col("split").alias("source_split"), "no_target", F.size("sentences").alias("n_sentences"), "sentences")


def sentences(refs: DataFrame) -> DataFrame:
    return refs.select("ref_pos", F.inline("sentences"))


class _NoGlobals(pickle.Unpickler):
    def find_class(self, module: str, name: str) -> Any:
        raise pickle.UnpicklingError(f"global {module}.{name} is forbidden")


def pickled_references(spark: SparkSession, path: str, sha256: str | None) -> DataFrame:
    """references() of a pickle of plain lists and dicts. Its digest must be given and agree; no global is ever loaded."""
    import json

    if not sha256:
        raise DatasetError("a pickle is only read with its SHA-256")
    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha256.lower():
        raise DatasetError(f"SHA-256 of {path} is not as given")
    rows = _NoGlobals(io.BytesIO(data), encoding="latin1").load()
    if not isinstance(rows, list):
        raise DatasetError(f"{path} is not a list")
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ref_pos int, value string")
    return _references(lines.select("ref_pos", F.from_json("value", f"struct<{_inline(REFS)}>").alias("r")).select("ref_pos", "r.*"))


def instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """images(image_id, file_name, width, height, depth_file_name) and annotations(ann_id, x, y, w, h); the last of an id counts.

    Both are arrays of one JSON object, whose other members are not looked at; many tasks read a large file.
    """
    parts = json_values.elements(spark, path, "{", level=2)
    named = parts.where((F.col("pos") == -1) & F.col("text").rlike(_MEMBER)).select("member", F.regexp_extract("text", _MEMBER, 1).alias("name")).collect()
    found = []
    for name, fields in (("images", IMAGE), ("annotations", ANNOTATION)):
        members = [r["member"] for r in named if r["name"] == name]
        rows = _structs(parts.where(F.col("member").isin(members[-1:]) & (F.col("pos") >= 0)), fields, path)
        found.append(rows.groupBy(F.col("r.id").alias("id")).agg(F.max_by("r", "pos").alias("r")))
    images, boxes = found
    return (
        images.select(F.col("id").alias("image_id"), "r.file_name", "r.width", "r.height", "r.depth_file_name"),
        boxes.select(F.col("id").alias("ann_id"), *(F.get(F.col("r.bbox"), i).alias(n) for i, n in enumerate("xywh"))),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL manifest; blank lines are skipped."""
    return spark.read.schema(MANIFEST).json(path)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, value) of a text file, a folder of them, or several. line_no grows in reading order, with gaps: numbering without
    them would put all lines in one task. Files of a folder are read in the order in which they were written."""
    rows = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select(at.alias("line_no"), "value")


def listing(spark: SparkSession, root: str, glob: str | None = None, content: bool = False) -> DataFrame:
    """(path relative to root, size[, content], location) of the files below root; location is a file's URI.

    Folders that the tasks can open are walked by them, see walk.walk(): links are followed, and empty and hidden files
    listed. Of another store Spark lists what it reads, which leaves those out.
    """
    if walk.local(root):
        return walk.files(spark, root, glob, content).drop("target")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = re.sub("^[a-z0-9]+:/+[^/]*", "", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+[^/]*", ""), "^\\Q" + base + "\\E/", "")
    return rows.select(relative.alias("path"), F.col("length").alias("size"), *([F.col("content")] if content else []), F.col("path").alias("location"))


def config(path: str) -> dict[str, Any]:
    """A YAML (or JSON) file whose top level is an object."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        import json

        found = json.loads(text)
    if not isinstance(found, dict):
        raise DatasetError(f"{path} is not an object")
    return found
