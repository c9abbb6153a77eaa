"""Queries over large single files and archives, which tasks write from the driver's tables and read back; each with its DuckDB SQL."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import SettingsError
from ..functions import exact
from ..functions import text as t
from ..operators import annotations, integrity, run_state, runs
from ..sources import json_values, line_index, one_file, readers, sinks, walk
from .catalog import query, table


def _folder(spark, name: str) -> str:
    """A fresh shared folder, as a path that tasks open."""
    path = walk.local(runs.shared_path(spark, name))
    if path is None:
        raise SettingsError("spark.checkpoint.dir must be a folder that tasks can open")
    Path(path).mkdir(parents=True)
    return path


@query("""WITH d AS (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT 'q' || doc_id // 2 AS query_id, min(pos) AS pos, arg_max(coalesce(lang, '?'), pos) AS visible, CAST(length(arg_max(coalesce(text, ''), pos)) AS BIGINT) AS chars, sha256(arg_max(coalesce(text, ''), pos)) AS digest FROM d GROUP BY doc_id // 2""")
def large_queries_file(spark, sf):
    """All documents as records of one JSON object with a byte order mark, ids repeated: the last counts, at the first's place."""
    docs = table(spark, sf, "documents")
    record = F.to_json(F.struct(F.coalesce("lang", F.lit("?")).alias("visible"), F.coalesce("text", F.lit("")).alias("query")))
    said = docs.select("doc_id", F.concat(F.lit('"q'), F.floor(F.col("doc_id") / 2).cast("string"), F.lit('": '), record).alias("said"))
    path = f"{_folder(spark, 'queries')}/queries.json"
    one_file.write(said, ["doc_id"], "said", path, b"\xef\xbb\xbf{", b",\n", b"}\n")
    f = F.col("fields")
    return readers.queries(spark, f"file://{path}").select("query_id", "pos", f["visible"].alias("visible"), F.length(f["query"]).cast("long").alias("chars"), F.sha2(f["query"], 256).alias("digest"))


@query("""SELECT (SELECT count(*) FROM orders) AS reference_count, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 3 AND o_custkey % 11 <> 5) AS expression_count,
 (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 3) AS excluded_no_target_count, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 3 AND o_custkey % 11 = 5) AS missing_image_count, 0::BIGINT AS missing_annotation_count, 0::BIGINT AS invalid_bbox_count""")
def large_annotation_files(spark, sf):
    """Orders as references, customers as images and orders again as annotations, in two JSON files; some without targets, some without image."""
    orders, folder = table(spark, sf, "orders"), _folder(spark, "annotations")
    k = F.col("o_orderkey")
    ref = F.to_json(F.struct(k.alias("ref_id"), F.col("o_custkey").alias("image_id"), F.array(k).alias("ann_id"), F.lit("train").alias("split"), (k % 7 == 3).alias("no_target"), F.array(F.struct(k.cast("string").alias("sent_id"), F.lit('the "one", {here}').alias("sent"), F.lit("").alias("raw"))).alias("sentences")))
    one_file.write(orders.select("o_orderkey", ref.alias("said")), ["o_orderkey"], "said", f"{folder}/references.json", b"[", b", ", b"]")
    image = table(spark, sf, "customer").where("c_custkey % 11 <> 5").select(F.lit(0).alias("kind"), F.col("c_custkey").alias("k"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.lit("a],[b").alias("file_name"), F.lit(100).alias("width"), F.lit(50).alias("height"))).alias("said"))
    box = orders.select(F.lit(1).alias("kind"), k.alias("k"), F.to_json(F.struct(k.alias("id"), F.col("o_custkey").alias("image_id"), F.array(F.lit(10.0), F.lit(1.0), F.lit(20.0), F.lit(8.0)).alias("bbox"))).alias("said"))
    # The first annotation ends the array of images before it.
    least = box.agg(F.min("k").alias("least"))
    opened = box.join(F.broadcast(least), F.col("k") == F.col("least"), "left").withColumn("said", F.when(F.col("least").isNotNull(), F.concat(F.lit('null], "annotations": ['), "said")).otherwise(F.col("said"))).drop("least")
    one_file.write(image.unionByName(opened), ["kind", "k"], "said", f"{folder}/instances.json", b'{"info": {"by": ["x", "]"]}, "images": [', b",", b"]}")
    images, boxes = readers.instances(spark, f"file://{folder}/instances.json")
    return annotations.dataset_summary(annotations.resolve_refs(readers.references(spark, f"file://{folder}/references.json").drop("sentences"), images, boxes))


@query("""SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, true AS crc_ok, 'in_p/' || page_id || '.html' AS path, true AS unpacked FROM pages""")
def archive_members(spark, sf):
    """Pages packed into archives, one a task; their members read in slices, checked, unpacked to safe paths and audited by name and size."""
    folder = _folder(spark, "archives")
    (Path(folder) / "out").mkdir()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{folder}/{TaskContext.get().partitionId()}.{TaskContext.get().taskAttemptId()}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z.writestr(f"in:p/./{page_id}.html", html or "")
        yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string())})

    pages = table(spark, sf, "pages").select("page_id", "html").repartition(3, "page_id")
    archives = [r["path"] for r in pages.mapInArrow(pack, "path string").collect()]
    entries = readers.zip_entries(spark, *archives, crc=True, partition=1 << 20, members=100)
    for path in archives:
        sinks.unpack(entries.where(F.col("archive") == path), path, f"{folder}/out")
    there = readers.listing(spark, f"{folder}/out").select("path", F.col("size").alias("found"))
    rows = entries.withColumn("path", t.safe_path(F.col("name"))).join(there, "path", "left")
    return rows.select(F.regexp_extract("name", r"(\d+)\.html", 1).cast("long").alias("page_id"), "size", "crc_ok", "path", (F.col("found") == F.col("size")).alias("unpacked"))


@query("SELECT count(*) + 1 AS file_count, 0::BIGINT AS missing_count, 0::BIGINT AS size_mismatch_count, count(*) AS sanitized_count, 0::BIGINT AS collision_count FROM pages")
def archive_audit(spark, sf):
    """All pages and one more file in one archive, unpacked in slices and held against the listing."""
    folder = _folder(spark, "audit")
    pages = table(spark, sf, "pages").select("page_id", "html")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(f"{folder}/one.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("plain.txt", "plain")
            for batch in batches:
                for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z.writestr(f"a?b/{page_id}.html", (html or "") + " ")
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    pages.repartition(1).mapInArrow(pack, "n long").collect()
    entries = readers.zip_entries(spark, f"{folder}/one.zip", members=50)
    sinks.unpack(entries, f"{folder}/one.zip", f"{folder}/out")
    return integrity.audit_extraction(entries, readers.listing(spark, f"{folder}/out"))


@query("""SELECT conv_id, turn, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS pos, sha256(coalesce(text, '')) AS digest FROM conversations""")
def large_json_array(spark, sf):
    """All turns as one JSON array in order, cut into its elements, with their places."""
    rows = table(spark, sf, "conversations")
    path = f"{_folder(spark, 'array')}/turns.json"
    one_file.write(rows.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))).alias("said")), ["conv_id", "turn"], "said", path, b"[\n", b",\n", b"\n]\n")
    found = json_values.elements(spark, f"file://{path}", "[").select("pos", F.from_json("text", rows.select("conv_id", "turn", "text").schema).alias("r"))
    return found.select("r.conv_id", "r.turn", "pos", F.sha2("r.text", 256).alias("digest"))


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, doc_id, lang, sha256(coalesce(text, '')) AS digest FROM documents)
SELECT number, d.doc_id, lang, digest FROM d JOIN (SELECT DISTINCT doc_id FROM labels) l ON number = l.doc_id""")
def manifest_by_number(spark, sf):
    """All documents as one JSON-lines file; the lines whose numbers the labels name, fetched through its index."""
    docs, folder = table(spark, sf, "documents"), _folder(spark, "lines")
    said = F.to_json(F.struct("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")))
    one_file.write(docs.select("doc_id", said.alias("said")), ["doc_id"], "said", f"{folder}/m.jsonl", between=b"\n", tail=b"\n")
    line_index.build(spark, f"{folder}/m.jsonl", f"{folder}/index")
    found = line_index.Lines(spark, f"{folder}/index").fetch(table(spark, sf, "labels").select(F.col("doc_id").alias("number")))
    r = F.from_json("value", docs.select("doc_id", "lang", "text").schema)
    return found.select("number", r.alias("r")).select("number", "r.doc_id", "r.lang", F.sha2("r.text", 256).alias("digest"))


@query("""SELECT l_returnflag, sum(l_linenumber) / 1048576e0 AS v_total, sum(l_linenumber) / 1048576e0 / (3 * count(*)) AS v_mean FROM lineitem GROUP BY 1""")
def exact_means(spark, sf):
    """Sums whose terms cancel but for a small rest that plain sums lose, and their means, by key."""
    large = F.col("l_quantity") * F.pow(F.lit(2.0), F.lit(60.0) + F.col("l_orderkey") % 40)
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.explode(F.array(large, F.col("l_linenumber") * F.pow(F.lit(2.0), F.lit(-20.0)), -large)).alias("v"))
    return exact.means(rows, {"v": F.col("v")}, ["l_returnflag"])


_RUN = "SELECT event_id, user_id, l_extendedprice AS ms, event_id % 9 AS k FROM events JOIN (SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1) ON l_orderkey = event_id"


@query(f"""WITH s AS (SELECT user_id, k, CASE k WHEN 3 THEN NULL ELSE ms END AS ms FROM ({_RUN}) WHERE k NOT IN (1, 5)),
o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS r, count(*) OVER () AS n FROM s WHERE ms IS NOT NULL)
SELECT count(DISTINCT user_id) AS valid_bbox_count, count(*) FILTER (k = 4) AS fallback_count, (SELECT count(*) FROM ({_RUN}) WHERE k IN (1, 3, 5)) AS invalid_checkpoint_lines,
 (SELECT min(ms) FROM o WHERE r >= round_even((n - 1) * 0.5, 0) + 1) AS latency_ms_p50, (SELECT min(ms) FROM o WHERE r >= round_even((n - 1) * 0.95, 0) + 1) AS latency_ms_p95,
 round(avg(ms), 6) AS latency_ms_mean, round(sum(ms) / 1000, 6) AS inference_latency_seconds_total, true AS same FROM s""")
def run_state_pieces(spark, sf):
    """A log of events that grows in three pieces; after each the state takes in the new files only. Beside the metrics:
    whether they equal, bit for bit, those of one reading of the whole log."""
    took = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").cast("double").alias("ms"))
    e = table(spark, sf, "events").join(took, F.col("event_id") == F.col("l_orderkey"))
    k = F.col("event_id") % 9
    box = F.array(F.lit(0.1), F.lit(0.2), F.when(k == 1, 0.05).otherwise(0.5), F.lit(0.75))
    line = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("query_id"), F.lit(".png").alias("source_suffix"), box.alias("normalized_bbox"), (k == 4).alias("fallback_used"), F.when(k != 3, F.col("ms")).alias("latency_ms")))
    lines = e.select("event_id", F.when(k == 5, "not json").otherwise(line).alias("value"))
    folder = _folder(spark, "run")
    state = run_state.RunState(spark, f"{folder}/state", f"{folder}/log")
    for piece in range(3):
        lines.where(F.col("event_id") % 3 == piece).select("value").write.mode("append").text(f"{folder}/log")
        state.cover()
    found = run_state.metrics(state.parts())
    whole = run_state.metrics(run_state.store(runs.parsed_lines(readers.lines(spark, f"{folder}/log")), f"{folder}/whole"))
    counts, reals = ("valid_bbox_count", "fallback_count", "invalid_checkpoint_lines"), ("latency_ms_p50", "latency_ms_p95", "latency_ms_mean", "inference_latency_seconds_total")
    row = (*(found[n] for n in counts), *(round(found[n], 6) for n in reals), found == whole)
    return spark.createDataFrame([row], ", ".join([f"{n} long" for n in counts] + [f"{n} double" for n in reals] + ["same boolean"]))
