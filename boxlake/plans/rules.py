"""Further queries over the driver's tables: readers' rules, resumption, audits and previews, each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import adapter, annotations, images, inference, integrity, outputs, runs, splits, stats
from ..sources import readers, sinks
from .catalog import query, table, tidy

#: The first that are missing, as a validation reports them.
PREVIEW = 20


@query(f"SELECT doc_id, source FROM documents ANTI JOIN (SELECT doc_id FROM labels) USING (doc_id) ORDER BY source NULLS FIRST, doc_id LIMIT {PREVIEW}")
def missing_preview(spark, sf):
    """The first missing files in order: a top-k report."""
    files = table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    rows = annotations.with_existence(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "source"), files, "path", "found").where("not found")
    return rows.orderBy("source", "path").limit(PREVIEW).select(F.col("path").alias("doc_id"), "source")


@query("""WITH f AS (SELECT page_id AS id, 'dir/' || CASE page_id % 5 WHEN 0 THEN './' WHEN 1 THEN 'a:b/' WHEN 2 THEN 'NUL.txt/' ELSE '' END || (page_id // 2) || '.html' AS name, strlen(html) AS size FROM pages WHERE page_id % 11 <> 0),
p AS (SELECT name, size, 'dir/' || CASE id % 5 WHEN 1 THEN 'a_b/' WHEN 2 THEN '_NUL.txt/' ELSE '' END || (id // 2) || '.html' AS path FROM f),
l AS (SELECT DISTINCT path, length(path)::BIGINT + 50 AS size FROM p WHERE right(path, 6) <> '7.html'),
j AS (SELECT p.*, l.size AS found FROM p LEFT JOIN l USING (path))
SELECT count(*) AS file_count, count(*) FILTER (found IS NULL) AS missing_count, count(*) FILTER (found <> size) AS size_mismatch_count, count(*) FILTER (name <> path) AS sanitized_count,
 (SELECT count(*) FROM (SELECT path FROM p GROUP BY 1 HAVING count(*) > 1)) AS collision_count FROM j""")
def extraction_audit(spark, sf):
    odd = F.element_at(F.array(*map(F.lit, ("./", "a:b/", "NUL.txt/", "", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("dir/"), odd, F.floor(F.col("page_id") / 2), F.lit(".html"))
    files = table(spark, sf, "pages").withColumn("name", name)
    entries = files.select("name", (F.col("page_id") % 11 == 0).alias("is_dir"), F.octet_length("html").cast("long").alias("size"))
    listing = entries.where("not is_dir").select(t.safe_path(F.col("name")).alias("path")).distinct().where(~F.col("path").endswith("7.html"))
    return integrity.audit_extraction(entries, listing.withColumn("size", F.length("path").cast("long") + 50))


@query("""SELECT 'a' || l_suppkey % 7 AS archive, count(*) AS entry_count, arg_min('m' || l_partkey, l_orderkey * 10 + l_linenumber) FILTER (l_partkey % 97 = 5) AS bad_member FROM lineitem GROUP BY 1""")
def archive_verification(spark, sf):
    rows = table(spark, sf, "lineitem")
    entries = rows.select(F.concat(F.lit("a"), F.col("l_suppkey") % 7).alias("archive"), F.concat(F.lit("m"), "l_partkey").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 97 != 5).alias("crc_ok"))
    return integrity.verify_archives(entries)


@query("""WITH r AS (SELECT DISTINCT 'v' || l_orderkey % 500 AS visible, 'i' || l_partkey % 400 AS infrared, 'd' || l_suppkey % 50 AS depth FROM lineitem),
v AS (SELECT 'v' || i AS visible, (i % 3 + 1)::INT AS w FROM range(450) x(i)), n AS (SELECT 'i' || i AS infrared, (i % 2 + 1)::INT AS w FROM range(400) x(i)), d AS (SELECT 'd' || i AS depth, 1 AS w FROM range(50) x(i))
SELECT visible, infrared, depth, v.w <> n.w OR v.w <> d.w AS size_mismatch FROM r JOIN v USING (visible) JOIN n USING (infrared) JOIN d USING (depth)""")
def image_group_sizes(spark, sf):
    """Triples of which all images were read, and whether their sizes agree."""
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey") % 500).alias("visible"), F.concat(F.lit("i"), F.col("l_partkey") % 400).alias("infrared"), F.concat(F.lit("d"), F.col("l_suppkey") % 50).alias("depth"))
    info = lambda n, top, modulus, whole: spark.range(top).select(F.concat(F.lit(n), "id").alias("path"), (F.col("id") % modulus + 1).cast("int").alias("width"), F.lit(1).alias("height"), F.when(F.col("id") >= whole, "broken").alias("error"))
    found = images.groups(rows, info("v", 500, 3, 450), info("i", 400, 2, 400), info("d", 50, 1, 50))
    return found.select("visible", "infrared", "depth", "size_mismatch")


def _metrics(spark, found: dict) -> DataFrame:
    names = ("valid_bbox_count", "fallback_count", "latency_ms_mean", "inference_latency_seconds_total", "latency_ms_p50", "latency_ms_p95", "invalid_checkpoint_lines")
    row = tuple(round(found[n], 9) if isinstance(found[n], float) else found[n] for n in names)
    return spark.createDataFrame([row], ", ".join(f"{n} {'bigint' if n.endswith(('count', 'lines')) else 'double'}" for n in names))


def _log(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Lines of a log made of events, some of them damaged, and the selected ids."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 9
    box = F.concat(F.lit("[0.1,0.2,"), F.when(k == 1, "0.05").otherwise("0.5"), F.lit(",0.75"), F.when(k == 2, ",1").otherwise(""), F.lit("]"))
    line = F.concat(F.lit('{"query_id":"u'), "user_id", F.lit('","normalized_bbox":'), box, F.when(k == 3, "").otherwise(F.concat(F.lit(',"latency_ms":'), (F.col("event_id") % 100).cast("string"), F.lit(".5"))), F.lit(',"source_suffix":".png","fallback_used":'), F.when(k == 4, "true").otherwise("false"), F.lit("}"))
    value = F.when(k == 5, "not json").when(k == 6, "   ").otherwise(line)
    return e.select(F.col("event_id").alias("line_no"), value.alias("value")), e.where("user_id % 10 <> 3").select(F.concat(F.lit("u"), "user_id").alias("query_id")).distinct()


_LINES = """SELECT event_id, user_id, event_id % 9 AS k FROM events WHERE event_id % 9 = 5 OR (event_id % 9 <> 6 AND user_id % 10 <> 3)"""


@query(f"SELECT k IN (0, 3, 4, 7, 8) AS prediction_ok, k NOT IN (0, 4, 7, 8) AS invalid, count(*) AS n FROM ({_LINES}) GROUP BY 1, 2")
def checkpoint_lines(spark, sf):
    """Lines of a log: sound predictions, invalid lines, and both at once (no latency)."""
    return runs.parse_checkpoint(*_log(spark, sf)).groupBy("prediction_ok", "invalid").agg(F.count("*").alias("n"))


@query(f"SELECT 'u' || user_id AS query_id, max(event_id) AS line_no, 0.5e0 AS x2 FROM ({_LINES}) WHERE k IN (0, 3, 4, 7, 8) GROUP BY 1")
def checkpoint_reused(spark, sf):
    """The last sound prediction of each selected id."""
    return runs.reused(runs.parse_checkpoint(*_log(spark, sf))).select("query_id", "line_no", F.col("box.x2").alias("x2"))


@query(f"""WITH s AS (SELECT user_id, event_id, k, CASE k WHEN 3 THEN NULL ELSE event_id % 100 + 0.5e0 END AS ms FROM ({_LINES}) WHERE k IN (0, 3, 4, 7, 8)),
o AS (SELECT ms, row_number() OVER (ORDER BY ms) AS r, count(*) OVER () AS n FROM s WHERE ms IS NOT NULL)
SELECT count(DISTINCT user_id) AS valid_bbox_count, count(*) FILTER (k = 4) AS fallback_count, round(avg(ms), 9) AS latency_ms_mean, round(sum(ms) / 1000, 9) AS inference_latency_seconds_total,
 (SELECT min(ms) FROM o WHERE r >= round_even((n - 1) * 0.5, 0) + 1) AS latency_ms_p50, (SELECT min(ms) FROM o WHERE r >= round_even((n - 1) * 0.95, 0) + 1) AS latency_ms_p95,
 (SELECT count(*) FROM ({_LINES}) WHERE k NOT IN (0, 4, 7, 8)) AS invalid_checkpoint_lines FROM s""")
def run_summary(spark, sf):
    """Metrics of a run over its log lines; ids that a log has twice count twice but in valid_bbox_count."""
    lines, selected = _log(spark, sf)
    found = inference.summarise(runs.parse_checkpoint(lines, selected), 100, 100, 0)
    return _metrics(spark, found)


@query("SELECT k AS query_id FROM (SELECT DISTINCT user_id AS k FROM events WHERE user_id < 60) ANTI JOIN (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error') USING (k)")
def limited_run_remaining(spark, sf):
    """What a run over the first 60 queries has left to do."""
    e = table(spark, sf, "events")
    chosen = runs.selection(e.select(F.col("user_id").alias("query_id"), F.col("user_id").alias("pos")).distinct(), 60)
    return runs.remaining(chosen, e.where("event_type = 'error'").select(F.col("user_id").alias("query_id"))).select("query_id")


@query("""SELECT p_partkey, coalesce(ann_id, -1) AS ann_id FROM (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_partkey] WHEN 1 THEN [p_size::BIGINT, p_partkey] WHEN 2 THEN [7, 7, 8] ELSE [NULL::BIGINT] END) AS ann_id FROM part)""")
def annotation_ids(spark, sf):
    """A number or a list of numbers; what is neither gives a null, here -1."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, F.concat(F.lit(" ["), "p_size", F.lit(", "), "p_partkey", F.lit("]"))).when(k == 2, "[7,7,8]").otherwise("x")
    return table(spark, sf, "part").select("p_partkey", F.explode(t.scalar_or_list(raw)).alias("ann_id")).na.fill(-1)


@query("SELECT doc_id, left(regexp_replace(doc_id || ' | ' || text, '[^\\x00-\\x7F]', '?', 'g'), 120) AS label FROM documents")
def preview_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.preview_label(F.col("doc_id").cast("string"), F.col("text")).alias("label"))


@query(f"SELECT conv_id, turn, '{adapter.TASK}' || text AS prompt FROM conversations WHERE role = 'user'")
def prompts(spark, sf):
    """What a prompted model is asked."""
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", adapter.prompt_for(F.col("text")).alias("prompt"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/../p' || page_id WHEN 1 THEN '../p' || page_id WHEN 2 THEN './x//y/./p' || page_id WHEN 3 THEN '/p' || page_id WHEN 4 THEN 'a\\b\\..\\p' || page_id ELSE 'a/../../a/p' || page_id END AS path FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'p' || page_id WHEN 2 THEN 'x/y/p' || page_id WHEN 4 THEN 'a/p' || page_id END AS inner_path FROM p""")
def inner_paths(spark, sf):
    """Paths of records below their root; null where one leads out of it."""
    forms = ("a/../p", "../p", "./x//y/./p", "/p", "a\\b\\..\\p", "a/../../a/p")
    path = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 6 + 1).cast("int")), "page_id")
    return table(spark, sf, "pages").select("page_id", t.inner_path(path).alias("inner_path"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '_con' WHEN 1 THEN '_COM' || s_suppkey % 9 + 1 || '.txt' WHEN 2 THEN 'COM0' WHEN 3 THEN '_' ELSE 'a_b' || s_suppkey END AS safe FROM supplier""")
def device_names(spark, sf):
    """Parts that a Windows file system would take for a device, or refuse."""
    k, n = F.col("s_suppkey") % 5, F.col("s_suppkey")
    part = F.when(k == 0, "con").when(k == 1, F.concat(F.lit("COM"), (n % 9 + 1).cast("string"), F.lit(".txt"))).when(k == 2, "COM0").when(k == 3, ". .").otherwise(F.concat(F.lit("a?b"), n.cast("string"), F.lit(".")))
    return table(spark, sf, "supplier").select("s_suppkey", t.safe_path(part).alias("safe"))


@query("""SELECT coalesce(CASE c_custkey % 8 WHEN 1 THEN 'id' WHEN 2 THEN 'missing infrared,query' WHEN 3 THEN 'query' WHEN 4 THEN 'bbox' WHEN 5 THEN 'path depth' WHEN 6 THEN 'path visible' END, 'fine') AS error_code, count(*) FILTER (c_custkey % 8 = 7) AS boxes, count(*) AS n FROM customer GROUP BY 1""")
def record_rules(spark, sf):
    """The first rule that a record breaks."""
    k, name = F.col("c_custkey") % 8, F.col("c_custkey").cast("string")
    of = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    whole = [of("visible", F.when(k == 6, "v/../../x").otherwise(F.concat(F.lit("v/./"), name))), of("infrared", F.concat(F.lit("i/"), name)), of("depth", F.when(k == 5, "").otherwise(F.concat(F.lit("d/"), name))), of("query", F.when(k == 3, " \t").otherwise(name))]
    box = of("bbox", F.when(k == 4, "[0.5,0,0.5,true]").when(k == 7, "[0.5,0,true,0.25]"))
    fields = F.when(k == 2, F.map_from_entries(F.array(whole[0], whole[2]))).when(k.isin(4, 7), F.map_from_entries(F.array(*whole, box))).otherwise(F.map_from_entries(F.array(*whole)))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.when(k == 1, " ").otherwise(name).alias("query_id"), fields.alias("fields"))
    return readers.record_errors(rows).groupBy(F.coalesce("error_code", F.lit("fine")).alias("error_code")).agg(F.count_if(F.col("error_code").isNull() & F.col("box").isNotNull()).alias("boxes"), F.count("*").alias("n"))


@query("""WITH u AS (SELECT 'i' || l_partkey % 300 AS image_key, CASE l_linenumber WHEN 1 THEN 'train' WHEN 2 THEN 'val' WHEN 3 THEN 'testB' ELSE 'train' END AS s, l_suppkey % 9 <> 0 AS image_exists, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 4 = 0 END AS depth_exists FROM lineitem WHERE l_partkey % 3 < 2)
SELECT count(*) AS total_expression_count, count(*) FILTER (NOT image_exists) AS missing_image_record_count, count(*) FILTER (depth_exists = false) AS missing_depth_record_count, (SELECT count(*) FROM (SELECT image_key FROM u GROUP BY 1 HAVING max(CASE WHEN s = 'testB' THEN 3 WHEN s = 'val' THEN 2 ELSE 1 END) = 3)) AS holdout_images FROM u""")
def prepared_totals(spark, sf):
    """Totals over two datasets and the images that their union holds out."""
    line = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_partkey", F.concat(F.lit("i"), F.col("l_partkey") % 300).alias("image_key"), F.when(line == 2, "val").when(line == 3, "testB").otherwise("train").alias("source_split"), (F.col("l_suppkey") % 9 != 0).alias("image_exists"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 4 == 0).alias("depth_exists"))
    union = splits.isolated(reduce(DataFrame.unionByName, (rows.where(F.col("l_partkey") % 3 == k) for k in (0, 1))))
    return union.agg(F.count("*").alias("total_expression_count"), F.count_if(~F.col("image_exists")).alias("missing_image_record_count"), F.count_if(F.col("depth_exists") == F.lit(False)).alias("missing_depth_record_count"), F.count_distinct(F.when(F.col("split") == "holdout", F.col("image_key"))).alias("holdout_images"))


@query("""SELECT doc_id AS image_id, 'd' || doc_id AS query_id, [doc_id, doc_id + 1][2] AS second, nullif(lang, 'de') AS source_split, (doc_id % 2 = 0) AS image_exists, doc_id * 0.5e0 AS x2 FROM documents""")
def manifest_roundtrip(spark, sf):
    """A manifest written as JSON lines and read by its reader, absent fields as nulls."""
    from ..operators.runs import shared_path

    path = shared_path(spark, "manifest")
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(i.alias("image_id"), F.concat(F.lit("d"), i).alias("query_id"), F.array(i, i + 1).alias("ann_ids"), F.nullif("lang", F.lit("de")).alias("source_split"), (i % 2 == 0).alias("image_exists"), F.array(F.lit(0.0), F.lit(0.0), i * 0.5, F.lit(1.0)).alias("bbox_xywh_pixels"))
    sinks.jsonl(rows, path)
    return readers.manifest(spark, path).select("image_id", "query_id", F.col("ann_ids")[1].alias("second"), "source_split", "image_exists", F.col("bbox_xywh_pixels")[2].alias("x2"))


@query("""WITH t AS (SELECT o_orderkey AS query_id, 0.1e0 AS x1, 0.2e0 + o_custkey % 5 * 0.1e0 AS x2 FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT o_orderkey AS query_id, 0.1e0 AS x1, 0.2e0 + o_orderkey % 5 * 0.1e0 AS x2 FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT least(t.x2, p.x2) - 0.1e0 AS i, greatest(t.x2, p.x2) - 0.1e0 AS u FROM t JOIN p USING (query_id))
SELECT count(*) AS n, count(*) FILTER (i / u >= 0.5) AS accurate, round(sum(round(i / u, 9)), 6) AS iou_sum FROM j""")
def sample_evaluation(spark, sf):
    """Labelled records against predictions."""
    o = table(spark, sf, "orders")
    key, fields = F.col("o_orderkey").cast("string"), F.create_map(F.lit("query"), F.lit("q"), F.lit("visible"), F.lit("v"))
    box = lambda c: g.box(F.lit(0.1), F.lit(0.0), 0.2 + F.col(c) % 5 * 0.1, F.lit(1.0))
    rows = o.select(key.alias("query_id"), fields.alias("fields"), F.when(F.col("o_orderkey") % 3 != 0, box("o_custkey")).alias("box"))
    found = inference.evaluate(rows, o.where("o_orderkey % 2 = 0").select(key.alias("query_id"), box("o_orderkey").alias("box")))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("iou") >= 0.5).alias("accurate"), tidy(F.sum(F.round("iou", 9)), 6).alias("iou_sum"))


@query("""SELECT coalesce(CASE s_suppkey % 6 WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'not_four' WHEN 2 THEN 'coordinate' WHEN 3 THEN 'box' END, 'fine') AS error, count(*) AS n, count(*) FILTER (s_suppkey % 6 < 4) AS fallbacks FROM supplier GROUP BY 1""")
def output_errors(spark, sf):
    """Outputs of a model by why they were refused."""
    k = F.col("s_suppkey") % 6
    box = lambda *v: F.array(*map(F.lit, v))
    found = F.when(k == 0, F.array().cast("array<array<string>>")).when(k == 1, F.array(box("1", "1", "5", "5"), box("1", "2", "3"))).when(k == 2, F.array(box("1", "1", "5", "wide"))).when(k == 3, F.array(box("5", "1", "5", "9"))).otherwise(F.array(box("1", "1", "5", "5"), box("nan", "2", "3", "4")))
    rows = table(spark, sf, "supplier").select(found.alias("boxes"), F.array().cast("array<string>").alias("labels"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return outputs.predictions(rows, "center").groupBy(F.coalesce("error", F.lit("fine")).alias("error")).agg(F.count("*").alias("n"), F.count_if("fallback_used").alias("fallbacks"))


@query("SELECT count(*) AS n, coalesce(round(avg(l_quantity) FILTER (l_returnflag = 'X'), 6), 0) AS mean_of_none, coalesce(count(*) FILTER (l_returnflag = 'X') / nullif(count(*) FILTER (l_returnflag = 'X'), 0), 0) AS rate_of_none, count(DISTINCT l_orderkey) FILTER (l_linenumber > 3) AS n_long FROM lineitem")
def empty_aggregates(spark, sf):
    """Means and rates of nothing are 0."""
    x = F.col("l_returnflag") == "X"
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"), stats.mean(F.when(x, F.col("l_quantity"))).alias("mean_of_none"), stats.rate(F.count_if(x), F.count_if(x)).alias("rate_of_none"), F.count_distinct(F.when(F.col("l_linenumber") > 3, F.col("l_orderkey"))).alias("n_long"))


def _json_file(spark, rows: DataFrame, name: str) -> str:
    """A file of one JSON value, the only row of rows; of nations, of which there are as many at every scale."""
    path = runs.shared_path(spark, name)
    rows.coalesce(1).write.text(path)
    return path


@query("""SELECT n_nationkey AS k, lpad(n_nationkey::VARCHAR, 6, '0') || '_001' AS query_id, 'v/' || n_name || '.png' AS visible, CASE n_nationkey % 5 WHEN 1 THEN 'missing depth' WHEN 2 THEN 'query' WHEN 3 THEN 'bbox' END AS error_code, CASE n_nationkey % 5 WHEN 4 THEN 0.75e0 ELSE -1 END AS x2 FROM nation""")
def queries_file(spark, sf):
    """A nested queries file, written and read: its records in order, what is wrong with them, and their boxes."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    box = F.when(k % 5 == 3, F.array(F.lit(0.5), F.lit(0.0), F.lit(0.25), F.lit(1.0))).when(k % 5 == 4, F.array(F.lit(0.5), F.lit(0.0), F.lit(0.75), F.lit(1.0)))
    record = F.struct(F.concat(F.lit("v/"), name, F.lit(".png")).alias("visible"), F.concat(F.lit("i/"), name).alias("infrared"), F.when(k % 5 != 1, F.concat(F.lit("d/"), name)).alias("depth"), F.when(k % 5 == 2, " ").otherwise(name).alias("query"), box.alias("bbox"))
    entry = F.struct(F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit("_001")).alias("key"), record.alias("value"))
    whole = table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    found = readers.record_errors(readers.queries(spark, _json_file(spark, whole, "queries")))
    return found.select(F.col("pos").alias("k"), "query_id", F.col("fields")["visible"].alias("visible"), "error_code", F.coalesce(F.when(F.col("error_code").isNull(), F.col("box.x2")), F.lit(-1.0)).alias("x2"))


@query("""SELECT 'ds:' || n_nationkey AS query_id, n_name AS query, CASE n_regionkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'holdout' END AS split, (n_nationkey % 2 + 1)::BIGINT AS target_count, round((10e0 + n_nationkey % 2 * 5 + 20) / 100, 9) AS x2
 FROM nation WHERE n_nationkey % 7 <> 3 AND n_nationkey % 11 <> 5""")
def annotation_files(spark, sf):
    """References and instances as JSON files, written, read, joined and split; one kind without targets, one without its image."""
    nation = table(spark, sf, "nation")
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    ann = F.when(k % 2 == 0, (k * 10).cast("string")).otherwise(F.concat(F.lit("["), k * 10, F.lit(","), k * 10 + 1, F.lit("]")))
    split = F.when(region % 3 == 0, "train").when(region % 3 == 1, "val").otherwise("testA")
    ref = F.struct(k.alias("ref_id"), k.alias("image_id"), ann.alias("ann_id"), split.alias("split"), (k % 7 == 3).alias("no_target"), F.array(F.struct(k.cast("string").alias("sent_id"), F.concat(F.lit(" "), "n_name").alias("sent"), F.lit("raw").alias("raw"))).alias("sentences"))
    refs = readers.references(spark, _json_file(spark, nation.agg(F.to_json(F.array_sort(F.collect_list(ref))).alias("value")), "references"))
    image = F.when(k % 11 != 5, F.struct(k.alias("id"), F.concat(F.lit("a\\"), "n_name").alias("file_name"), F.lit(100).alias("width"), F.lit(50).alias("height")))
    one = lambda i: F.struct((k * 10 + i).alias("id"), k.alias("image_id"), F.array(F.lit(10.0 + 5 * i), F.lit(1.0), F.lit(20.0), F.lit(8.0)).alias("bbox"))
    whole = nation.agg(F.to_json(F.struct(F.collect_list(image).alias("images"), F.flatten(F.collect_list(F.array(one(0), one(1)))).alias("annotations"))).alias("value"))
    images_, boxes = readers.instances(spark, _json_file(spark, whole, "instances"))
    rows = splits.isolated(annotations.manifest(annotations.resolve_refs(refs.drop("sentences"), images_, boxes), readers.sentences(refs), "ds"))
    return rows.select("query_id", "query", "split", F.col("target_count").cast("long").alias("target_count"), tidy(F.col("bbox_xyxy_normalized")[2]).alias("x2"))


@query("""SELECT split, count(*) AS n, CAST(sum(image_id) AS BIGINT) AS ids FROM (SELECT o_orderkey AS image_id, CASE o_orderpriority[1] WHEN '1' THEN 'train' WHEN '2' THEN 'validation' ELSE 'holdout' END AS split FROM orders WHERE o_orderpriority[1] <> '3') GROUP BY 1""")
def split_manifest_files(spark, sf):
    """Manifests of each split, written and read by their reader."""
    first = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf, "orders").where(first != "3").select(F.col("o_orderkey").alias("image_id"), F.when(first == "1", "train").when(first == "2", "validation").otherwise("holdout").alias("split"))
    folder = runs.shared_path(spark, "manifests")
    sinks.split_manifests(rows, folder, "m")
    every = [readers.manifest(spark, f"{folder}/m_{s}").select(F.lit(s).alias("split"), "image_id") for s in splits.SPLITS]
    return reduce(DataFrame.unionByName, every).groupBy("split").agg(F.count("*").alias("n"), F.sum("image_id").alias("ids"))


@query("""SELECT 'k=' || l_linenumber AS folder, '.json' AS suffix, true AS has_rows FROM lineitem GROUP BY l_linenumber""")
def folder_listing(spark, sf):
    """Regular files below a root, by folder and suffix."""
    path = runs.shared_path(spark, "listing")
    table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("k")).distinct().withColumn("v", F.col("k")).write.partitionBy("k").json(path)
    files = readers.listing(spark, path, "*.json")
    return files.groupBy(F.substring_index("path", "/", 1).alias("folder"), t.suffix(F.col("path")).alias("suffix")).agg((F.sum("size") > 0).alias("has_rows"))
