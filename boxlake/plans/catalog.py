"""Queries over the driver's tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import annotations, images, outputs, splits, stats, submission

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def boxes(spark: SparkSession, sf: str, wide: float = 100.0, *more: str) -> DataFrame:
    """A box for each line item, as fractions of an image."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    d, x = F.col("l_discount") + 0.0, F.col("l_tax") + 0.0
    return table(spark, sf, "lineitem").select(*keys, *more, g.box(d, x, d + F.col("l_quantity") / wide, x + F.col("l_quantity") / 60.0).alias("box"))


def tidy(c, digits: int = 9):
    return F.round(c, digits) + 0.0


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
IDS = KEYS.split(", ")


def sql_boxes(wide: str = "100", more: str = "") -> str:
    return f"SELECT {KEYS}{more}, l_discount + 0e0 AS x1, l_tax + 0e0 AS y1, l_discount + 0e0 + l_quantity / {wide}e0 AS x2, l_tax + 0e0 + l_quantity / 60e0 AS y2 FROM lineitem"


SQL_ERROR = "CASE WHEN NOT (x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x2 BETWEEN 0 AND 1 AND y2 BETWEEN 0 AND 1) THEN 'out_of_range' WHEN NOT (x1 < x2 AND y1 < y2) THEN 'no_area' END"


@query(f"SELECT coalesce({SQL_ERROR}, 'valid') AS error_code, count(*) AS n FROM ({sql_boxes('40')}) GROUP BY 1")
def bbox_validate_counts(spark, sf):
    return boxes(spark, sf, 40.0).groupBy(F.coalesce(g.normalized_error(F.col("box")), F.lit("valid")).alias("error_code")).agg(F.count("*").alias("n"))


@query(f"SELECT {KEYS}, round(x1 * 1920, 6) AS px1, round(y1 * 1080, 6) AS py1, round(x2 * 1920, 6) AS px2, round(y2 * 1080, 6) AS py2, round(x1 * 1920 / 1920, 9) AS bx1, round(y2 * 1080 / 1080, 9) AS by2 FROM ({sql_boxes('40')}) WHERE {SQL_ERROR} IS NULL")
def bbox_pixel_roundtrip(spark, sf):
    w, h = F.lit(1920), F.lit(1080)
    rows = boxes(spark, sf, 40.0).withColumn("p", g.normalized_to_pixel(F.col("box"), w, h)).where("p is not null").withColumn("b", g.pixel_to_normalized(F.col("p"), w, h))
    return rows.select(*IDS, *(tidy(F.col("p")[c], 6).alias(f"p{c}") for c in g.CORNERS), tidy(F.col("b.x1")).alias("bx1"), tidy(F.col("b.y2")).alias("by2"))


@query(f"""WITH p AS (SELECT {KEYS}, greatest(0e0, least(640e0, x1 * 3000 - 60)) / 640e0 AS x1, greatest(0e0, least(360e0, y1 * 3000 - 60)) / 360e0 AS y1, greatest(0e0, least(640e0, x2 * 3000 - 60)) / 640e0 AS x2, greatest(0e0, least(360e0, y2 * 3000 - 60)) / 360e0 AS y2 FROM ({sql_boxes('40')}))
SELECT {KEYS}, {SQL_ERROR} IS NULL AS ok, CASE WHEN {SQL_ERROR} IS NULL THEN round(x1, 9) END AS x1, CASE WHEN {SQL_ERROR} IS NULL THEN round(y2, 9) END AS y2 FROM p""")
def bbox_clamp_normalize(spark, sf):
    w, h = F.lit(640), F.lit(360)
    b = F.col("box")
    pixels = g.box(*(b[c] * 3000 - 60 for c in g.CORNERS))
    rows = boxes(spark, sf, 40.0).withColumn("n", g.pixel_to_normalized(g.clamped(pixels, w, h), w, h))
    return rows.select(*IDS, F.col("n").isNotNull().alias("ok"), tidy(F.col("n.x1")).alias("x1"), tidy(F.col("n.y2")).alias("y2"))


def pairs(spark, sf):
    """Pairs of boxes of one order, each pair once; an order has a handful of lines."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("r")
    a = boxes(spark, sf, 100.0, "l_returnflag").select("l_orderkey", row, F.col("box").alias("a"), "l_returnflag")
    b = boxes(spark, sf, 100.0).select("l_orderkey", row.alias("r2"), F.col("box").alias("b"))
    return a.join(b, "l_orderkey").where("r < r2").withColumn("iou", g.iou(F.col("a"), F.col("b")))


SQL_PAIRS = f"""WITH b AS ({sql_boxes('100', ', l_returnflag')}), p AS (SELECT a.l_orderkey, a.l_returnflag, a.l_linenumber AS n1, a.l_partkey AS p1, b.l_linenumber AS n2, b.l_partkey AS p2,
 greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t
 FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber, a.l_partkey, a.l_suppkey) < (b.l_linenumber, b.l_partkey, b.l_suppkey)), q AS (SELECT *, i / (s + t - i) AS iou FROM p)"""


@query(SQL_PAIRS + " SELECT l_orderkey, n1, p1, n2, p2, round(iou, 9) AS iou, iou >= 0.5e0 AS accurate FROM q")
def box_iou_acc50(spark, sf):
    return pairs(spark, sf).select("l_orderkey", F.col("r.l_linenumber").alias("n1"), F.col("r.l_partkey").alias("p1"), F.col("r2.l_linenumber").alias("n2"), F.col("r2.l_partkey").alias("p2"), tidy(F.col("iou")).alias("iou"), g.accurate(F.col("a"), F.col("b")).alias("accurate"))


@query(SQL_PAIRS + " SELECT l_returnflag, count(*) AS n, round(count(*) FILTER (iou >= 0.5e0) / count(*)::DOUBLE, 9) AS acc50 FROM q GROUP BY 1")
def acc50_rate_by_flag(spark, sf):
    return pairs(spark, sf).groupBy("l_returnflag").agg(F.count("*").alias("n"), tidy(stats.rate(F.count_if(g.accurate(F.col("a"), F.col("b"))), F.count("*"))).alias("acc50"))


@query(f"""SELECT l_returnflag, count(*) AS n, count(*) FILTER ({SQL_ERROR} IS NULL) AS n_valid, count(*) FILTER ((x2 - x1) * (y2 - y1) > 0.5) AS n_large, count(*) FILTER (l_linenumber > 1) AS n_multi,
 round(avg((x2 - x1) * (y2 - y1)), 9) AS area_mean, round(max((x2 - x1) * (y2 - y1)), 9) AS area_max, round(count(*) FILTER (l_linenumber > 1) / count(*)::DOUBLE, 9) AS multi_rate FROM ({sql_boxes('40', ', l_returnflag')}) GROUP BY 1""")
def box_area_summary(spark, sf):
    rows = boxes(spark, sf, 40.0, "l_returnflag").withColumn("n_candidates", F.col("l_linenumber")).withColumn("fallback", F.lit(False))
    return stats.box_summary(rows, ["l_returnflag"]).select("l_returnflag", "n", "n_valid", "n_large", "n_multi", *(tidy(F.col(c)).alias(c) for c in ("area_mean", "area_max", "multi_rate")))


def sql_rank(keys: str, value: str, source: str) -> str:
    at = lambda f: f"list_sort(list({value}))[CAST(round_even((count({value}) - 1) * {f}::DOUBLE, 0) AS BIGINT) + 1]"
    return f"SELECT {keys}, {at('0.5')} AS p50, {at('0.95')} AS p95 FROM {source} GROUP BY {keys}"


@query(sql_rank("l_returnflag", "l_extendedprice", "lineitem"))
def nearest_rank_p50_p95(spark, sf):
    return stats.nearest_rank(table(spark, sf, "lineitem"), "l_extendedprice", {"p50": 0.5, "p95": 0.95}, ["l_returnflag"])


@query(f"SELECT r.*, m.n, m.mean_value, m.total_seconds FROM ({sql_rank('event_type', 'value', 'events')}) r JOIN (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(sum(value) / 1000, 6) AS total_seconds FROM events GROUP BY 1) m USING (event_type)")
def latency_style_summary(spark, sf):
    events = table(spark, sf, "events")
    ranks = stats.nearest_rank(events, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])
    sums = events.groupBy("event_type").agg(F.count("*").alias("n"), tidy(stats.mean(F.col("value")), 6).alias("mean_value"), tidy(F.sum("value") / 1000.0, 6).alias("total_seconds"))
    return ranks.join(sums, "event_type")


#: Orders as references, customers as images (those of nation 7 are missing), line items as annotations of an order.
def refs(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("numbers"))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ids = F.transform(F.array_distinct("numbers"), lambda n: F.col("o_orderkey") * 100 + n)
    return orders.select(F.col("o_orderkey").alias("ref_pos"), F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("image_id"), ids.alias("ann_ids"), F.lit(1).alias("n_sentences"), (F.col("o_orderpriority") == "5-LOW").alias("no_target"), F.element_at(F.create_map(F.lit("F"), F.lit("train"), F.lit("O"), F.lit("testA"), F.lit("P"), F.lit("val")), F.col("o_orderstatus")).alias("source_split"), "o_orderpriority")


def resolved(spark, sf):
    pictures = table(spark, sf, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("image_id"), F.concat(F.lit("images\\"), F.col("c_name"), F.lit(".jpg")).alias("file_name"), F.lit(400).alias("width"), F.lit(300).alias("height"))
    number = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    boxes_ = table(spark, sf, "lineitem").groupBy(number.alias("ann_id")).agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    boxes_ = boxes_.select("ann_id", (F.col("p") % 300).cast("double").alias("x"), (F.col("p") % 200).cast("double").alias("y"), (F.col("q") * 2).alias("w"), (F.col("q") * 2.5).alias("h"))
    return annotations.resolve_refs(refs(spark, sf), pictures, boxes_)


SQL_RESOLVED = """WITH ann AS (SELECT l_orderkey * 100 + l_linenumber AS ann_id, l_orderkey, (min(l_partkey) % 300)::DOUBLE AS x, (min(l_partkey) % 200)::DOUBLE AS y, max(l_quantity) * 2e0 AS w, max(l_quantity) * 2.5e0 AS h FROM lineitem GROUP BY l_orderkey, l_linenumber),
u AS (SELECT l_orderkey, count(*) AS targets, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ann GROUP BY l_orderkey),
r AS (SELECT o.*, c.c_name, u.*, CASE WHEN o_orderpriority = '5-LOW' THEN 'no_target' WHEN c_custkey IS NULL THEN 'missing_image' WHEN u.l_orderkey IS NULL THEN 'missing_annotation'
 WHEN NOT (x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 400 + 1e-6 AND y + h <= 300 + 1e-6) THEN 'invalid_bbox' END AS reason
 FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) c ON o_custkey = c_custkey LEFT JOIN u ON o_orderkey = u.l_orderkey)"""
SQL_SPLIT = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'P' THEN 'validation' ELSE 'holdout' END"


@query("SELECT l_orderkey AS order_key, round(min(l_discount + 0e0), 9) + 0e0 AS x, round(min(l_tax + 0e0), 9) + 0e0 AS y, round(max(l_discount + 0e0 + l_quantity) - min(l_discount + 0e0), 9) AS w, round(max(l_tax + 0e0 + l_quantity * 0.5e0) - min(l_tax + 0e0), 9) AS h, count(*) AS target_count FROM lineitem GROUP BY 1")
def union_bbox_per_order(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key"), (F.col("l_discount") + 0.0).alias("x0"), (F.col("l_tax") + 0.0).alias("y0"), F.col("l_quantity").alias("w0"), (F.col("l_quantity") * 0.5).alias("h0"))
    found = lines.groupBy("order_key").agg(*g.union_xywh(*map(F.col, ("x0", "y0", "w0", "h0"))), F.count("*").alias("target_count"))
    return found.select("order_key", *(tidy(F.col(c)).alias(c) for c in "xywh"), "target_count")


@query(SQL_RESOLVED + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def refs_images_lookup(spark, sf):
    return resolved(spark, sf).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(SQL_RESOLVED + """ SELECT 'orders:' || o_orderkey AS query_id, 'cust:' || o_custkey AS image_key, targets AS target_count, o_orderpriority AS query, 'data/images/' || c_name || '.jpg' AS image_relpath,
 round(x, 9) AS x, round(w, 9) AS w, round(x / 400, 9) AS nx1, round((y + h) / 300, 9) AS ny2 FROM r WHERE reason IS NULL""")
def manifest_build(spark, sf):
    said = refs(spark, sf).select("ref_pos", F.col("ref_id").alias("sent_id"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")).alias("sent"), F.lit("raw").alias("raw"))
    rows = annotations.manifest(resolved(spark, sf).drop("o_orderpriority"), said, "orders", "cust", "data/")
    px, nb = F.col("bbox_xywh_pixels"), F.col("bbox_xyxy_normalized")
    return rows.select("query_id", "image_key", F.col("target_count").cast("long").alias("target_count"), "query", "image_relpath", tidy(px[0]).alias("x"), tidy(px[2]).alias("w"), tidy(nb[0]).alias("nx1"), tidy(nb[3]).alias("ny2"))


@query(SQL_RESOLVED + " SELECT count(*) AS reference_count, count(*) FILTER (reason IS NULL) AS expression_count, count(*) FILTER (reason = 'no_target') AS excluded_no_target_count, count(*) FILTER (reason = 'missing_image') AS missing_image_count, count(*) FILTER (reason = 'missing_annotation') AS missing_annotation_count, count(*) FILTER (reason = 'invalid_bbox') AS invalid_bbox_count FROM r")
def dataset_summary(spark, sf):
    return annotations.dataset_summary(resolved(spark, sf))


NAMES = "train TRAIN val Validation test testB holdout minival F O P".split()


@query("SELECT s AS source_split, CASE WHEN lower(s) LIKE 'test%' OR lower(s) = 'holdout' THEN 'holdout' WHEN lower(s) IN ('val', 'validation') THEN 'validation' WHEN lower(s) = 'train' THEN 'train' ELSE 'holdout' END AS split, n FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES[:8]) + "]) AS s, 1 AS n UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1)")
def canonical_split_map(spark, sf):
    names = spark.createDataFrame([(n, 1) for n in NAMES[:8]], "source_split string, n long")
    own = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("source_split")).agg(F.count("*").alias("n"))
    return names.union(own).select("source_split", t.canonical_split(F.col("source_split")).alias("split"), "n")


def split_orders(spark, sf):
    name = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "P", "val").otherwise("testA")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("cust:"), F.col("o_custkey")).alias("image_key"), name.alias("source_split"))


SQL_RANK = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END"
SQL_ASSIGNED = f"SELECT o_orderkey, 'cust:' || o_custkey AS image_key, (['train', 'validation', 'holdout'])[max({SQL_RANK}) OVER (PARTITION BY o_custkey)] AS split FROM orders"


@query(SQL_ASSIGNED)
def image_isolated_split(spark, sf):
    return splits.isolated(split_orders(spark, sf)).select("o_orderkey", "image_key", "split")


@query(f"WITH a AS ({SQL_ASSIGNED}) SELECT s.split, count(a.split) AS record_count, count(DISTINCT image_key) AS image_count, 0::BIGINT AS overlap_count FROM (SELECT unnest(['train', 'validation', 'holdout']) AS split) s LEFT JOIN a USING (split) GROUP BY 1")
def split_summary_overlap(spark, sf):
    assigned = splits.isolated(split_orders(spark, sf))
    return splits.summary(assigned).join(F.broadcast(splits.overlap(assigned)), how="cross")


@query(f"""WITH rows AS (SELECT 'orders' AS dataset, o_custkey, {SQL_RANK} AS r FROM orders UNION ALL SELECT 'lines', o_custkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT dataset, (['train', 'validation', 'holdout'])[max(r) OVER (PARTITION BY o_custkey)] AS split, (['train', 'validation', 'holdout'])[max(r) OVER (PARTITION BY dataset, o_custkey)] AS own FROM rows) SELECT dataset, split, own, count(*) AS n FROM a GROUP BY ALL""")
def cross_dataset_split(spark, sf):
    orders = split_orders(spark, sf)
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "image_key"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    rows = orders.select(F.lit("orders").alias("dataset"), "image_key", "source_split").unionByName(lines.select(F.lit("lines").alias("dataset"), "image_key", name.alias("source_split")))
    core = splits.isolated(rows)
    own = splits.isolated(core.withColumn("both", F.struct("dataset", "image_key")).withColumnRenamed("split", "core"), "both")
    return own.groupBy("dataset", F.col("core").alias("split"), F.col("split").alias("own")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, source, row_number() OVER (ORDER BY doc_id)::INTEGER AS preview FROM f WHERE k = 1 ORDER BY doc_id LIMIT 3")
def preview_first_n_distinct(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "source")
    return annotations.first_distinct(rows, "source", "doc_id", 3)


@query(r"SELECT lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1)) AS suffix, count(*) AS n FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY 1")
def suffix_counts(spark, sf):
    return table(spark, sf, "pages").groupBy(t.suffix(F.regexp_replace("url", "[?#].*$", "")).alias("suffix")).agg(F.count("*").alias("n"))


ODD_IDS = ("000001_001", "000001_001\n", "٠٠٠٠٠١_٠٠١", "q1", "")


@query("SELECT id, regexp_matches(id, '\\A\\p{Nd}{6}_\\p{Nd}{3}\\z') AS ok, count(*) AS n FROM (SELECT lpad(conv_id::VARCHAR, 6, '0') || '_' || lpad(turn::VARCHAR, 3, '0') AS id FROM conversations UNION ALL SELECT unnest(['000001_001', '000001_001' || chr(10), '٠٠٠٠٠١_٠٠١', 'q1', ''])) GROUP BY ALL")
def id_pattern_flags(spark, sf):
    ids = table(spark, sf, "conversations").select(F.concat(F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit("_"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("id"))
    return ids.union(spark.createDataFrame([(i,) for i in ODD_IDS], "id string")).groupBy("id").agg(F.first(t.is_query_id(F.col("id"))).alias("ok"), F.count("*").alias("n"))


@query("""SELECT key, regexp_matches(s, '[\\x{3400}-\\x{9fff}]') AS cjk, contains(translate(lower(s), 'ſ', 's'), 'solis') AS word, trim(s, chr(9) || chr(10) || chr(13) || chr(160) || ' ') = '' AS blank
 FROM (SELECT 'doc' || doc_id AS key, text AS s FROM documents UNION ALL SELECT * FROM (VALUES ('a', '物体'), ('b', 'ひらがな'), ('c', chr(160) || ' '), ('d', 'typhloſolis'), ('e', 'x')))""")
def text_risk_flags(spark, sf):
    odd = spark.createDataFrame([("a", "物体"), ("b", "ひらがな"), ("c", "\xa0 "), ("d", "typhloſolis"), ("e", "x")], "key string, s string")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("key"), F.col("text").alias("s")).union(odd)
    return rows.select("key", t.has_cjk(F.col("s")).alias("cjk"), t.mentions(F.col("s"), "solis").alias("word"), t.is_blank(F.col("s")).alias("blank"))


@query("""SELECT conv_id, turn, q AS query FROM (SELECT conv_id, turn, trim(coalesce(nullif(CASE WHEN role = 'user' THEN text WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN '  ' END, ''), text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS q FROM conversations) WHERE q <> ''""")
def query_text_coalesce(spark, sf):
    sent = F.when(F.col("role") == "user", F.col("text")).when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "  ")
    return table(spark, sf, "conversations").select("conv_id", "turn", t.query_text(sent, F.col("text")).alias("query")).where("query <> ''")


@query("SELECT event_type, count(*) FILTER (json_exists(props, '$.k')) AS has_k, count(*) FILTER (NOT json_exists(props, '$.z')) AS lacks_z, count(*) AS n FROM events GROUP BY 1")
def required_fields_check(spark, sf):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    lacks = lambda k: F.size(F.array_except(F.array(F.lit(k)), keys)) > 0
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(~lacks("k")).alias("has_k"), F.count_if(lacks("z")).alias("lacks_z"), F.count("*").alias("n"))


@query("""SELECT page_id, CASE WHEN p LIKE '/%' THEN 'absolute' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent' WHEN regexp_matches(string_split(p, '/')[1], '^[A-Za-z]:$') THEN 'drive' END AS error,
 CASE WHEN NOT (p LIKE '/%' OR list_contains(string_split(p, '/'), '..') OR regexp_matches(string_split(p, '/')[1], '^[A-Za-z]:$')) THEN list_aggregate(list_transform(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), lambda x: regexp_replace(regexp_replace(x, '[<>:"|?*]', '_', 'g'), '[ .]+$', '')), 'string_agg', '/') END AS safe
 FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN '/' || url WHEN 2 THEN 'a/../' || url ELSE 'C:/' || url END AS p FROM pages)""")
def safe_path_rules(spark, sf):
    k = F.col("page_id") % 4
    p = F.when(k == 0, F.regexp_replace("url", "^https?://", "")).when(k == 1, F.concat(F.lit("/"), "url")).when(k == 2, F.concat(F.lit("a/../"), "url")).otherwise(F.concat(F.lit("C:/"), "url"))
    return table(spark, sf, "pages").select("page_id", t.path_error(p).alias("error"), t.safe_path(p).alias("safe"))


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def path_listing_missing(spark, sf):
    files = table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return annotations.with_existence(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "source"), files, "path", "found").where("not found").select(F.col("path").alias("doc_id"), "source")


@query("SELECT source, count(*) AS remaining FROM documents ANTI JOIN labels USING (doc_id) GROUP BY 1")
def checkpoint_anti_join(spark, sf):
    from ..operators import runs

    todo = runs.remaining(table(spark, sf, "documents").withColumnRenamed("doc_id", "query_id"), table(spark, sf, "labels").withColumnRenamed("doc_id", "query_id"))
    return todo.groupBy("source").agg(F.count("*").alias("remaining"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS lines FROM events GROUP BY 1")
def resume_merge_dedup_last(spark, sf):
    events = table(spark, sf, "events")
    last = annotations.last_by_key(events.select("user_id", "event_id", "event_type"), "user_id", "event_id")
    return last.join(events.groupBy("user_id").agg(F.count("*").alias("lines")), "user_id")


@query("SELECT doc_id AS query_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id + 5 FROM labels) UNION ALL SELECT k, 'extra' FROM (SELECT doc_id + 5 AS k FROM labels EXCEPT SELECT doc_id FROM documents)")
def submission_id_diff(spark, sf):
    return submission.id_difference(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id")), table(spark, sf, "labels").select((F.col("doc_id") + 5).alias("query_id")))


@query("SELECT doc_id AS query_id, source, quality * 0.25e0 AS x1, 0.5e0 + toxic * 0.25e0 AS x2 FROM documents JOIN labels USING (doc_id)")
def submission_merge(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    both = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "source")
    found = labels.select(F.col("doc_id").alias("query_id"), g.box(F.col("quality") * 0.25, F.lit(0.0), 0.5 + F.col("toxic") * 0.25, F.lit(1.0)).alias("box"))
    return submission.build(both, found).select("query_id", "source", F.col("bbox")[0].alias("x1"), F.col("bbox")[2].alias("x2"))


@query("SELECT vec_id, label, embedding[1]::DOUBLE AS x1, embedding[4]::DOUBLE AS y2, CASE WHEN label % 2 = 0 THEN 'only' ELSE '' END AS name, 16::BIGINT AS n FROM embeddings")
def candidate_first_select(spark, sf):
    e = F.col("embedding")
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice(e, i * 4 + 1, 4), lambda v: v.cast("double")))
    names = F.when(F.col("label") % 2 == 0, F.array(F.lit("only"))).otherwise(F.array().cast("array<string>"))
    found = table(spark, sf, "embeddings").withColumn("c", outputs.candidates(raw, names))
    first = F.get(F.col("c"), F.lit(0))
    return found.select("vec_id", "label", first["pixel_bbox"][0].alias("x1"), first["pixel_bbox"][3].alias("y2"), first["label"].alias("name"), F.size("c").cast("long").alias("n"))


@query(f"""WITH p AS (SELECT {KEYS}, x1, y1, least(x2, 1e0) AS x2, least(y2, 1e0) AS y2, l_linenumber % 3 AS k FROM ({sql_boxes('40')}))
SELECT {KEYS}, k = 0 AS fallback_used, CASE k WHEN 0 THEN 'no_candidates' END AS error, CASE k WHEN 0 THEN 0.25e0 ELSE round(x1, 9) END AS x1, CASE k WHEN 0 THEN 0.75e0 ELSE round(x2, 9) END AS x2 FROM p""")
def fallback_center(spark, sf):
    b = F.col("box")
    pixels = F.array(b["x1"] * 100, b["y1"] * 100, b["x2"] * 100, b["y2"] * 100)
    none = F.array().cast("array<array<double>>")
    rows = boxes(spark, sf, 40.0).withColumn("boxes", F.when(F.col("l_linenumber") % 3 == 0, none).otherwise(F.array(pixels))).drop("box")
    found = outputs.predictions(rows.withColumn("labels", F.array(F.lit("x"))).withColumn("width", F.lit(100)).withColumn("height", F.lit(100)), "center")
    return found.select(*IDS, "fallback_used", "error", tidy(F.col("box.x1")).alias("x1"), tidy(F.col("box.x2")).alias("x2"))


@query("SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def content_sha256(spark, sf):
    from ..operators import integrity

    return table(spark, sf, "documents").select("doc_id", integrity.content_sha256(F.col("text")).alias("sha256"))


@query("SELECT upper(sha256(string_agg(path || chr(0) || size || chr(0) || sha || chr(10), '' ORDER BY parts))) AS artifact_sha256, count(*) AS file_count FROM (SELECT url || '/' || page_id AS path, string_split(url || '/' || page_id, '/') AS parts, strlen(html) AS size, upper(sha256(html)) AS sha FROM pages)")
def manifest_digest_fold(spark, sf):
    from ..operators import integrity

    return integrity.folder_digest(table(spark, sf, "pages").select(F.concat_ws("/", "url", "page_id").alias("path"), F.octet_length("html").alias("size"), F.col("html").alias("content")))


@query("SELECT upper(sha256(text)) AS target, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_targets(spark, sf):
    from ..operators import integrity

    return table(spark, sf, "documents").groupBy(integrity.content_sha256(F.col("text")).alias("target")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT count(*) AS record_count, count(DISTINCT l_orderkey) AS visible_count, count(DISTINCT l_partkey) AS infrared_count, count(DISTINCT l_suppkey) AS depth_count, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)) AS group_count FROM lineitem")
def group_triple_distinct(spark, sf):
    d = F.count_distinct
    return table(spark, sf, "lineitem").agg(F.count("*").alias("record_count"), d("l_orderkey").alias("visible_count"), d("l_partkey").alias("infrared_count"), d("l_suppkey").alias("depth_count"), d("l_orderkey", "l_partkey", "l_suppkey").alias("group_count"))


@query("SELECT concat_ws('|', p_brand, p_type, p_size) AS format_key, count(*) AS n FROM part GROUP BY 1")
def format_key_counts(spark, sf):
    return table(spark, sf, "part").groupBy(t.format_key(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("format_key")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, NOT coalesce(CASE WHEN p_partkey % 3 = 2 THEN (f = 'PNG' AND d = 'uint16' AND c = 1) OR (f = 'JPEG' AND d = 'uint8' AND c = 3) ELSE d = 'uint8' AND c = 3 END, false) OR coalesce(p_size % 7 = 0, false) AS anomalous
 FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'PNG' ELSE 'JPEG' END AS f, CASE WHEN p_size % 3 = 0 THEN 'uint16' ELSE 'uint8' END AS d, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 3 END AS c FROM part)""")
def anomaly_rule(spark, sf):
    s = F.col("p_size")
    modality = F.element_at(F.array(F.lit("visible"), F.lit("infrared"), F.lit("depth")), (F.col("p_partkey") % 3 + 1).cast("int"))
    top = F.when(s % 7 == 0, 0).otherwise(9)
    bad = images.anomalous(modality, F.when(s % 2 == 0, "PNG").otherwise("JPEG"), F.when(s % 3 == 0, "uint16").otherwise("uint8"), F.when(s % 5 == 0, 1).otherwise(3), top, F.lit(0))
    return table(spark, sf, "part").select("p_partkey", bad.alias("anomalous"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def jsonl_roundtrip(spark, sf):
    from ..operators.runs import shared_path
    from ..sources import sinks

    path = shared_path(spark, "jsonl")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    sinks.jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)
