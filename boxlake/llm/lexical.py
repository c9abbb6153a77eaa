"""Ranked lexical search over an index of two levels: byte impacts for bounds, exact counts for scores.

Level 2 has a row a document: the terms that are asked for, and how often it has each. Level 1 has a row for some thousand documents:
for each term the places of the documents that have it and their impacts, rounded up to a byte. A byte bounds an impact
from both sides, so sums of weighted bytes bound a score from both sides. A document whose upper bound reaches the kth best
lower bound of an item is scored exactly, in integers, from level 2; no other can be among the item's k best.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, as_bytes, documents, join_keyed, map_batches, stored

#: Terms are runs of ASCII letters and digits and of all other characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Results of an item. Impacts are below IMPACTS and kept in steps of UNIT; places in a shard of SHARD documents take two bytes.
K, IMPACTS, UNIT, SHARD = 10, 1_000_000, 3922, 4096
#: Items are searched in blocks of about so many, with texts of about so many bytes together; an item is never cut.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 8 << 20


def terms_of(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text in order, only A-Z lowered."""
    return text.translate(_TERM_BYTES).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Index:
    """Both levels for the terms of a block, stored, with the weight of each term by its id."""

    counts: DataFrame  # row, doc_id, m, terms, tfs
    shards: DataFrame  # rows, terms, ends, places, impacts
    weights: dict[int, int]


def count_terms(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms (ids, ascending) and tfs of every row of docs, for the terms of ids only."""

    def make():
        known = ids.get

        def work(batch):
            n, terms, tfs = [], [], []
            for text in as_bytes(batch, "text"):
                words = terms_of(text)
                found = Counter(map(known, words))
                found.pop(None, None)
                n.append(len(words))
                terms.append(sorted(found))
                tfs.append([found[t] for t in terms[-1]])
            return {"doc_id": batch.column("doc_id"), "n": n, "terms": terms, "tfs": tfs}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n long, terms array<int>, tfs array<int>", make)


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _shards(counts: DataFrame) -> DataFrame:
    def make():
        def work(batch):
            if not batch.num_rows:
                return {n: [] for n in ("rows", "terms", "ends", "places", "impacts")}
            terms, tfs = batch.column("terms"), batch.column("tfs")
            size = np.asarray(terms.value_lengths())
            flat, tf = (np.asarray(c.flatten()) for c in (terms, tfs))
            places = np.repeat(np.arange(len(size)), size)
            g = impact(tf.astype(np.int64), np.asarray(batch.column("m"))[places])
            order = np.argsort(flat, kind="stable")
            own, starts = np.unique(flat[order], return_index=True)
            ends = np.append(starts[1:], len(flat)) if len(own) else starts
            data = {"rows": np.asarray(batch.column("row")), "terms": own.astype(np.int32), "ends": ends.astype(np.int64), "places": places[order].astype(np.uint16), "impacts": -(-g[order] // UNIT)}
            return {n: [v.astype(np.uint8).tobytes() if n == "impacts" else v.tobytes()] for n, v in data.items()}

        return work

    return map_batches(counts, "rows binary, terms binary, ends binary, places binary, impacts binary", make, SHARD)


def build_index(docs: DataFrame, ids: dict[bytes, int]) -> Index:
    """The index of all rows of docs for the terms of ids, which must fit into a task.

    N counts the documents with a term, any term; L is all of their terms. Weights of terms that no document has are absent.
    """
    counted = stored(count_terms(docs, ids).withColumn("row", F.monotonically_increasing_id()), "term-counts")
    total, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row a term of ids
    # In decimals, since the product may pass 64 bits; the quotient does not.
    m = F.expr(f"10 + ((CAST(n AS DECIMAL(19, 0)) * CAST({90 * total} AS DECIMAL(19, 0))) DIV {max(length, 1)})").cast("long")
    counts = counted.select("row", "doc_id", m.alias("m"), "terms", "tfs")
    return Index(counts, stored(_shards(counts), "impact-shards", batch_rows=SHARD), {r["term"]: weight(total, r["count"]) for r in frequent})


def _bounded(index: Index, items: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """(item, row, upper, lower): documents whose upper bound reaches the kth best lower bound that their task has seen."""
    weighted = [(i, [(t, index.weights[t]) for t in terms if index.weights.get(t)]) for i, terms in items]

    def make():
        best = {i: np.empty(0, np.int64) for i, _ in weighted}  # up to k lower bounds an item

        def work(batch):
            out: tuple[list, ...] = ([], [], [], [])
            for rows, terms, ends, places, impacts in zip(*(batch.column(n).to_pylist() for n in ("rows", "terms", "ends", "places", "impacts")), strict=True):
                rows, places, impacts = np.frombuffer(rows, np.int64), np.frombuffer(places, np.uint16), np.frombuffer(impacts, np.uint8).astype(np.int64)
                ends = np.frombuffer(ends, np.int64).tolist()
                spans = dict(zip(np.frombuffer(terms, np.int32).tolist(), zip([0, *ends], ends, strict=False), strict=True))
                for i, wanted in weighted:
                    sums, ones = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                    for t, w in wanted:
                        if span := spans.get(t):
                            at = places[slice(*span)]
                            sums[at] += w * impacts[slice(*span)]
                            ones[at] += w
                    hit = np.flatnonzero(sums)
                    upper, lower = sums[hit] * UNIT, (sums[hit] - ones[hit]) * UNIT
                    seen = np.concatenate([best[i], lower])
                    best[i] = seen = np.partition(seen, len(seen) - k)[len(seen) - k :] if len(seen) > k else seen
                    found = np.flatnonzero(upper >= seen.min()) if len(seen) == k else np.arange(len(hit))
                    for held, v in zip(out, (np.full(len(found), i), rows[hit[found]], upper[found], lower[found]), strict=True):
                        held.append(v)
            return dict(zip(("item", "row", "upper", "lower"), (np.concatenate(v) if v else np.empty(0, np.int64) for v in out), strict=True))

        return work

    return map_batches(index.shards, "item long, row long, upper long, lower long", make, 1)


def search(index: Index, items: list[tuple[int, list[int]]], k: int = K) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each of items (id, ids of its terms), with scores above 0.

    Equal scores are in the order of doc_id, a null one last. Each row of the documents is one of its own.
    """
    spark = index.counts.sparkSession
    near = stored(_bounded(index, items, k), "bounded")
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))).where(F.col("_n") <= k)
    least = stored(first.groupBy("item").agg(F.min("lower").alias("least"), F.count("*").alias("n")), "least-bounds")
    left = join_keyed(near, least, "item", F.col("row")).where((F.col("n") < k) | (F.col("upper") >= F.col("least")))
    wanted = stored(left.groupBy("row").agg(F.collect_list("item").alias("items")), "candidates")
    rows = join_keyed(index.counts, wanted, "row", F.col("row"))
    pairs = rows.select("row", "doc_id", "m", F.explode("items").alias("item"), "terms", "tfs").select("item", "row", "doc_id", "m", F.inline(F.arrays_zip("terms", "tfs")))
    asked = spark.createDataFrame([(i, t, index.weights[t]) for i, terms in items for t in terms if t in index.weights], "item long, term int, w long")
    keyed = pairs.withColumn("key", F.struct(F.col("item"), F.col("terms").alias("term")))
    scored = join_keyed(keyed, asked.select(F.struct("item", "term").alias("key"), "w"), "key", F.col("row"))
    gain = F.expr("w * ((1000000000L * CAST(tfs AS BIGINT)) DIV (1000L * CAST(tfs AS BIGINT) + 8L * m))")
    scores = scored.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(gain).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the k best rows of docs(doc_id, text) for each item of items(item_id, text).

    Items go in blocks, dealt by hash; a block's texts and terms pass through the driver, the documents never do. An item
    given several times counts once; texts that share an item_id are ranked apart. Null and empty texts have no terms: such
    a document is no result, such an item has none. Repeated documents are ranked each. Texts are read whole, whatever their length; further
    columns of either table are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    own = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // block_items), -(-size // block_bytes), 1)
    out = []
    for b in range(blocks):
        found = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        texts = [dict.fromkeys(terms_of(r["text"].encode())) for r in found]
        ids = {t: i for i, t in enumerate(dict.fromkeys(t for own_terms in texts for t in own_terms))}
        asked = [(i, [ids[t] for t in own_terms]) for i, own_terms in enumerate(texts)]
        if ids:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(found)], "item long, item_id " + dict(items.dtypes)["item_id"])
            out.append(join_keyed(search(build_index(docs, ids), asked, k), names, "item", F.col("doc_id")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    empty = items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return reduce(DataFrame.unionByName, out or [empty])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for each benchmark item; edge cases as at ranked()."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in DuckDB, every document scored.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
b AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
i AS (SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))) AS term FROM b),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) WHERE rank <= {K}
"""
