"""Mixing sources to target weights: repetition rates from token sums, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, join_keyed, stored

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 20
#: Hex digits of the SHA-256 of seed, doc_id and text that make a draw; 52 bits are exact in a double.
DIGITS = 13
#: A key for every source, null included, that joins as text.
_KEY = "coalesce(concat('s', source), 'null')"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target of sizes(source, source_size), one row a source.

    Targets are min(most * size, level * weight) with the one level at which they sum to the sum of sizes; that is where
    capping and resharing by weight ends. A source is one row of a few dozen bytes, and all go through one task: a million
    sources, web domains for one, are some 50 MB there. Sources are put in the order of most * size / weight: going up, each is capped
    while the level of those left is above its ratio, and the level before each is largest at the first uncapped one.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = F.greatest(left, F.lit(0.0)) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return t.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _planned(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """row (all columns of docs), size, source_size, target and copies; whatever docs call their columns, nothing clashes."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*every).alias("row"), F.col("source"), F.expr(_KEY).alias("key"), size_of(F.col("text")).alias("size"))
    sized = docs.select("source", size_of(F.col("text")).alias("size"))
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = stored(source_targets(sums, weights, most).select(F.expr(_KEY).alias("key"), "source_size", "target"), "source-targets")
    rows = join_keyed(own.drop("source"), targets, "key", F.xxhash64("row.doc_id", "size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("row.text", F.lit("")))
    draw = F.conv(F.substring(F.sha2(said, 256), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return rows.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (long): floor(rate) and one more with probability rate - floor(rate).

    size counts words (null text: 0). The draw hashes seed, doc_id and text, so reruns agree; only rows that repeat both
    share it. A null doc_id draws like any value, a null text like an empty one. A source of size 0 has target 0 and no
    copies. Null is a source, the last. docs may have further columns; those named like a result give way to it. An empty
    table gives an empty result. Texts of any length are counted in place.
    """
    result = ("size", "source_size", "target", "copies")
    return _planned(docs, weights, most, seed).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in result), *result)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs, just as it is, as many times as its plan says."""
    plan = _planned(docs, weights, most, seed).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; edge cases as at mixing_plan()."""
    return mixing_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB.
ORACLE = rf"""
WITH d AS (SELECT doc_id, text, coalesce('s' || source, 'null') AS k, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
o AS (SELECT *, CAST({list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, {MOST} * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, greatest(sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER w, 0), 0) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM o WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
j AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {DIGITS}) AS BIGINT) AS DOUBLE) / CAST({16**DIGITS} AS DOUBLE) AS draw FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken FROM j
"""
