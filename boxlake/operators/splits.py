"""Splits without leaks: all rows of a key go to its most held-out split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

SPLITS = ("train", "validation", "holdout")


def isolated(rows: DataFrame, key: str = "image_key", source_split: str = "source_split") -> DataFrame:
    """rows with column split: the highest of train < validation < holdout that any row of the key has.

    The key's rank is aggregated before it meets the rows, so one key with very many rows is no single task's work: the
    hash as a second join key deals both sides anew, and Spark can split what is skewed.
    """
    own = t.canonical_split(F.col(source_split))
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), own)
    h = F.xxhash64(key)
    best = rows.groupBy(F.col(key).alias("_key")).agg(F.max(rank).alias("_rank")).withColumn("_h", F.xxhash64("_key"))
    joined = rows.withColumn("_h2", h).join(best, (F.col("_h2") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn("split", F.element_at(F.array(*map(F.lit, SPLITS)), F.col("_rank").cast("int"))).drop("_h", "_h2", "_key", "_rank")


def summary(assigned: DataFrame, key: str = "image_key") -> DataFrame:
    """split, record_count and image_count, a row for each of the three splits."""
    counts = assigned.groupBy("split").agg(F.count("*").alias("record_count"), F.count_distinct(key).alias("image_count"))
    every = assigned.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(counts, "split", "left").na.fill(0, ["record_count", "image_count"])


def overlap(assigned: DataFrame, key: str = "image_key") -> DataFrame:
    """One row: keys that are in more than one split."""
    return assigned.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("overlap_count"))
