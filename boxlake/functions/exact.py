"""Sums and means of doubles that do not depend on the order of rows: exact, rounded once at the end.

A double is a few whole multiples of powers 2 ** (32 k). Those multiples are added as integers, for each k on its own, in
any order and over any parts; the few sums of a key are put together as one whole number and rounded to the nearest
double. So a mean is the exact mean's numerator, correctly rounded, over the count, as a careful serial sum would give it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a place, and the least exponent that a double has: places below it are cut there.
WIDTH, LEAST = 32, -1074
_PLACE = "struct<k:int,part:decimal(38,0)>"


def _unit(k: Column) -> Column:
    return F.pow(F.lit(2.0), F.greatest(k * WIDTH, F.lit(LEAST)).cast("double"))


def places(v: Column) -> Column:
    """Array of (k, part) whose sum of part * 2 ** max(32 k, LEAST) is v exactly; empty for nulls, infinities and NaN.

    The first place may be one too high or low where the logarithm is rounded: then its part is 0 or up to 2 ** 33.
    """
    v = v.cast("double")
    size = F.abs(v)
    fine = v.isNotNull() & ~F.isnan(v) & (size != float("inf")) & (size != 0.0)
    top = F.floor(F.log2(F.when(fine, size).otherwise(1.0)) / WIDTH).cast("int")
    rest, out = F.when(fine, size).otherwise(0.0), []
    sign = F.when(v < 0, -1).otherwise(1)
    for step in range(3):
        k = top - step
        # Both are exact: a power of two only moves the point, and what is taken off are v's highest bits.
        part = F.floor(rest / _unit(k))
        rest = rest - part * _unit(k)
        out.append(F.struct(k.alias("k"), (sign * part).cast("decimal(38,0)").alias("part")))
    return F.when(fine, F.filter(F.array(*out), lambda p: p["part"] != 0)).otherwise(F.lit(None).cast(f"array<{_PLACE}>"))


def rounded(found: list[tuple[int, int]]) -> float:
    """The double nearest to the sum of part * 2 ** max(32 k, LEAST), ties to even; beyond the largest, infinity."""
    whole = sum(int(part) << (max(k * WIDTH, LEAST) - LEAST) for k, part in found)
    try:
        return float(Fraction(whole, 1 << -LEAST))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def partial_sums(rows: DataFrame, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, name, k, part, n, odd): what can be stored, and added up again with more of the same; see merged() and totals().

    A row a key, name and place. Counts of values stand at place null, with odd, the sum of those that are infinite or NaN.
    """
    every = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in values.items()))))
    known = every.where("v is not null")
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    counts = known.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.sum(F.when(odd, F.col("v"))).alias("odd"))
    parts = known.select(*keys, "name", F.inline(places(F.col("v")))).groupBy(*keys, "name", "k").agg(F.sum("part").cast("decimal(38,0)").alias("part"))
    return parts.withColumn("n", F.lit(0).cast("long")).withColumn("odd", F.lit(None).cast("double")).unionByName(
        counts.select(*keys, "name", F.lit(None).cast("int").alias("k"), F.lit(None).cast("decimal(38,0)").alias("part"), "n", "odd")
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of partial_sums(), of any number of calls, added up."""
    return parts.groupBy(*keys, "name", "k").agg(F.sum("part").cast("decimal(38,0)").alias("part"), F.sum("n").alias("n"), F.sum("odd").alias("odd"))


def totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, n, total, mean) of rows of partial_sums(): the sum rounded once, and it over n (both 0 where there is nothing)."""
    whole = merged(parts, keys).groupBy(*keys, "name").agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.collect_list(F.when(F.col("part").isNotNull(), F.struct("k", "part"))).alias("places"))
    schema = whole.drop("odd", "places").schema.add("total", "double").add("mean", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [rounded([(p["k"], p["part"]) for p in places]) if odd is None else odd for odd, places in zip(batch.column("odd").to_pylist(), batch.column("places").to_pylist(), strict=True)]
            counts = batch.column("n").to_pylist()
            kept = {c: batch.column(c) for c in (*keys, "name", "n")}
            yield pa.RecordBatch.from_pydict(kept | {"total": pa.array(sums, pa.float64()), "mean": pa.array([s / n if n else 0.0 for s, n in zip(sums, counts, strict=True)], pa.float64())})

    return whole.mapInArrow(work, schema)  # a row a key and name, with a few places each


def means(rows: DataFrame, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, <name>_mean, <name>_total, ...) of rows: exact, one row a key; nulls are left out, a key without values has 0."""
    found = totals(partial_sums(rows, values, keys), keys)
    of = lambda n, c: F.coalesce(F.max(F.when(F.col("name") == n, F.col(c))), F.lit(0.0)).alias(f"{n}_{c}")
    return found.groupBy(*keys).agg(*(of(n, c) for n in values for c in ("mean", "total")))
