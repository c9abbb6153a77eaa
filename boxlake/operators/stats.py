"""Aggregates of a run: exact nearest-rank percentiles, means and rates with defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def mean(v: Column) -> Column:
    return F.coalesce(F.avg(v), F.lit(0.0))


def _with(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the further columns of more, which has one row a key; null keys meet."""
    own = more.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in more.columns if c not in keys))
    if not keys:
        return rows.crossJoin(own)  # one row
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(own, same).drop(*(f"_k{i}" for i in range(len(keys))))


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], keys: list[str], cells: int = 1024) -> DataFrame:
    """One row a key with the value at index half_even((n - 1) * fraction) of its sorted values, for each name in fractions.

    The values of a key are never in one place: equal ones are counted first, and the others dealt to cells of equal width
    between the key's least and largest value. A running count over cells, of which a key has at most `cells` + 1, and one
    over the distinct values of each cell find the index. Nulls are left out; a key of nulls only gives none.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    span = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count("*").alias("_all"))
    counts = _with(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), span, keys)
    share = F.try_divide(F.col(value).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    # Infinities and NaN leave no width to share out: such a key has one cell.
    counts = counts.withColumn("_cell", F.coalesce(F.floor(F.nanvl(share, F.lit(0.0)) * cells), F.lit(0).cast("long")))
    held = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*keys, "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = _with(counts, held, [*keys, "_cell"])
    own = F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    upto = upto.withColumn("_upto", F.col("_before") + own)
    at = lambda f: F.bround((F.col("_all") - 1) * F.lit(f), 0).cast("long") + 1
    return upto.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") >= at(f), F.col(value))).alias(n) for n, f in fractions.items()))


def box_summary(df: DataFrame, keys: list[str], box: str = "box", candidates: str = "n_candidates", fallback: str = "fallback") -> DataFrame:
    """Counts, means and rates of predicted boxes for each key, in one pass; see nearest_rank() for percentiles."""
    size = g.area(F.col(box))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(g.normalized_error(F.col(box)).isNull()).alias("n_valid"),
        F.count_if(F.col(fallback)).alias("n_fallback"),
        F.count_if(size > 0.5).alias("n_large"),
        F.count_if(F.col(candidates) > 1).alias("n_multi"),
        mean(size).alias("area_mean"),
        F.coalesce(F.max(size), F.lit(0.0)).alias("area_max"),
        mean(F.col(candidates)).alias("candidates_mean"),
        F.coalesce(F.max(candidates), F.lit(0)).alias("candidates_max"),
        rate(F.count_if(size > 0.5), F.count("*")).alias("large_rate"),
        rate(F.count_if(F.col(candidates) > 1), F.count("*")).alias("multi_rate"),
        rate(F.count_if(F.col(fallback)), F.count("*")).alias("fallback_rate"),
    )
