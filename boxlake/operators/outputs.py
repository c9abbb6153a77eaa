"""Model outputs: candidates from raw lists, first-candidate choice, clamping and explicit fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SettingsError
from ..functions import geometry as g

MODES, STRATEGIES = ("error", "center"), ("first",)


def check_options(mode: str, strategy: str = "first") -> None:
    if mode not in MODES:
        raise SettingsError(f"fallback mode must be one of {', '.join(MODES)}: {mode}")
    if strategy not in STRATEGIES:
        raise SettingsError(f"strategy must be one of {', '.join(STRATEGIES)}: {strategy}")


def candidates(boxes: Column, labels: Column) -> Column:
    """array<struct<pixel_bbox, label>> of array<array<double or string>> and labels, which may be shorter."""
    return F.transform(boxes, lambda b, i: F.struct(F.transform(b, lambda v: v.try_cast("double")).alias("pixel_bbox"), F.coalesce(F.get(labels, i), F.lit("")).alias("label")))


def output_error(boxes: Column) -> Column:
    """Why an output is refused as a whole, null if it is fine; one bad box spoils all."""
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) < 1, "no_candidates").when(F.exists(boxes, lambda b: F.coalesce(F.size(b), F.lit(0)) != 4), "not_four").when(F.exists(boxes, lambda b: F.exists(b, lambda v: v.try_cast("double").isNull())), "coordinate")


def predictions(rows: DataFrame, mode: str, strategy: str = "first") -> DataFrame:
    """rows(boxes, labels, width, height) with box, fallback_used and error of the chosen candidate.

    In mode center a refused output or box becomes the centre box, marked; in mode error it fails the job. A box that is
    refused after clamping keeps its candidates; an output that is refused has none.
    """
    check_options(mode, strategy)
    bad = output_error(F.col("boxes"))
    rows = rows.withColumn("_bad", bad).withColumn("candidates", F.when(F.col("_bad").isNull(), candidates(F.col("boxes"), F.col("labels"))).otherwise(F.array().cast("array<struct<pixel_bbox:array<double>,label:string>>")))
    w, h = F.col("width"), F.col("height")
    chosen = g.pixel_to_normalized(g.clamped(g.from_array(F.get(F.col("candidates"), F.lit(0))["pixel_bbox"]), w, h), w, h)
    rows = rows.withColumn("_box", chosen)
    error = F.coalesce("_bad", F.when(F.col("_box").isNull(), "box"))
    if mode == "error":
        return rows.withColumn("box", F.when(error.isNull(), F.col("_box")).otherwise(F.raise_error(F.concat(F.lit("no box: "), error)))).withColumn("fallback_used", F.lit(False)).withColumn("error", F.lit(None).cast("string")).drop("_bad", "_box")
    return rows.withColumn("error", error).withColumn("box", F.coalesce("_box", g.center_box())).withColumn("fallback_used", F.col("error").isNotNull()).drop("_bad", "_box")
