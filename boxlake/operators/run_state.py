"""What a run's log says in aggregate, stored in pieces that add up: a resumed run reads only the lines that are new.

A piece covers named files of the log and holds four small tables: counts and maxima, exact partial sums, values counted on
a fixed grid (for ranks), and the last sound line of each id. None depends on the order of lines or on how the log was cut,
so pieces give, bit for bit, what one reading of the whole log gives. A piece counts once its list of files is there, which
is written last; files that changed since make the whole state void, and it is made anew.
"""

from __future__ import annotations

import json
import math
import shutil
import uuid
from functools import reduce
from pathlib import Path
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import geometry as g
from ..sources import readers
from . import runs

#: Cells an octave of the grid of values; what keeps the cells of positive values above 0; cells of what is not finite.
GRID, ABOVE, ENDLESS, NAN = 64, 70_000, 1_000_000, 1_000_001
#: Parts that a cell is cut into, again and again, until a part holds one value.
FINER = 4096
_TABLES = {
    "facts": "kind string, name string, n long, v double",
    "sums": "name string, k int, part decimal(38,0), n long, odd double",
    "values": "name string, cell int, value double, n long",
    "ids": "query_id string, sound boolean, line_no struct<file_modification_time:timestamp,file_name:string,file_block_start:long,col4:long>, box struct<x1:double,y1:double,x2:double,y2:double>, fallback_used boolean, error string",
}


class Parts(NamedTuple):
    facts: DataFrame
    sums: DataFrame
    values: DataFrame
    ids: DataFrame


def cell(v: Column) -> Column:
    """The cell of a double on a grid that no data decide: it grows with the value, 64 cells an octave, 0 alone in one."""
    size = F.abs(v)
    level = F.floor(F.log2(F.when((size > 0) & (size != float("inf")), size)) * GRID).cast("int") + ABOVE
    side = F.when(v < 0, -1).otherwise(1)
    return F.when(F.isnan(v), NAN).when(size == float("inf"), side * ENDLESS).when(size == 0, 0).otherwise(side * level)


def measured(parsed: DataFrame) -> DataFrame:
    """The columns of runs.parsed_lines() that parts() counts."""
    area = F.when(F.col("prediction_ok"), g.area(F.col("box")))
    return parsed.select("line_no", "query_id", "box", "prediction_ok", "invalid", "error", "latency_ms", F.coalesce("source_suffix", F.lit("")).alias("source_suffix"), F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), area.alias("area"), F.coalesce(F.size("candidates"), F.lit(0)).alias("candidates"))


def parts(rows: DataFrame) -> Parts:
    """The four tables of rows of measured()."""
    sound = rows.where("prediction_ok")
    values = {"candidate_count": F.col("candidates").cast("double"), "bbox_area": F.col("area"), "latency_ms": F.col("latency_ms")}
    counted = {"fallback_count": F.col("fallback_used"), "multi_candidate_count": F.col("candidates") > 1, "bbox_area_over_50_count": F.col("area") > 0.5}
    fact = lambda kind, name, n, v: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), n.cast("long").alias("n"), v.cast("double").alias("v"))
    none, ok = F.lit(None), F.col("prediction_ok")
    counts = [fact("count", n, F.count_if(ok & c), none) for n, c in counted.items()] + [fact("count", "invalid_checkpoint_lines", F.count_if("invalid"), none)]
    most = [fact("max", n, F.lit(0), F.max(F.when(ok, values[n]))) for n in ("candidate_count", "bbox_area")]
    facts = rows.agg(F.array(*counts, *most).alias("all")).select(F.inline("all"))
    suffixes = sound.groupBy("source_suffix").agg(F.count("*").alias("n")).select(F.lit("suffix").alias("kind"), F.col("source_suffix").alias("name"), "n", F.lit(None).cast("double").alias("v"))
    each = sound.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in values.items())))).where("value is not null")
    spread = each.groupBy("name", "value").agg(F.count("*").alias("n")).select("name", cell(F.col("value")).alias("cell"), "value", "n")
    last = F.max_by(F.when(F.col("prediction_ok"), F.struct("line_no", "box", "fallback_used", "error")), F.when(F.col("prediction_ok"), F.col("line_no")))
    ids = rows.where("query_id is not null").groupBy("query_id").agg(F.bool_or("prediction_ok").alias("sound"), last.alias("r")).select("query_id", "sound", "r.*")
    return Parts(facts.unionByName(suffixes), exact.partial_sums(sound, values, []), spread, ids)


def store(parsed: DataFrame, path: str) -> Parts:
    """parts() of parsed, written below path. The lines are parsed once; they come from files that stay, so a part that is lost is parsed again."""
    rows = measured(parsed).persist(StorageLevel.DISK_ONLY)
    try:
        made = parts(rows)
        made.values.sortWithinPartitions("name", "cell").write.mode("overwrite").parquet(f"{path}/values")
        for name in ("facts", "sums", "ids"):
            getattr(made, name).write.mode("overwrite").parquet(f"{path}/{name}")
    finally:
        rows.unpersist()
    return opened(parsed.sparkSession, [path])


def opened(spark: SparkSession, paths: list[str]) -> Parts:
    """The tables of all pieces at paths, added up where a name or an id is in several."""
    if not paths:
        return Parts(*(spark.createDataFrame([], ddl) for ddl in _TABLES.values()))
    found = [reduce(DataFrame.unionByName, (spark.read.parquet(f"{p}/{name}") for p in paths)) for name in _TABLES]
    facts, sums, values, ids = found
    if len(paths) > 1:
        facts = facts.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
        sums = exact.merged(sums, [])
        last = F.max_by(F.struct("line_no", "box", "fallback_used", "error"), "line_no")
        ids = ids.groupBy("query_id").agg(F.bool_or("sound").alias("sound"), last.alias("r")).select("query_id", "sound", "r.*")
    return Parts(facts, sums, values, ids)


def _at(rows: DataFrame, lo: float, hi: float, rest: int) -> float:
    """The value at place rest of rows(value, n) between lo and hi: the span is cut into parts, of which one is cut again.

    What comes to the driver is a row a part. The ends fall in different parts, so each round is over fewer values.
    """
    while lo != hi:
        share = (F.col("value") - lo) / F.lit(hi - lo)
        sub = F.least(F.floor(share * FINER), F.lit(FINER - 1).cast("long")).alias("sub")
        for r in rows.where(F.col("value").between(lo, hi)).groupBy(sub).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("sub").collect():
            if rest < r.n:
                lo, hi = r.lo, r.hi
                break
            rest -= r.n
    return lo


def nearest_ranks(values: DataFrame, fractions: dict[str, float]) -> dict[str, dict[str, float]]:
    """For each name of values(name, cell, value, n) the value at index half_even((n - 1) * fraction) of its sorted values.

    The driver gets a row a cell in use, of which the grid bounds the number, and reads the one cell that holds the place.
    """
    cells: dict[str, list] = {}
    for r in values.groupBy("name", "cell").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("name", "cell").collect():
        cells.setdefault(r["name"], []).append(r)
    out: dict[str, dict[str, float]] = {}
    for name, own in cells.items():
        total = sum(r.n for r in own)
        for p, fraction in fractions.items():
            rest = round((total - 1) * fraction)
            for r in own:
                if rest < r.n:
                    break
                rest -= r.n
            at = math.nan if r.cell == NAN else _at(values.where((F.col("name") == name) & (F.col("cell") == r.cell)), r.lo, r.hi, rest)
            out.setdefault(name, {})[p] = at
    return out


def metrics(found: Parts) -> dict:
    """Counts, maxima, means, ranks and suffixes of a log; ids that a log has twice count twice but in valid_bbox_count."""
    rows = found.facts.collect()  # a row a count and suffix
    out: dict = {r["name"]: r.n for r in rows if r.kind == "count"}
    out = {n: out.get(n, 0) for n in ("fallback_count", "multi_candidate_count", "bbox_area_over_50_count", "invalid_checkpoint_lines")}
    most = {r["name"]: r.v for r in rows if r.kind == "max"}
    out |= {"valid_bbox_count": found.ids.where("sound").count(), "candidate_count_max": int(most.get("candidate_count") or 0), "bbox_area_max": most.get("bbox_area") or 0.0}
    sums = {r["name"]: r for r in exact.totals(found.sums, []).collect()}
    ranks = nearest_ranks(found.values, {"p50": 0.5, "p95": 0.95})
    for n in ("candidate_count", "bbox_area", "latency_ms"):
        out[f"{n}_mean"] = sums[n]["mean"] if n in sums else 0.0
        out |= {f"{n}_{p}": ranks.get(n, {}).get(p, 0.0) for p in ("p50", "p95")}
    out |= {f"candidate_count_{p}": int(out[f"candidate_count_{p}"]) for p in ("p50", "p95")}
    out["inference_latency_seconds_total"] = sums["latency_ms"]["total"] / 1000 if "latency_ms" in sums else 0.0
    return out | {"source_suffix_counts": {r["name"]: r.n for r in rows if r.kind == "suffix"}}


class RunState:
    """The pieces of a log, below folder. Both are in a folder that driver and tasks share."""

    def __init__(self, spark: SparkSession, folder: str, log: str) -> None:
        self.spark, self.folder, self.log = spark, Path(folder), Path(log)

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def _files(self) -> dict[str, list[int]]:
        """Size and time of each file of the log, by its path."""
        files = [self.log] if self.log.is_file() else [p for p in self.log.iterdir() if p.name[0] not in "._"] if self.log.exists() else []
        return {str(p): [s.st_size, s.st_mtime_ns] for p in files if (s := p.stat())}

    def _pieces(self) -> dict[str, dict[str, list[int]]]:
        return {str(p.parent): json.loads(p.read_text()) for p in sorted(self.folder.glob("piece-*/files.json"))}

    def cover(self) -> list[str]:
        """Adds a piece for the files that no piece covers yet; returns them."""
        there, covered = self._files(), {}
        for files in self._pieces().values():
            covered |= files
        if any(there.get(name) != stat for name, stat in covered.items()):
            self.clear()
            covered = {}
        new = sorted(set(there) - set(covered))
        if new:
            piece = self.folder / f"piece-{uuid.uuid4().hex}"
            store(runs.parsed_lines(readers.lines(self.spark, new)), str(piece))
            draft = piece / "files.json.part"
            draft.write_text(json.dumps({name: there[name] for name in new}))
            draft.replace(piece / "files.json")
        return new

    def parts(self) -> Parts:
        return opened(self.spark, list(self._pieces()))
