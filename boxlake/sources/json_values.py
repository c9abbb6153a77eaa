"""One JSON object or array, however large its file, read by many tasks.

Spark's text reader cuts the file at commas, wherever they stand, and deals its byte ranges to tasks. Whether a range starts
within a string, and how deep, depends on all before it; but what a range does to that is a small summary (its quotes, its
brackets and its commas by depth, for either start), and summaries compose. So one pass summarises every range, the
driver composes one row a range, and a second pass cuts each range into elements with the state and number it starts with.
An element that crosses ranges is put together from its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..operators.runs import shared_path

MARK = b"\xef\xbb\xbf"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
#: What a range does from either start (0: outside a string, 1: within one): the start of the next, the change of depth,
#: and by depth the commas there, with those one deeper after the last of them.
Effect = tuple[int, int, dict[int, tuple[int, int]]]


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(range, bytes) in order, with the comma that stands before each fragment; a range may come in several parts."""
    last = None
    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        a = 0
        for i in range(1, len(starts) + 1):
            if i == len(starts) or (files[i], starts[i]) != (files[a], starts[a]):
                key = files[a], starts[a]
                yield key, b"," * (key != last and key[1] > 0 or key == last) + b",".join(values[a:i])
                last, a = key, i


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of data without what a backslash escapes, and whether an odd number of quotes stands before each."""
    if b"\\" in data:  # only strings have backslashes, and none is cut off from what it escapes, since no comma is escaped
        data = _ESCAPED.sub(lambda m: b"_" * len(m[0]), data)
    codes = np.frombuffer(data, np.uint8)
    return codes, np.cumsum(codes == 34, dtype=np.int64) % 2


def _depths(codes: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Depth after each code, from 0."""
    step = ((codes == 123) | (codes == 91)).astype(np.int64) - ((codes == 125) | (codes == 93))
    return np.cumsum(step * outside)


def effect(data: bytes) -> list[Effect]:
    codes, odd = _marks(data)
    out = []
    for start in (0, 1):
        outside = odd == start
        depth = _depths(codes, outside)
        at = depth[(codes == 44) & outside]
        found = {}
        for d in {*np.unique(at).tolist(), *(np.unique(at) - 1).tolist()}:
            own = np.flatnonzero(at == d)
            found[d] = len(own), int((at[own[-1] + 1 if len(own) else 0 :] == d + 1).sum())
        out.append(((start + int(odd[-1] if len(odd) else 0)) % 2, int(depth[-1] if len(depth) else 0), found))
    return out


def compose(a: Effect, b: list[Effect]) -> Effect:
    """The effect of a and then of what b is from either start."""
    end, change, later = b[a[0]]
    found = {}
    for d in {*a[2], *(k + a[1] for k in later)}:
        (n, deeper), (m, after) = a[2].get(d, (0, 0)), later.get(d - a[1], (0, 0))
        found[d] = n + m, after if m else deeper + later.get(d + 1 - a[1], (0, 0))[0]
    return end, a[1] + change, found


NOTHING: list[Effect] = [(0, 0, {}), (1, 0, {})]


def _summaries(spark: SparkSession, path: str) -> list[tuple[str, int, list[Effect], bytes, bytes]]:
    """A row a range: its effects, and its first and last bytes that are no blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for key, data in _ranges(batches):
            held = found.setdefault(key, [NOTHING, b"", b""])
            more = effect(data)
            held[0] = [compose(e, more) for e in held[0]]
            held[1] = held[1] or data.strip()[:4]
            held[2] = data.strip()[-1:] or held[2]
        said = [json.dumps([(e, c, list(d.items())) for e, c, d in effects]) for effects, _, _ in found.values()]
        yield pa.RecordBatch.from_pydict({"file": pa.array([k[0] for k in found], pa.string()), "start": pa.array([k[1] for k in found], pa.int64()), "effects": pa.array(said, pa.string()), "first": pa.array([v[1] for v in found.values()], pa.binary()), "last": pa.array([v[2] for v in found.values()], pa.binary())})

    rows = _fragments(spark, path).mapInArrow(run, "file string, start long, effects string, first binary, last binary").collect()
    read = lambda s: [(e, c, {d: tuple(v) for d, v in found}) for e, c, found in json.loads(s)]
    return sorted((r["file"], r["start"], read(r["effects"]), bytes(r["first"]), bytes(r["last"])) for r in rows)


def _marked(spark: SparkSession, file: str) -> bool:
    """Whether a file begins with a byte order mark, which Spark's text reader takes off."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    source = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(max(source.read(), 0) for _ in MARK) == MARK
    finally:
        source.close()


def _starts(path: str, rows: list[tuple[str, int, list[Effect], bytes, bytes]], kind: str) -> dict[tuple[str, int], tuple[int, int, int, int, int]]:
    """For each range: within a string or not, depth, commas at depth 1 before it, those at depth 2 since, and 1 if it begins the file."""
    wrong = DatasetError(f"{path} is not a JSON {'object' if kind == '{' else 'array'}")
    out: dict[tuple[str, int], tuple[int, int, int, int, int]] = {}
    for file in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == file]
        first = next((r[3] for r in own if r[3]), b"")
        state: Effect = (0, 0, {})
        for _, start, effects, _, _ in own:
            out[file, start] = state[0], state[1], state[2].get(1, (0, 0))[0], state[2].get(1, (0, 0))[1], int(not state[2] and start == own[0][1])
            state = compose(state, effects)
        if first[:1] != kind.encode() or next((r[4] for r in reversed(own) if r[4]), b"") != (b"}" if kind == "{" else b"]") or state[:2] != (0, 0) or state[2].get(0, (0, 0))[0] or min(state[2], default=0) < 0:
            raise wrong
    if not out:
        raise wrong
    return out


def _cut(starts: dict[tuple[str, int], tuple[int, int, int, int, int]], level: int):
    """For mapInArrow: the elements at depth `level` of each range, the first and the last of them as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, state, first, out = None, [], None, True, []

        def give(last: bool) -> None:
            text = b"".join(held)
            if text.strip() or first or last:
                out.append((*key, *state[3:], bool(first or last), text))
            held.clear()

        def table() -> pa.RecordBatch:
            names = {"file": pa.string(), "start": pa.int64(), "member": pa.int64(), "pos": pa.int64(), "piece": pa.bool_(), "text": pa.binary()}
            made = pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(names.items())})
            out.clear()
            return made

        for now, data in _ranges(batches):
            if now != key:
                if key is not None:
                    give(True)
                inside, depth, ones, twos, _ = starts[now]
                within = depth >= level
                pos = (ones if level == 1 else twos) if within else -1
                key, first, state = now, True, [inside, depth, pos, ones if level > 1 else 0, pos]
            codes, odd = _marks(data)
            outside = odd == state[0]
            depth = state[1] + _depths(codes, outside)
            comma = (codes == 44) & outside
            opened, closed = ((codes == 123) | (codes == 91)) & outside & (depth == level), ((codes == 125) | (codes == 93)) & outside & (depth == level - 1)
            cut = (comma & (depth == level)) | opened | closed | (comma & (depth == level - 1) if level > 1 else False)
            a = 0
            for i in np.flatnonzero(cut).tolist():
                held.append(data[a:i])
                give(False)
                first, a = False, i + 1
                if opened[i]:
                    state[4] = 0
                elif closed[i]:
                    state[4] = -1
                elif depth[i] == level:
                    state[4] += 1
                else:
                    state[3], state[4] = state[3] + 1, -1
            held.append(data[a:])
            state[0], state[1] = (state[0] + int(odd[-1] if len(odd) else 0)) % 2, int(depth[-1] if len(depth) else state[1])
            if len(out) > 2000:
                yield table()
        if key is not None:
            give(True)
        yield table()

    return run


def elements(spark: SparkSession, path: str, kind: str, level: int = 1, mark: bool = True) -> DataFrame:
    """(file, member, pos, text) of the JSON value of each file at path, which must be an object ('{') or array ('[').

    level 1: its members or elements, by pos in the file's order. level 2: the elements of each of its members, by pos in
    member; what stands before them, the member's name, has pos -1. Positions count from 0 without gaps; the text of an
    element is as in the file, blanks included. A file of another kind, with unequal brackets, or with a byte order mark
    where mark is false, raises DatasetError. Elements are written once to the shared folder and read from there.
    """
    ranges = _summaries(spark, path)
    if not mark and any(_marked(spark, file) for file in {r[0] for r in ranges}):
        raise DatasetError(f"{path} begins with a byte order mark")
    starts = _starts(path, ranges, kind)
    folder = shared_path(spark, "json-elements")
    cut = _fragments(spark, path).mapInArrow(_cut(starts, level), "file string, start long, member long, pos long, piece boolean, text binary")
    cut.write.parquet(folder)
    rows = spark.read.schema(cut.schema).parquet(folder)
    whole = rows.where("not piece").select("file", "member", "pos", "text")
    # Two pieces a range at most; an element that crosses many ranges is as large as they are.
    pieces = rows.where("piece").groupBy("file", "member", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    joined = pieces.select("file", "member", "pos", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.text))").alias("text"))
    every = whole.union(joined).select("file", "member", "pos", F.decode("text", "UTF-8").alias("text"))
    return every.where(F.col("text").rlike(r"\S") & ((F.col("pos") >= 0) | F.lit(level > 1)))
