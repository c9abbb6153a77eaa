"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check, components.

A fingerprint is embedded as the bit counts of its 2-bit segments. Counts are kept in unary, so the Manhattan distance
of two embeddings is the bit count of their xor; it never exceeds the Hamming distance. A range probe in all 32
dimensions at once would visit some 200,000 neighbour cells, so the grid is laid over projections: the segments
are split into blocks, and there is a cell for each choice of `blocks - limit` of them. Within distance `limit` at most
`limit` blocks differ, so every linked pair shares a cell of some choice, and no neighbour need be probed. Members of a
cell are put in the order of their total counts; each is compared with those whose total is at most `limit` less, first
by Manhattan distance, then bit by bit.

More blocks mean more rows a fingerprint and fewer pairs: their number goes by that of the fingerprints (blocks_for),
which changes the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, join_keyed, map_batches, stored
from .components import components

SHINGLE, LIMIT, SEED = 4, 4, 42
#: 2-bit segments of a fingerprint; numbers of blocks to choose from; pairs a fingerprint that blocks_for allows, about.
SEGMENTS, BLOCKS, PAIRS = 32, (8, 10, 12, 16), 1_000
#: Rows that a task makes cells of.
CELL_ROWS = 2_000_000
#: Fingerprints of a cell that are compared in one piece; larger cells are compared as pairs of pieces.
PIECE = 4096
#: Shingles whose bits are counted at once.
STEP = 16_384
EDGES = "u long, v long, hot long"


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """A hash of each shingle of the lower-cased words, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle)) if text.strip() else 0


def majority(hashes: list[int]) -> int:
    """The bits set in over half of hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = np.array(hashes[i : i + STEP], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def make():
        def work(batch):
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch, "text")], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", make)


def embedding(fp: Column) -> Column:
    """Per 2-bit segment the bit count, in unary: 00, 01 or 11."""
    low, high = F.lit(0x5555555555555555), F.lit(-0x5555555555555556)
    return ((fp.bitwiseOR(F.shiftrightunsigned(fp, 1))).bitwiseAND(low)).bitwiseOR((fp.bitwiseAND(F.shiftleft(fp, 1))).bitwiseAND(high))


def blocks_for(fingerprints: int, limit: int = LIMIT) -> int:
    """The least number of blocks at which a fingerprint meets up to PAIRS others in its cells, were all bits independent.

    Two segments agree in 3 of 8 cases. At 8 blocks (70 cells of 16 segments) a fingerprint meets 1 in 100,000 others, at
    12 (495 cells of 21) 1 in 2.5 million: 10,000 and 400 of a billion.
    """
    meets = lambda b: comb(b, limit) * (3 / 8) ** (SEGMENTS * (b - limit) / b)
    return next((b for b in BLOCKS if b > limit and fingerprints * meets(b) <= PAIRS), BLOCKS[-1])


def cells(fps: DataFrame, limit: int, blocks: int) -> DataFrame:
    """(cell, fp): every fingerprint in each of its C(blocks, limit) grid cells."""
    bounds, keys = [SEGMENTS * i // blocks for i in range(blocks + 1)], []
    for n, chosen in enumerate(combinations(range(blocks), blocks - limit)):
        mask = sum(((1 << 2 * (bounds[b + 1] - bounds[b])) - 1) << 2 * bounds[b] for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(n), F.col("e").bitwiseAND(F.lit(mask).cast("long"))))
    return fps.select("fp", embedding(F.col("fp")).alias("e")).select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _unary(x: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(0x5555555555555555)
    return ((x | (x >> one)) & low) | ((x & (x << one)) & ~low)


def links(x: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that joins members of x within limit bits: at most len(x) - 1 links, not all pairs."""
    total = np.bitwise_count(x.view(np.uint64)).astype(np.int16)
    order = np.argsort(total, kind="stable")
    x, total = x[order], total[order]
    bits = x.view(np.uint64)
    unary, root, out = _unary(bits), np.arange(len(x)), []
    from_ = np.searchsorted(total, total - limit)  # totals differ by the Manhattan distance at most
    for i in range(1, len(x)):
        a = int(from_[i])
        near = a + np.flatnonzero(np.bitwise_count(unary[a:i] ^ unary[i]) <= limit)  # Manhattan distance, a lower bound
        near = near[np.bitwise_count(bits[near] ^ bits[i]) <= limit]
        while len(near):
            j = int(near[0])
            out.append((int(x[i]), int(x[j])))
            old = root[j]
            near = near[root[near] != old]
            root[: i + 1][root[: i + 1] == old] = root[i]
    return out


def _runs(piece: int, limit: int):
    """For mapInArrow over rows sorted by cell: links within each cell; of a cell of over piece rows only its key, as hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell = held = np.empty(0, np.int64)
        over: int | None = None

        def flush(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v, hot = [], [], []
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if n > piece:
                    u.append(None), v.append(None), hot.append(int(cell[a]))
                else:
                    for p, q in links(fp[a : a + n], limit):
                        u.append(p), v.append(q), hot.append(None)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, hot)], names=["u", "v", "hot"])

        for batch in batches:
            cell, fp = (batch.column(n).to_numpy() for n in ("cell", "fp"))
            if over is not None:  # the rest of a hot cell is not gathered
                rest = cell != over
                cell, fp = cell[rest], fp[rest]
            cell, fp = np.concatenate([held_cell, cell]), np.concatenate([held, fp])
            if not len(cell):
                continue
            last = int(np.searchsorted(cell, cell[-1]))
            yield flush(cell[:last], fp[:last])
            held_cell, held, over = cell[last:], fp[last:], None if len(cell) - last <= piece else int(cell[-1])
            if over is not None:
                yield flush(held_cell, held)
                held_cell = held = np.empty(0, np.int64)
        yield flush(held_cell, held)

    return run


def near_links(fps: DataFrame, limit: int = LIMIT, blocks: int | None = None, piece: int = PIECE) -> DataFrame:
    """Links (u, v) that connect exactly those of the distinct fingerprints fps(fp) that pairs within limit connect."""
    count = fps.count()
    blocks = blocks or blocks_for(count, limit)
    # A small table of fingerprints would come as a task or two, which then made all rows of the grid.
    keyed = cells(fps.repartition(max(1, -(-count * comb(blocks, limit) // CELL_ROWS))), limit, blocks)
    parted = keyed.repartition("cell").sortWithinPartitions("cell")
    found = stored(parted.mapInArrow(_runs(piece, limit), EDGES), "links", batch_rows=8192)
    edges, hot = found.where("hot is null").select("u", "v"), found.where("hot is not null").select(F.col("hot").alias("cell"))
    if hot.isEmpty():
        return edges
    # A hot cell is cut into parts by hash; every pair of parts is compared in a task of its own.
    size = stored(join_keyed(keyed, hot.distinct(), "cell", F.col("fp")).groupBy("cell").agg(F.ceil(F.count("*") * 2 / piece).cast("long").alias("parts")), "hot-cells")
    one = join_keyed(keyed, size, "cell", F.col("fp")).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")))
    pairs = one.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp").distinct()
    again = pairs.repartition("cell").sortWithinPartitions("cell").mapInArrow(_runs(1 << 40, limit), EDGES)
    return edges.union(stored(again, "hot-links", batch_rows=8192).select("u", "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT, blocks: int | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of every row of docs.

    Equal fingerprints count once, so copies in any number cost one row of the join. Null texts count as empty;
    a text without words has fingerprint 0 and links like any other. Rows with a null doc_id take part; if a component
    has no other, its component_id is null. Repeated rows each give their row. A bit set in just half of the shingles is
    0. Other columns of docs are ignored; an empty table gives an empty result. A text is read whole, by one task, with
    one hash a word at once.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    linked = components(near_links(nodes.select("fp"), limit, blocks, piece))
    linked = stored(linked.join(nodes, linked["node"] == nodes["fp"]).select("fp", "rep", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("h", F.xxhash64("root"))
    linked = linked.withColumn("h", F.xxhash64("root")).join(least, ["root", "h"]).select("fp", "component_id")
    label = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "labels")
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of whole documents; edge cases as at near_duplicates()."""
    from .common import documents

    return near_duplicates(documents(spark, sf_dir))
