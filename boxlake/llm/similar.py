"""Near-duplicates of a Jaccard similarity of 0.8: candidates by SimHash and MinHash, an exact check, components.

Operator 1 finds texts whose fingerprints are a few bits apart; of 64 bits, texts of similarity 0.8 differ in 10 at the
mean, and a grid that reaches so far would meet much of the corpus. So its groups (of five-word fingerprints) are joined
by those of MinHash bands. Texts that share a SimHash component or a band form candidate groups. Each group's shingle
sets are then compared in full, so that neither way of finding candidates decides, and a pair is lost only if no chain
of candidates joins it. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, join_keyed, keep_rows, map_batches, stored, text_sha256, trim
from .components import components
from .simhash import LIMIT, majority, near_links, shingle_hashes

#: Words of a shingle; least Jaccard similarity, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Bands and rows of each: at similarity 0.8 all bands differ for one pair in 9,000, at 0.3 one pair in 46 shares a band.
BANDS, ROWS = 30, 6
#: Texts and shingles of a group that are compared in one piece; larger groups are compared as pairs of pieces.
PIECE, WEIGHT = 2048, 2_000_000
STEP = 2048
_random = np.random.default_rng(42)
FACTOR, SHIFT = (_random.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(odd) for odd in (1, 0))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), STEP):
        np.minimum(least, (short[i : i + STEP] * FACTOR + SHIFT).min(axis=1), out=least)
    data = least.tobytes()
    return [xxhash.xxh64_intdigest(data[4 * ROWS * k : 4 * ROWS * (k + 1)], k) - (1 << 63) for k in range(BANDS)]


def similar_links(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Places (i, j) of sets, such that the links join exactly the sets that pairs of Jaccard >= least join.

    A pair that joins two groups has an end outside the largest group, so only such sets are compared with all others.
    """
    n, (over, under) = len(sets), least
    size = np.fromiter(map(len, sets), np.int64, n)
    owner, hashes = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    root, todo, out = np.arange(n), np.ones(n, bool), []
    while True:
        left = np.flatnonzero(todo & (root != np.bincount(root).argmax()))
        if not len(left):
            return out
        i = int(left[0])
        todo[i] = False
        a, b = np.searchsorted(hashes, sets[i]), np.searchsorted(hashes, sets[i], "right")
        count = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=n)
        for j in np.flatnonzero(under * common >= over * (size + size[i] - common)).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]


def _compared(least: tuple[int, int]):
    """For mapInArrow over rows sorted by cell: links of the nodes within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []

        def flush() -> pa.RecordBatch:
            found = similar_links(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            values = batch.column("hashes")
            for n, (c, node) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                if c != cell:
                    yield flush()
                    cell, nodes, sets = c, [], []
                nodes.append(node)
                sets.append(values[n].values.to_numpy().view(np.uint64).copy())
        yield flush()
        cell, nodes, sets = None, [], []
        trim()

    return run


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_sha256 (of the text, A-Z lowered), node (hash of the set of shingles), n (its size), fp, bands.

    fp is the SimHash of the set: every shingle counts once, so that it depends on the node only.
    """

    def make():
        def work(batch):
            sets = [shingle_set(t, shingle) for t in as_bytes(batch, "text")]
            node = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            return {"doc_id": batch.column("doc_id"), "text_sha256": batch.column("text_sha256"), "node": node, "n": list(map(len, sets)), "fp": pa.array(fp), "bands": list(map(band_keys, sets))}

        return work

    return map_batches(docs, "doc_id long, text_sha256 string, node long, n long, fp long, bands array<long>", make, after=trim)


def candidate_cells(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, cell): nodes that share a cell are candidates; cells are MinHash bands and SimHash components."""
    bands = nodes.select("node", F.explode("bands").alias("cell"))
    linked = components(near_links(stored(nodes.select("fp").distinct(), "prints"), limit)).select(F.col("node").alias("fp"), "root")
    prints = nodes.select("node", "fp", F.xxhash64("fp").alias("h")).join(linked.withColumn("h", F.xxhash64("fp")), ["h", "fp"], "left")
    return bands.union(prints.select("node", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("cell")))


def links(nodes: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int], piece: int, weight: int) -> DataFrame:
    """Links (u, v) of nodes(node, n, fp, bands, text_sha256) whose sets reach least; texts(text, text_sha256) has each one's text."""
    cells = stored(candidate_cells(nodes), "candidate-cells").withColumn("h", F.xxhash64("cell"))
    first = cells.groupBy("cell").agg(F.min("node").alias("m"), F.count("*").alias("c")).where("c > 1").withColumn("h", F.xxhash64("cell"))
    star = cells.join(first, ["cell", "h"]).where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    groups = stored(components(star).join(nodes.select("node", "n", "text_sha256"), "node"), "candidates")
    # A large group is cut into parts by hash; every pair of parts is compared in a task of its own.
    parts = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") * 2 / piece), F.ceil(F.sum("n") * 2 / weight)).cast("long").alias("parts"), F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = parts.withColumn("parts", F.when((F.col("c") <= piece) & (F.col("s") <= weight), F.lit(1).cast("long")).otherwise(F.col("parts"))).select("root", "parts")
    h = F.xxhash64("root")
    keyed = groups.withColumn("h", h).join(parts.withColumn("h", h), ["root", "h"]).select("node", "root", "parts", "text_sha256")

    def make():
        def work(batch):
            sets = [shingle_set(t, shingle).view(np.int64) for t in as_bytes(batch, "text")]
            return {c: batch.column(c) for c in ("node", "root", "parts")} | {"hashes": sets}

        return work

    found = map_batches(join_keyed(texts, stored(keyed, "candidate-texts"), "text_sha256", F.xxhash64("text")).select("node", "root", "parts", "text"), "node long, root long, parts long, hashes array<long>", make, after=trim)
    own = found.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 or own <> other")
    pairs = pairs.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "hashes")
    return stored(pairs.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compared(least), "u long, v long"), "similar")


def similar(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST, piece: int = PIECE, weight: int = WEIGHT) -> DataFrame:
    """doc_id, text_sha256 and kept of every row of docs.

    Texts are joined if their sets of shingles have a Jaccard similarity of least or more; A-Z count as a-z. Of the texts
    that such pairs join, over any number of steps, the one with the least doc_id is kept (of equal ones that of the
    least hash); a null doc_id is larger than any other. Null texts count as empty, and texts without words as equal.
    Rows that repeat doc_id and text share their verdict; other columns are ignored; an empty table gives an empty result.
    Texts are read whole; a set has a hash a shingle, in one task. Nothing is collected.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text", text_sha256().alias("text_sha256"))
    made = stored(signatures(texts, shingle), "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    nodes = stored(made.groupBy("node").agg(F.min(rank).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("node", "n", "fp", "bands", "rep", F.col("rep.text_sha256").alias("text_sha256")), "nodes")
    linked = components(links(nodes, texts.select("text", "text_sha256"), shingle, least, piece, weight))
    label = nodes.select("node", "rep").join(linked, "node", "left").select("rep", F.coalesce("root", "node").alias("root"))
    best = label.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.text_sha256", F.lit(True).alias("kept"))
    best = stored(best, "best").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("t"), "kept")
    rows = made.select("doc_id", "text_sha256")
    return rows.join(best, (rows["text_sha256"] == best["t"]) & rows["doc_id"].eqNullSafe(best["d"]), "left").select("doc_id", "text_sha256", F.coalesce("kept", F.lit(False)).alias("kept"))


def drop_similar(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that similar() keeps; of rows that agree in doc_id and text, one.

    Null and empty texts are similar to each other. All columns of docs come back as they are; an empty table stays one.
    """
    return keep_rows(docs, similar(docs, **parameters).where("kept").select("doc_id", "text_sha256"))
