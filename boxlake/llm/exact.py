"""Exact duplicates by content-defined chunk recipes.

A rolling hash cuts each normalised text into chunks. A chunk's identifier is its hash, verified: of chunks with one
hash and different bytes, each gets an ordinal as well. A text's recipe is the ordered list of its identifiers; texts
are equal exactly when their recipes are. Chunks move once each (copies meet before the shuffle); texts never do.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, documents, join_keyed, keep_rows, map_batches, stored

#: Sizes of chunks in bytes: least, about the mean of what follows (a power of two), most.
CHUNK = (128, 512, 4096)
HASH_BITS = 64
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


def cuts(data: bytes, sizes: tuple[int, int, int] = CHUNK) -> list[int]:
    """Ends of the chunks of data; where they lie depends on the 16 bytes before a cut and on the last cut only."""
    least, mean, most = sizes
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for p in (np.flatnonzero((h >> np.uint32(8)) & np.uint32(mean - 1) == 0) + 1).tolist():
        while p - last > most:
            last += most
            ends.append(last)
        if p - last >= least:
            last = p
            ends.append(p)
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes, sizes: tuple[int, int, int], bits: int) -> list[tuple[int, bytes]]:
    shift, last, out = 64 - bits, 0, []
    for end in cuts(data, sizes):
        piece = data[last:end]
        out.append(((xxhash.xxh64_intdigest(piece) >> shift) - (1 << 63 if bits == 64 else 0), piece))
        last = end
    return out


def recipes(docs: DataFrame, sizes: tuple[int, int, int] = CHUNK, bits: int = HASH_BITS) -> DataFrame:
    def make():
        def work(batch):
            texts = [t.lower() for t in as_bytes(batch, "text")]
            return {"doc_id": batch.column("doc_id"), "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "recipe": [[h for h, _ in chunks(t, sizes, bits)] for t in texts]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, text_sha256 string, recipe array<long>", make)


def distinct_chunks(docs: DataFrame, sizes: tuple[int, int, int] = CHUNK, bits: int = HASH_BITS) -> DataFrame:
    """(id, content), each once."""

    def make():
        def work(batch):
            found = list({c for t in as_bytes(batch, "text") for c in chunks(t.lower(), sizes, bits)})
            return {"id": [h for h, _ in found], "content": [c for _, c in found]}

        return work

    return map_batches(docs.select("text"), "id long, content binary", make).distinct()


def chunk_rows(docs: DataFrame, sizes: tuple[int, int, int], bits: int) -> DataFrame:
    """(text_sha256, pos, id, content): every chunk of every distinct text in its place."""

    def make():
        def work(batch):
            rows = [(hashlib.sha256(t).hexdigest(), n, h, c) for t in {t.lower() for t in as_bytes(batch, "text")} for n, (h, c) in enumerate(chunks(t, sizes, bits))]
            return dict(zip(("text_sha256", "pos", "id", "content"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], []), strict=True))

        return work

    return map_batches(docs.select("text"), "text_sha256 string, pos int, id long, content binary", make)


def verified_recipes(docs: DataFrame, sizes: tuple[int, int, int] = CHUNK, bits: int = HASH_BITS) -> DataFrame:
    """recipes() with ordinals (array of (pos, ordinal)) for those chunks whose hash has more than one content."""
    made = stored(recipes(docs, sizes, bits), "recipes")
    shared = stored(distinct_chunks(docs, sizes, bits).groupBy("id").count().where("count > 1").select("id"), "shared-ids")
    none = F.array().cast("array<struct<pos:int,ordinal:int>>")
    if shared.isEmpty():
        return made.withColumn("ordinals", none)
    rows = join_keyed(chunk_rows(docs, sizes, bits), shared, "id", F.xxhash64("text_sha256"))
    contents = rows.select("id", "content").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("id").orderBy("content")))
    rows = rows.join(contents, ["id", "content"]).select("text_sha256", F.struct("pos", "ordinal").alias("o")).distinct()
    fixes = rows.groupBy("text_sha256").agg(F.array_sort(F.collect_list("o")).alias("ordinals"))
    return stored(made.join(fixes, "text_sha256", "left").withColumn("ordinals", F.coalesce("ordinals", none)).select("doc_id", "text_sha256", "recipe", "ordinals"), "verified")


def exact_duplicates(docs: DataFrame, sizes: tuple[int, int, int] = CHUNK, bits: int = HASH_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    doc_id stays; a null doc_id is smaller than any other. Rows that repeat that doc_id as well are all marked kept:
    they are one document given twice. Other columns of docs are ignored; an empty table gives an empty result. A very
    long text is many chunks: it is read whole once, by one task, and what moves of it are chunks of at most 4 KB.
    """
    rows = verified_recipes(docs, sizes, bits)
    groups = rows.groupBy("recipe", "ordinals").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # The hash as a further key deals both sides anew, so that Spark can split the rows of a text with very many copies.
    key = F.xxhash64("recipe", "ordinals")
    found = rows.withColumn("k", key).join(groups.withColumn("k", key), ["k", "recipe", "ordinals"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_duplicates() keeps; of rows that agree in doc_id and text, one.

    No two equal texts are left: a doc_id that names several texts is judged a text at a time, rows without a doc_id like
    any other. Null texts count as empty. All columns of docs come back as they are; an empty table stays one.
    """
    return keep_rows(docs, exact_duplicates(docs).where("kept").select("doc_id", "text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; edge cases as at exact_duplicates()."""
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
