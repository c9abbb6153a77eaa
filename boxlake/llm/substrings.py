"""Repeated passages by compressed FM-indexes over shards of the corpus.

A window of `width` words belongs to its minimiser, the 4-word gram of least hash in it; equal windows have equal
minimisers. The windows of one minimiser position are the starts of one passage, so a text is cut into passages and
every window is in exactly one. Passages whose gram occurs once hold nothing that repeats and go no further. The others
are dealt to shards by gram, so that a text meets only the shards that can match it. A gram with very many passages is
dealt by longer keys: the gram with 16, 24, 28, 30, at last 31 of the words around it, which all windows of a part share.

A shard's index is a wavelet matrix over the Burrows-Wheeler transform of its distinct passages, with a bit a suffix for
passages that occur more than once; the text itself is not kept. Passages are streamed against it: backward search from
an end gives how far back the words still occur twice or more (the matching statistic of that end). The last end comes
first, so that a passage repeated as a whole costs one search; a search that breaks off rules out all windows over the
break; ends that are still open are then searched at once.
What matches over `width` words or more is reported as intervals of window starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, as_bytes, bucketed, documents, join_keyed, map_batches, stored

WIDTH, GRAM = 35, 4
#: Words of the passages that one index holds, about, and different passages of a key beyond which it is drawn longer.
SHARD_WORDS, CROWD = 250_000, 2_000
#: Grams are frequent from this part of all their occurrences on.
MOST = 20_000
MARKS = "key long, pid long, firsts array<int>, lasts array<int>"


def gram_hashes(words: list[bytes]) -> np.ndarray:
    """Hash (uint64) of each run of GRAM words."""
    w = np.fromiter(map(crc32, words), np.uint64, len(words))
    n = len(words) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(words: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash (int64), first and last window start of each passage of words."""
    n = len(words) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    h = gram_hashes(words)
    view = np.lib.stride_tricks.sliding_window_view(h, width - GRAM + 1)
    at = np.concatenate([view[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, n)) for i in range(0, n, 8192)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[first]].view(np.int64), first, np.r_[first[1:], n] - 1


class WaveletMatrix:
    """Rank over a sequence of integers below 2 ** levels: a packed bit vector and a count per 64 bits for each level."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.rows = levels, []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32)
            zeros = int(len(values) - bits.sum())
            self.rows.append((packed, before, zeros))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before at[i]; start is where the symbol's run begins in the last level's order."""
        for n, (packed, before, zeros) in enumerate(self.rows):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - n)) & 1, zeros + ones, at - ones)
        return at - start


def suffix_order(t: np.ndarray, size: int) -> np.ndarray:
    """Places of t (integers below size, no two suffixes equal) in the order of the suffixes, by doubling."""
    n, bits = len(t), max(1, int(size).bit_length())
    span = max(1, 62 // bits)  # symbols that fit a key of the first round
    rank = np.zeros(n, np.int64)
    for i in range(span):
        rank = (rank << bits) + np.r_[t[i:] + 1, np.zeros(min(i, n), np.int64)][:n]
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        rank = np.empty(n, np.int64)
        new = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(np.r_[0, new])
        if new.all():
            return order
        if span > 1 << 40:
            raise ValueError("suffixes are equal")
        key = rank * (n + 1) + np.r_[rank[span:] + 1, np.zeros(min(span, n), np.int64)][:n]
        # Only runs of equal ranks are put in order again.
        open_ = np.flatnonzero(np.r_[False, ~new] | np.r_[~new, False])
        part = order[open_]
        order[open_] = part[np.argsort(key[part], kind="stable")]
        rank, span = key, span * 2


class FMIndex:
    """Backward search over passages (lists of words); many says which of them occur more than once."""

    def __init__(self, passages: list[list[bytes]], many: list[bool]) -> None:
        k, self.ids = len(passages), {}
        ids = self.ids
        for p in passages:
            for w in p:
                ids.setdefault(w, len(ids) + k)
        size = k + len(ids)
        # Ends differ (0 to k - 1), so no two suffixes are equal.
        text = np.concatenate([np.r_[self.symbols(p), i] for i, p in enumerate(passages)])
        order = suffix_order(text, size)
        owner = np.repeat(np.arange(k), [len(p) + 1 for p in passages])
        self.n = len(text)
        self.many = np.packbits(np.array(many, bool)[owner[order]], bitorder="little")
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        self.matrix = WaveletMatrix(text[order - 1], max(1, int(size - 1).bit_length()))
        # Where the run of each symbol begins after the last level: the walk down from position 0.
        self.run = self.matrix.rank(np.arange(size), np.zeros(size, np.int64), np.zeros(size, np.int64))

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def matched_from(self, text: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each end (a place in text) the least start, not before its stop, from which text up to the end, itself
        included, occurs twice or more in what is indexed; end + 1 if not even the last word does."""
        reached = ends + 1
        alive, at, stop = np.arange(len(ends)), ends.copy(), stops
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        while len(alive):
            c, m = text[at], len(alive)
            both = self.matrix.rank(np.r_[c, c], np.r_[lo, hi], np.tile(self.run[c], 2))
            lo, hi = self.first[c] + both[:m], self.first[c] + both[m:]
            more = hi - lo > 1
            one = np.flatnonzero(hi - lo == 1)
            more[one] = (self.many[lo[one] >> 3] >> (lo[one] & 7)) & 1
            reached[alive[more]] = at[more]
            more &= at > stop
            alive, at, stop, lo, hi = alive[more], at[more] - 1, stop[more], lo[more], hi[more]
        return reached

    def intervals(self, passages: list[list[bytes]], width: int) -> list[list[tuple[int, int]]]:
        """Per passage the intervals (first, last) of the starts of its windows that occur twice or more, in order."""
        lengths = np.fromiter(map(len, passages), np.int64, len(passages))
        text = np.concatenate([self.symbols(p) for p in passages])
        base = np.cumsum(lengths) - lengths
        left, right = base.copy(), base + lengths - width  # windows yet to be decided, by start
        # From the last end as far back as it goes: settles passages that repeat as a whole.
        back = self.matched_from(text, right + width - 1, left)
        whole = np.flatnonzero(back <= right)
        who, first, last = [whole], [back[whole]], [right[whole]]
        right = np.minimum(right, back - 1)
        # The leftmost window: where its search breaks off, all windows that hold that word and the end are ruled out.
        rest = np.flatnonzero(left <= right)
        left[rest] = np.maximum(left[rest], self.matched_from(text, left[rest] + width - 1, left[rest]))
        # What is left is searched window by window.
        rest = rest[left[rest] <= right[rest]]
        count = right[rest] - left[rest] + 1
        owner = np.repeat(rest, count)
        start = np.repeat(left[rest] - np.cumsum(count) + count, count) + np.arange(count.sum())
        hit = self.matched_from(text, start + width - 1, start) <= start
        owner, start = owner[hit], start[hit]
        new = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])][: len(start)])
        who.append(owner[new]), first.append(start[new]), last.append(start[np.r_[new[1:], len(start)] - 1] if len(new) else start)
        found: list[list[tuple[int, int]]] = [[] for _ in passages]
        who = np.concatenate(who)
        for i, x, y in zip(who.tolist(), (np.concatenate(first) - base[who]).tolist(), (np.concatenate(last) - base[who]).tolist(), strict=True):
            found[i].append((x, y))
        return [sorted(x) for x in found]


def _pid(passage: bytes) -> int:
    return xxhash.xxh64_intdigest(passage, 5) - (1 << 63)


def _lists(parts: list[np.ndarray], kind: np.dtype, arrow: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind), arrow))


def _texts(docs: DataFrame, width: int) -> DataFrame:
    """Every row with its words (joined by one space), their number and digest, and the grams and starts of its passages."""

    def make():
        def work(batch):
            joined, n, sha, grams, starts = [], [], [], [], []
            for t in as_bytes(batch, "text"):
                words = t.split()
                gram, first, _ = anchors(words, width)
                joined.append(b" ".join(words)), n.append(len(words)), grams.append(gram), starts.append(first)
                sha.append(hashlib.sha256(joined[-1]).hexdigest())
            return {"doc_id": batch.column("doc_id"), "words": joined, "n_words": n, "sha": sha, "grams": _lists(grams, np.int64, pa.int64()), "starts": _lists(starts, np.int32, pa.int32())}

        return work

    made = map_batches(docs, "doc_id long, words binary, n_words long, sha string, grams array<long>, starts array<int>", make)
    return made.withColumn("rid", F.monotonically_increasing_id())  # fixed once the table is stored


def _shared_of(grams: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of grams(rid, gram) whose gram is in shared(gram, count). Grams with more than a MOST-th of all rows are fewer
    than MOST by their definition: they are broadcast, so that no task of the join gets all rows of one."""
    total = shared.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    heavy = F.broadcast(shared.where(F.col("count") > total // MOST).select("gram"))
    light = shared.where(F.col("count") <= total // MOST).select("gram")
    return grams.join(heavy, "gram").union(grams.join(heavy, "gram", "left_anti").join(light, "gram"))


def _pieces(open_: DataFrame, width: int) -> DataFrame:
    """Two kinds of rows. Places: (rid, at, key, pid) of each passage with a shared gram. Passages: (key, pid, passage, n)
    of what a batch holds, each different one once."""

    def make():
        def work(batch):
            rid, at, key, pid, seen = [], [], [], [], {}
            for r, joined, grams, starts, n, shared in zip(*(batch.column(c).to_pylist() for c in ("rid", "words", "grams", "starts", "n_words", "shared")), strict=True):
                wanted, windows = set(shared), n - width + 1
                lengths = np.fromiter(map(len, joined.split(b" ")), np.int64, n)
                ends = np.cumsum(lengths + 1) - 1
                begins = (ends - lengths).tolist()
                ends = ends.tolist()
                for g, a, b in zip(grams, starts, [*starts[1:], windows], strict=True):
                    if g in wanted:
                        passage = joined[begins[a] : ends[b + width - 2]]
                        p = _pid(passage)
                        rid.append(r), at.append(a), key.append(g), pid.append(p)
                        seen[g, passage] = seen.get((g, passage), 0) + 1
            rest, none = list(seen), [None] * len(seen)
            return {"rid": rid + none, "at": at + none, "key": key + [g for g, _ in rest], "pid": pid + [_pid(p) for _, p in rest], "passage": [None] * len(rid) + [p for _, p in rest], "n": [None] * len(rid) + list(seen.values())}

        return work

    return map_batches(open_, "rid long, at int, key long, pid long, passage binary, n long", make)


def _cut(crowded: DataFrame, size: int, width: int) -> DataFrame:
    """Passages of (key, pid, gp, passage, n) cut where the place of their gram in the window goes to another multiple of
    size. All windows of a part share width + 1 - size words, whose hash is its key. gp is the place of the gram in the
    passage (-1: not yet known); `at` is where the part begins in the passage it is cut from."""

    def make():
        def work(batch):
            rows = []
            for key, pid, gp, passage, n in zip(*(batch.column(c).to_pylist() for c in ("key", "pid", "gp", "passage", "n")), strict=True):
                words = passage.split(b" ")
                gp = int(gram_hashes(words[:width]).argmin()) if gp < 0 else gp
                windows, s = len(words) - width + 1, 0
                while s < windows:
                    part = (gp - s) // size
                    last = min(gp - part * size, windows - 1)
                    shared = words[gp - part * size : gp - part * size - size + 1 + width]
                    sub = b" ".join(words[s : last + width])
                    rows.append((key, pid, s, xxhash.xxh64_intdigest(b"%d %d " % (size, part) + b" ".join(shared), 8) - (1 << 63), _pid(sub), gp - s, sub, n))
                    s = last + 1
            return dict(zip(("key", "pid", "at", "sub_key", "sub_pid", "gp", "passage", "n"), map(list, zip(*rows, strict=True)) if rows else [[] for _ in range(8)], strict=True))

        return work

    return map_batches(crowded, "key long, pid long, at int, sub_key long, sub_pid long, gp int, passage binary, n long", make)


def _search(width: int, shard_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over passages sorted by key: intervals of repeated windows. A shard ends where a key does."""
    schema = pa.schema([("key", pa.int64()), ("pid", pa.int64()), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32()))])

    def search(shard: list[tuple[int, int, list[bytes], int]]) -> pa.RecordBatch:
        if len({x[:2] for x in shard}) < len(shard):
            raise ValueError("two different passages of one key have the same hash")
        passages = [words for _, _, words, _ in shard]
        found = FMIndex(passages, [n > 1 for *_, n in shard]).intervals(passages, width) if shard else []
        rows = [(k, p, [a for a, _ in x], [b for _, b in x]) for (k, p, _, _), x in zip(shard, found, strict=True) if x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches):
        shard, key, words = [], None, 0
        for batch in batches:
            for k, p, passage, n in zip(*(batch.column(c).to_pylist() for c in ("key", "pid", "passage", "n")), strict=True):
                if k != key and words >= shard_words:
                    yield search(shard)
                    shard, words = [], 0
                key = k
                shard.append((k, p, passage.split(b" "), n))
                words += len(shard[-1][2])
        yield search(shard)

    return run


def _marks(passages: DataFrame, width: int, shard_words: int, crowd: int) -> DataFrame:
    """(key, pid, firsts, lasts): intervals of the starts of repeated windows for passages(key, pid, gp, passage, n)."""
    size, calm, links = width - GRAM + 1, [], []
    while True:
        busy = stored(passages.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("busy")), "crowded-keys") if size > 1 else None
        if busy is None or busy.isEmpty():
            calm.append(passages)
            break
        size = (size + 1) // 2
        split = join_keyed(passages, busy, "key", F.col("pid"), "left")
        calm.append(split.where("busy is null").select(*passages.columns))
        crowded = split.where("busy").select(*passages.columns)
        if not crowded.groupBy("key", "pid").count().where("count > 1").isEmpty():
            raise ValueError("two different passages of one key have the same hash")
        parts = stored(_cut(crowded, size, width), "parts", "zstd")
        links.append(parts.select("key", "pid", "at", "sub_key", "sub_pid"))
        passages = stored(parts.groupBy(F.col("sub_key").alias("key"), F.col("sub_pid").alias("pid"), "gp", "passage").agg(F.sum("n").alias("n")), "cut-passages", "zstd")
    every = calm[0]
    for more in calm[1:]:
        every = every.union(more)
    dealt = every.select("key", "pid", "passage", "n").repartition("key").sortWithinPartitions("key")
    marks = stored(dealt.mapInArrow(_search(width, shard_words), MARKS), "marks", batch_rows=2048)
    if not links:
        return marks
    # Marks of parts become marks of what they were cut from, the shortest parts first.
    for link in reversed(links):
        below = marks.select(F.col("key").alias("sub_key"), F.col("pid").alias("sub_pid"), "firsts", "lasts")
        moved = link.join(below, ["sub_key", "sub_pid"]).select("key", "pid", *(F.transform(c, lambda x: x + F.col("at")).alias(c) for c in ("firsts", "lasts")))
        moved = moved.groupBy("key", "pid").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("lasts")).alias("lasts"))
        marks = marks.union(stored(moved, "moved-marks"))
    return marks


def _removed(found: DataFrame, width: int) -> DataFrame:
    def make():
        def work(batch):
            gone, sha = [], []
            for joined, n, spans in zip(*(batch.column(c).to_pylist() for c in ("words", "n_words", "spans")), strict=True):
                step = np.zeros(n + 1, np.int64)
                for s in spans:
                    np.add.at(step, np.array(s["firsts"], np.int64) + s["at"], 1)
                    np.subtract.at(step, np.array(s["lasts"], np.int64) + s["at"] + width, 1)
                out = np.cumsum(step)[:-1] > 0
                gone.append(int(out.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, x in zip(joined.split(b" "), out.tolist(), strict=True) if not x])).hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_removed": gone, "kept_sha256": sha}

        return work

    return map_batches(found, "doc_id long, n_words long, n_removed long, kept_sha256 string", make)


def remove_repeats(docs: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs.

    A word goes if a window of width consecutive words covers it whose words also start anywhere else, in this or another
    row. Null texts have no words; texts of fewer than width words keep all. Rows that repeat each other count as two
    places, each row on its own account, so ties need no rule. A null doc_id is fine; other columns are ignored; an empty
    table gives an empty result. A text is held whole in one task, with an integer or two a word; what is shuffled of it
    are its passages, of at most 2 * width words each. Two passages of one hash stop the job; they are never mixed up.
    """
    texts = bucketed(_texts(docs.select(F.col("doc_id").cast("long"), "text"), width), "texts", "rid", "zstd")
    grams = texts.select("rid", F.explode("grams").alias("gram"))
    shared = stored(grams.groupBy("gram").count().where("count > 1"), "shared-grams")
    lists = stored(_shared_of(grams, shared).groupBy("rid").agg(F.collect_set("gram").alias("shared")), "text-grams")
    pieces = stored(_pieces(texts.drop("doc_id", "sha").join(lists, "rid"), width), "pieces", "zstd")
    passages = pieces.where("passage is not null").groupBy("key", "pid", "passage").agg(F.sum("n").alias("n"))
    passages = stored(passages.select("key", "pid", F.lit(-1).alias("gp"), "passage", "n"), "passages", "zstd")
    marks = _marks(passages, width, shard_words, crowd)
    places = pieces.where("rid is not null").select("rid", "at", "key", "pid")
    spans = places.join(marks, ["key", "pid"]).groupBy("rid").agg(F.collect_list(F.struct("at", "firsts", "lasts")).alias("spans"))
    spans = stored(spans, "spans")
    later = _removed(texts.select("rid", "doc_id", "words", "n_words").join(spans, "rid"), width)
    whole = texts.select("rid", "doc_id", "n_words", "sha").join(spans.select("rid"), "rid", "left_anti")
    return whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")).union(later)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of whole documents; edge cases as at remove_repeats()."""
    return remove_repeats(documents(spark, sf_dir))


#: The same in DuckDB: every window is spelt out and counted.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT r, i, word, string_agg(word, ' ') OVER f AS window_words, count(*) OVER f AS n FROM u WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)),
m AS (SELECT window_words FROM s WHERE n = {WIDTH} GROUP BY window_words HAVING count(*) > 1),
b AS (SELECT s.r, s.i, s.word, m.window_words IS NOT NULL AS starts FROM s LEFT JOIN m ON s.n = {WIDTH} AND s.window_words = m.window_words),
c AS (SELECT r, i, word, bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM b),
g AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""
