"""Language-model scoring: a hashed maximum-entropy model of word classes, and words within their class.

P(word | before) = P(class | before) P(word | class). The first factor is a softmax over classes, whose logits sum a bias and
rows of one table, picked by hashes of features: the word before, the pair of words before, and two skips, the words two
and three places before. The second has one feature a word, its bias, whose best value is its smoothed count.

Counts of words are exact over all training documents. The frequent words, a bounded number, go to the tasks; they are put in classes by the
company they keep. All others share the last class, and their counts come by a join, in which no word is frequent. The
table is trained by gradient steps: a step's slice of the training documents gives observed and expected counts of
(feature row, class), summed as integers, so that neither order nor retries change a weight; the slices cover all of them once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, as_bytes, documents, map_batches, stored, trim

#: Words that tasks know, at most, and grades of counts a doubling, by which they are chosen. Words of the text are never empty: the empty one stands for the end.
HEAD, GRADES, END = 131_072, 64, b""
#: The most frequent words have a class of their own, then come classes by company, then that of the rare words.
SINGLES, CLUSTERS = 15, 16
CLASSES = SINGLES + CLUSTERS + 1
#: Company: the words within REACH places, of the ANCHORS most frequent ones, in BUCKETS by hash.
ANCHORS, BUCKETS, REACH = 256, 16, 3
#: Rows of the table (their numbers take 16 bits); gradient steps, each over a slice of the training documents; their size, and the count that damps it.
ROWS, STEPS, RATE, DAMP = 1 << 15, 4, 0.7, 3.0
#: Fixed point of the probabilities in a task, of what it gives of their sums, and of the logarithms that are summed.
PARTS, GIVEN_PARTS, LOG_PARTS = 1 << 16, 1 << 6, 1 << 40
#: Tokens that are worked on at once (CHUNK * PARTS fits 32 bits), and entries that a task counts before it passes them on.
CHUNK, PENDING = 8_192, 200_000
#: Rows of a table that are sent at once; tasks a core, and groups of them, that sum into tables.
_BLOCK, TASKS, GROUPS = 1024, 4, 32
_NONE = -1e4


def held_out(modulus: int = 5, remainder: int = 1) -> Column:
    """Rows with crc32(doc_id as text) of that remainder; a null doc_id is not one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word of docs(text), and of END, one a document. Sums of parts; a word has many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in as_bytes(batch, "text"):
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) > PENDING:
                    yield flush()
        yield flush()
        trim()

    return docs.select("text").mapInArrow(run, "word binary, n long")


def encode(docs: DataFrame, head: list[bytes]) -> DataFrame:
    """doc_id, held_out, ids (of the words in head, len(head) for others, then that of END; see flat_ids()), and the other words with their counts."""
    rare = len(head)

    def make():
        known = {w: i for i, w in enumerate(head)}

        def work(batch):
            ids, tail, tail_n = [], [], []
            for text in as_bytes(batch, "text"):
                words = [*words_of(text), END]
                own = np.fromiter(map(known.get, words, repeat(rare)), np.int32, len(words))
                others = Counter([words[i] for i in np.flatnonzero(own == rare).tolist()])
                ids.append(own.tobytes())
                tail.append(list(others))
                tail_n.append(list(others.values()))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "ids": ids, "tail": tail, "tail_n": tail_n}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return map_batches(rows, "doc_id long, held_out boolean, ids binary, tail array<binary>, tail_n array<int>", make, after=trim)


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, one after another, and how many each row has. They are stored as 32-bit integers in one binary
    value a row, which Spark copies whole; arrays it would copy number by number."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows], np.int64)


@dataclass
class Model:
    """What tasks need to score: the class of each head word (the last: rare words'), its logarithm within the class, bias and table."""

    classes: np.ndarray
    within: np.ndarray
    bias: np.ndarray
    table: np.ndarray

    def __post_init__(self) -> None:
        n = np.arange(len(self.classes) + 1, dtype=np.uint64)  # one beyond: before the first word
        self.start = len(self.classes)
        self.single = [_mixed(n * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) for k in (1, 2, 3)]
        self.seed = n * np.uint64(0xC2B2AE3D27D4EB4F)

    def __reduce__(self):
        return Model, (self.classes, self.within, self.bias, self.table)  # hashes are computed anew where it is read

    def contexts(self, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The words one, two and three places before each of ids, which are those of documents of the given sizes."""
        at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return [np.where(at >= k, np.concatenate([np.full(min(k, len(ids)), self.start), ids[:-k]]), self.start) for k in (1, 2, 3)]

    def rows(self, before: list[np.ndarray]) -> list[np.ndarray]:
        """Rows of the table for the features: three single words, and the pair before."""
        pair = _mixed(self.seed[before[0]] + (before[1].astype(np.uint64) << np.uint64(20)) + np.uint64(4))
        return [*(t[b] for t, b in zip(self.single, before, strict=True)), pair]

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.take(self.table, rows[0], axis=0, mode="clip")
        out += self.bias
        for r in rows[1:]:
            out += np.take(self.table, r, axis=0, mode="clip")
        return out

    def chunks(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
        """(place, rows, logits) of some CHUNK of ids at a time."""
        before = self.contexts(ids, sizes)
        for a in range(0, len(ids), CHUNK):
            part = slice(a, a + CHUNK)
            rows = self.rows([b[part] for b in before])
            yield part, rows, self.logits(rows)

    def log_classes(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ln P(class of ids[i] | what stands before it). Logits are small by construction: steps add at most RATE a feature."""
        out, y = np.empty(len(ids)), self.classes[ids]
        for part, _, logits in self.chunks(ids, sizes):
            own = logits[np.arange(len(logits)), y[part]].astype(float)
            out[part] = own - np.log(_row_sums(np.exp(logits, out=logits)).astype(float))
        return out

    def gradient(self, ids: np.ndarray, sizes: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """Adds the counts of (row, class), as they are and PARTS times as the model has them, to two tables of integers."""
        flat, y = observed.reshape(-1), self.classes[ids]
        for part, rows, p in self.chunks(ids, sizes):
            np.exp(p, out=p)
            p *= (PARTS / _row_sums(p))[:, None]
            # Two classes are summed as one 64-bit number: no sum of a chunk fills 32 bits, and running sums may wrap.
            pairs = np.rint(p, out=p).astype(np.int32).view(np.int64)
            for r in rows:
                # Sixteen bits are sorted by radix.
                order = np.argsort(r, kind="stable")
                own = r[order]
                last = np.flatnonzero(np.r_[own[1:] != own[:-1], True])
                upto = np.take(pairs, order, axis=0, mode="clip")
                upto = np.cumsum(upto, axis=0, out=upto)[last]
                upto[1:] -= upto[:-1].copy()
                expected[own[last]] += upto.view(np.int32)
                np.add.at(flat, r * np.int64(CLASSES) + y[part], 1)


def _row_sums(p: np.ndarray) -> np.ndarray:
    """Sums of rows of CLASSES, a power of two, by halves: the same whatever else is in p."""
    while p.shape[1] > 1:
        p = p[:, : p.shape[1] // 2] + p[:, p.shape[1] // 2 :]
    return p[:, 0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) & np.uint64(ROWS - 1)).astype(np.uint16)


def _summed(rows: DataFrame, width: int, columns: tuple[str, ...], work: Callable, finish: Callable | None = None) -> dict[str, np.ndarray]:
    """Tables that the tasks fill by work(ids, sizes, *tables), summed; their size is fixed, and so is what the driver gets.

    A task gives blocks of its tables, those rows that have anything, as integers; blocks are added up by groups of
    tasks, then over the groups. finish(*sums) makes one table of 32-bit numbers of a block's sums, row by row, and the driver gets
    that alone, as "finished".
    """
    spark, height = rows.sparkSession, work.height
    shared = spark.sparkContext.broadcast(work)
    schema = lambda names: "block int, group int, used binary, " + ", ".join(f"{c} binary" for c in names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group, tables, work = TaskContext.get().partitionId() % GROUPS, None, shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                tables = tables or work.tables()
                work.add(*flat_ids(batch.column("ids").slice(start, BATCH_ROWS)), *tables)
        if tables:
            for b in range(0, height, _BLOCK):
                whole = work.given(*(t[b : b + _BLOCK] for t in tables))
                used = _used(whole)
                if len(used):
                    yield said(b // _BLOCK, group, used, [_narrow(t[used]) for t in whole])
        trim()

    def said(block: int, group: int, used: np.ndarray, tables: list[np.ndarray], names: tuple[str, ...] = columns) -> pa.RecordBatch:
        numbers = {"block": pa.array([block], pa.int32()), "group": pa.array([group], pa.int32()), "used": pa.array([used.astype(np.uint16).tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(numbers | {c: pa.array([t.tobytes()], pa.binary()) for c, t in zip(names, tables, strict=True)})

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for block, group, used, *parts in zip(*(batch.column(c).to_pylist() for c in ("block", "group", "used", *columns)), strict=True):
                held = sums.setdefault((block, group), [np.zeros((_BLOCK, width), np.int64) for _ in columns])
                at = np.frombuffer(used, np.uint16)
                for h, p in zip(held, parts, strict=True):
                    h[at] += _wide(p, len(at), width)
        for (block, group), held in sums.items():
            used = _used(held)
            yield block, group, used, [t[used] for t in held]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group, used, tables in sums_of(batches):
            yield said(block, group, used, [_narrow(t) for t in tables])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group, used, tables in sums_of(batches):
            yield said(block, group, used, [finish(*tables).astype(np.float32)], ("finished",))

    # So many tasks fill tables, however many parts the rows have: what they give grows with the machines, not with the rows.
    tasks = spark.sparkContext.defaultParallelism * TASKS
    made = rows.select("ids").coalesce(tasks).mapInArrow(fill, schema(columns)).repartition("block", "group").mapInArrow(add, schema(columns))
    made = made.withColumn("group", F.lit(0)).repartition("block")
    names = ("finished",) if finish else columns
    made = made.mapInArrow(end if finish else add, schema(names)).toArrow()
    shared.destroy()  # else the driver and the executors keep each step's
    out = {c: np.zeros((-(-height // _BLOCK) * _BLOCK, width), np.float32 if finish else np.int64) for c in names}
    for block, used, *parts in zip(*(made[c] for c in ("block", "used", *names)), strict=True):
        at = block.as_py() * _BLOCK + np.frombuffer(used.as_buffer(), np.uint16).astype(int)
        for c, p in zip(names, parts, strict=True):
            out[c][at] = np.frombuffer(p.as_buffer(), np.float32).reshape(-1, width) if finish else _wide(p.as_buffer(), len(at), width)
    return {c: t[:height] for c, t in out.items()}


def _used(tables: list[np.ndarray]) -> np.ndarray:
    """The rows in which some table has anything."""
    return np.flatnonzero(np.any([t.any(axis=1) for t in tables], axis=0))


def _narrow(t: np.ndarray) -> np.ndarray:
    """t (no number of it is negative) as 32-bit integers if they hold it, else as 64-bit ones; _wide() reads both."""
    return t.astype(np.int32 if t.max(initial=0) < 1 << 31 else np.int64)


def _wide(t: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(t, np.int32 if len(t) == 4 * rows * width else np.int64).reshape(rows, width)


@dataclass
class _Company:
    """Counts of the anchors' buckets around each head word."""

    buckets: np.ndarray

    @property
    def height(self) -> int:
        return len(self.buckets)

    def tables(self) -> list[np.ndarray]:
        return [np.zeros((self.height, BUCKETS), np.int32)]

    def given(self, *tables: np.ndarray) -> list[np.ndarray]:
        return list(tables)

    def add(self, ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> None:
        bucket, doc = self.buckets[ids], np.repeat(np.arange(len(sizes)), sizes)
        for k in range(1, REACH + 1):
            same = doc[k:] == doc[:-k]
            for word, near in ((ids[k:], bucket[:-k]), (ids[:-k], bucket[k:])):
                ok = same & (near >= 0)
                cell, n = np.unique(word[ok].astype(np.int64) * BUCKETS + near[ok], return_counts=True)
                table.reshape(-1)[cell] += n.astype(np.int32)


@dataclass
class _Counts:
    """Observed and expected counts of (row, class) under a model."""

    model: Model
    height = ROWS

    def tables(self) -> list[np.ndarray]:
        return [np.zeros((ROWS, CLASSES), np.int64) for _ in range(2)]

    def given(self, observed: np.ndarray, expected: np.ndarray) -> list[np.ndarray]:
        return [observed, (expected + PARTS // GIVEN_PARTS // 2) // (PARTS // GIVEN_PARTS)]

    def add(self, ids: np.ndarray, sizes: np.ndarray, *tables: np.ndarray) -> None:
        self.model.gradient(ids, sizes, *tables)


def clusters(company: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """A cluster of each row of company by the shares of its counts, smoothed; weights are counts. Nothing is drawn."""
    share = (company.sum(axis=0) + 1) / (company.sum() + company.shape[1])
    x = np.sqrt((company + 8 * share) / (company.sum(axis=1, keepdims=True) + 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seeds = [int(np.argmax(weight))] if len(x) else []
    far = 1 - x @ x[seeds[0]] if len(x) else None
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmax(far * np.log1p(weight))))
        far = np.minimum(far, 1 - x @ x[seeds[-1]])
    centre, found = x[seeds], np.zeros(len(x), int)
    for _ in range(rounds if len(x) else 0):
        found = np.argmax(x @ centre.T, axis=1)
        sums = np.array([weight[found == j] @ x[found == j] for j in range(len(centre))])
        centre = np.where(sums.any(axis=1, keepdims=True), sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centre)
    return found


@dataclass
class Statistics:
    """Of the training documents: (word, c) as a table, all tokens, distinct ones, the head and its counts."""

    counts: DataFrame
    tokens: int
    distinct: int
    head: list[bytes]
    head_counts: np.ndarray


def statistics(docs: DataFrame, most: int = HEAD) -> Statistics:
    """Exact counts over all of docs(text). The head is END and all words above a count, the least of a scale at which they are
    at most `most`: no words are sorted, and no task or driver gets more of them than that."""
    counts = stored(count_words(docs).groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grade = F.floor(F.log2("c") * GRADES).cast("int")
    least, n = None, 0
    for r in counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # some GRADES a doubling
        n += r["count"]
        if n > most:
            break
        least = r["grade"]
    found = counts.where(F.lit(False) if least is None else grade >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    head, head_counts = found["word"].to_pylist(), found["c"].to_numpy()
    if END not in head:
        end = counts.where(F.length("word") == 0).first()
        head, head_counts = [*head, END], np.append(head_counts, end["c"] if end else 0)
    return Statistics(counts, tokens, distinct, head, head_counts.astype(np.int64))


def _step(observed: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """What a step adds to the table, damped by the larger of the two counts."""
    expected = expected / GIVEN_PARTS
    return rate * (observed - expected) / (np.maximum(observed, expected) + DAMP)


def train(encoded: DataFrame, known: Statistics, steps: int = STEPS, rate: float = RATE) -> Model:
    """The model of the rows of encode() that are not held out; each of them is in one step."""
    rows = encoded.where(~F.col("held_out"))
    n = len(known.head)
    weight = known.head_counts.astype(float)
    buckets = np.full(n + 1, -1, np.int64)
    buckets[: min(n, ANCHORS)] = [zlib.crc32(w) % BUCKETS for w in known.head[:ANCHORS]]
    company = _summed(rows, BUCKETS, ("company",), _Company(buckets))["company"][:n]
    classes = np.full(n + 1, CLASSES - 1, np.uint8)
    classes[:n] = SINGLES + clusters(company, weight, CLUSTERS)
    classes[: min(n, SINGLES)] = np.arange(min(n, SINGLES))
    mass = np.bincount(classes[:n], weight, CLASSES)
    size = np.bincount(classes[:n], minlength=CLASSES)
    tail = known.tokens - int(known.head_counts.sum()), known.distinct - int((known.head_counts > 0).sum())
    mass[-1], there = tail[0], np.append(size[:-1] > 0, True)
    bias = np.where(there, np.log((mass + 0.5) / (known.tokens + 0.5 * there.sum())), _NONE)
    within = np.append(np.log10((weight + 0.5) / (mass + 0.5 * size)[classes[:n]]), -np.log10(tail[0] + 0.5 * (tail[1] + 1)))
    model = Model(classes, within, bias.astype(np.float32), np.zeros((ROWS, CLASSES), np.float32))
    for step in range(steps):
        part = rows.where(F.pmod(F.xxhash64("doc_id", (F.length("ids") / 4).cast("int")), F.lit(steps)) == step)
        moved = _summed(part, CLASSES, ("observed", "expected"), _Counts(model), lambda o, e: _step(o, e, rate))["finished"]
        model = Model(classes, within, model.bias, model.table + moved)
    return model


def scores(encoded: DataFrame, known: Statistics, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of encode(), which is stored."""
    base = np.append(np.log10(known.head_counts + 0.5), 0.0)
    floor, rare = float(np.log10(known.tokens + 0.5 * (known.distinct + 1))), len(known.head)

    def make():
        seen = known_counts > 0

        def work(batch):
            ids, sizes = flat_ids(batch.column("ids"))
            first = np.cumsum(sizes) - sizes
            add = lambda v: np.add.reduceat(v, first) if len(first) else np.empty(0)
            own = {"n_tokens": sizes.astype(np.int64), "n_rare": add((ids == rare).astype(np.int64)), "n_head": add(seen[ids].astype(np.int64))}
            own |= {"base": add(base[ids]), "score": add(model.log_classes(ids, sizes) / np.log(10) + model.within[ids])} if len(ids) else {"base": [], "score": []}
            return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")} | own

        return work

    known_counts = np.append(known.head_counts, 0)
    scored = map_batches(encoded.select("row", "doc_id", "held_out", "ids"), "row long, doc_id long, held_out boolean, n_tokens long, n_rare long, n_head long, base double, score double", make, after=trim)
    logs = known.counts.select("word", F.round(F.log10(F.col("c") + 0.5) * LOG_PARTS).cast("long").alias("log"))
    words = encoded.select("row", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("tail_n").alias("n"))))
    # Sums of integers, in any order the same.
    tail = words.join(logs, "word").groupBy("row").agg(F.sum("n").alias("found"), F.sum(F.col("n") * F.col("log")).alias("log"))
    rows = scored.join(tail, "row", "left")
    found = F.coalesce("found", F.lit(0))
    more = F.coalesce("log", F.lit(0)) / LOG_PARTS + (F.col("n_rare") - found) * float(np.log10(0.5))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + found).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * floor).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def language_model_scores(docs: DataFrame, most: int = HEAD, steps: int = STEPS) -> DataFrame:
    """Scores of every row of docs(doc_id, text), learnt from those that are not held out.

    base_score is the sum of log10 of the words' smoothed shares, score the model's log10 probability; both take words that
    no training document has as one kind of word. Null and empty texts have one token, the end. A null doc_id is not held
    out. Repeated rows count and are scored each; further columns of docs are ignored; an empty table gives an empty
    result, and without training documents nothing is known. Texts are read whole, some thousand words at a time.
    """
    known = statistics(docs.where(~held_out()), most)
    encoded = stored(encode(docs, known.head).withColumn("row", F.monotonically_increasing_id()), "encoded")
    return scores(encoded, known, train(encoded, known, steps))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole documents; edge cases as at language_model_scores()."""
    return language_model_scores(documents(spark, sf_dir))
