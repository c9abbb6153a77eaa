"""Quality classifier by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated class prior.

A text is described by shares and counts over its whole length, each cut into bands at fixed quantiles of all training
texts; a linear model over the bands minimises the non-negative unbiased risk (Kiryo et al. 2017) with logistic loss.
Quantiles and the class prior are taken over every training row by Spark. The fits take a bounded sample of the trusted
positives and every training row as unlabelled text: rows are counted by their bands and dealt evenly over slices of
bounded size, a task fits a slice against the same positives, and the coefficients of all slices are averaged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, stored
from .toxicity import fit_logistic

#: Labelled positives that the fits use at most (chosen by hash); unlabelled rows a slice; steps of a fit; folds of the prior's scores.
POSITIVES, SLICE_ROWS, STEPS, RATE, DECAY, FOLDS, SEED = 6_000, 12_000, 400, 0.05, 1e-3, 5, 5
#: Coefficients are averaged as integers of this fraction, so that the order of slices changes nothing.
FINE = 2.0**30
#: Tasks that fit slices, at most; beyond that a task has several, one after the other.
FIT_TASKS = 4096
#: Quantiles at which a feature is cut. What tells junk is mostly far out; few cuts keep the fit steady on few positives.
CUTS = (0.02, 0.1, 0.5, 0.9, 0.98)
FEATURES = ("log_words", "word_length", "upper", "digits", "marks", "symbols", "bars", "distinct_words", "top_word", "same_as_last", "dup_lines", "line_length", "ends_marked", "non_ascii", "word_entropy", "distinct_pairs", "long_words", "capital_words")


def describe(text: str) -> list[float]:
    """FEATURES of a text; all zero for one without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    letters = sum(map(str.isalpha, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    upper = sum(map(str.isupper, text)) if not raw.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    of = lambda marks: len(raw) - len(raw.translate(None, marks))
    entropy = math.log2(n) - math.fsum(c * math.log2(c) for c in seen.values()) / n
    return [
        math.log(n), chars / n, upper / max(letters, 1), of(b"0123456789") / chars, of(b"!?") / chars, of(b"#*$%&<>{}^~") / chars, of(b"|") / chars,
        len(seen) / n, max(seen.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
        sum(x.rstrip()[-1] in ".!?:;\"" for x in lines) / max(len(lines), 1), (len(raw) - len(text)) / chars, entropy / max(math.log2(n), 1.0), len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
        sum(len(w) > 14 for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


class Bands:
    """One column for each band of each feature."""

    def __init__(self, edges: list[list[float]]) -> None:
        self.edges = [np.array(e) for e in edges]
        self.width = sum(len(e) + 1 for e in edges)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.columns(np.array([np.searchsorted(e, c, side="left") for c, e in zip(x.T, self.edges, strict=True)], int).T)

    def columns(self, bands: np.ndarray) -> np.ndarray:
        """From the number of each feature's band."""
        out = np.zeros((len(bands), self.width))
        starts = np.cumsum([0, *(len(e) + 1 for e in self.edges[:-1])])
        np.put_along_axis(out, bands + starts, 1, axis=1)
        return out

    def numbers(self) -> Column:
        """The same numbers of bands as a column, from a column x."""
        return F.array(*(sum(((F.col("x")[i] > v).cast("int") for v in e.tolist()), F.lit(0)) for i, e in enumerate(self.edges)))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def share_ratio(positive: np.ndarray, all_: np.ndarray, total: tuple[int, int]) -> float:
    """Share of positives among all, from how many of each score at least a threshold, for several thresholds.

    Above a threshold that no negative reaches, the share of all rows over the share of positives is the prior; elsewhere
    it is more. So the least ratio is taken, over thresholds that three tenths of the positives reach.
    """
    a, b = positive / max(total[0], 1), all_ / max(total[1], 1)
    best = min((y / x for x, y in zip(a.tolist(), b.tolist(), strict=True) if x >= 0.3), default=1.0)
    return float(min(max(best, 0.02), 0.98))


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, times: np.ndarray | None = None, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Coefficients (the last is the constant) by Adam on prior * R+(p) + max(0, R-(u) - prior * R-(p)).

    times says how often each row of u counts (None: once). Where the bracket is below zero, its gradient is followed
    upwards instead, as the non-negative risk asks.
    """
    share = np.full(len(u), 1 / max(len(u), 1)) if times is None else times / times.sum()
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    w = np.zeros(p.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    m = v = np.zeros_like(w)
    for i in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        negative = share @ np.logaddexp(0, fu) - prior * np.logaddexp(0, fp).mean()
        up = -prior * (p.T @ (1 - _sigmoid(fp))) / len(p)
        down = u.T @ (share * _sigmoid(fu)) - prior * (p.T @ _sigmoid(fp)) / len(p)
        g = (up + down if negative >= 0 else -down) + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The non-negative risk that fit_pu() lowers, without its decay."""
    fp, fu = np.c_[p, np.ones(len(p))] @ w, np.c_[u, np.ones(len(u))] @ w
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return float(prior * np.logaddexp(0, -fp).mean() + max(0.0, negative))


def held_out_rows(modulus: int, held_out: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x (FEATURES) of every row of docs, stored: texts are read once, for learning and scoring.

    Null texts count as empty. Repeated rows and null doc_ids each give their row; other columns are ignored.
    """

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "x": [describe(t or "") for t in batch.column("text").to_pylist()]}

    return stored(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, x array<double>", make), "described")


def sample(rows: DataFrame, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """x and fold of those of the total rows(doc_id, x, fold) that have the most least hashes, in that order.

    A bound on the hash leaves about twice as many as are wanted before rows are put in order, so that tasks don't each
    give that many; should too few have it (much repeated doc_ids), all are put in order. Only those chosen reach the driver.
    """
    h = F.xxhash64(F.lit(SEED), "doc_id")
    bound = min(int(min(1.0, (2 * most + 1000) / max(total, 1)) * 2**64) - 2**63, 2**63 - 1)
    for part in (rows.where(h <= bound), rows):
        found = stored(part.orderBy(h, "doc_id", "x").limit(most).select(h.alias("h"), "doc_id", "x", "fold"), "sample").collect()
        if len(found) >= min(most, total):
            break
    found.sort(key=lambda r: (r["h"], r["doc_id"], r["x"]))
    return np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES)), np.array([r["fold"] for r in found], int)


def deal(rows: DataFrame, bands: Bands, slices: int) -> DataFrame:
    """slice, bands (a number a feature), fold and times of rows(x, fold), every row in one of the slices.

    Rows of one fold and the same bands are counted before they move, and the count is spread evenly over the slices: a
    vector that much of the corpus shares is one row a slice.
    """
    counted = rows.select(bands.numbers().alias("bands"), "fold").groupBy("bands", "fold").agg(F.count("*").alias("n"))
    most = F.lit(slices).cast("long")
    spread = counted.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", most) - 1)))
    place = F.pmod(F.pmod(F.xxhash64(F.lit(SEED + 2), "bands", "fold"), most) + F.col("i"), most)
    times = F.floor((F.col("n") - F.col("n") % most) / most) + (F.col("i") < F.col("n") % most).cast("long")
    return spread.select(place.alias("slice"), "bands", "fold", times.alias("times"))


def average(dealt: DataFrame, slices: int, bands: Bands, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Means over slices of the rows of coefficients that fit(columns, fold, times) gives for each; a task has one slice at a time.

    Rows of a slice are put in order first, so that the result doesn't depend on partitions.
    """

    def one(found):
        numbers = np.stack(found["bands"].to_numpy())
        order = np.lexsort([found["fold"].to_numpy(), *numbers.T])
        models = fit(bands.columns(numbers[order]), found["fold"].to_numpy()[order], found["times"].to_numpy()[order])
        return pd.DataFrame({"model": range(len(models)), "w": [np.rint(m * FINE).astype(np.int64).tolist() for m in models]})

    fitted = dealt.repartition(min(slices, FIT_TASKS), "slice").groupBy("slice").applyInPandas(one, "model int, w array<long>")
    sums = fitted.select("model", F.posexplode("w")).groupBy("model", "pos").agg(F.sum("col").alias("s"), F.count("*").alias("n")).collect()
    out = np.zeros((max(r["model"] for r in sums) + 1, bands.width + 1))
    for r in sums:
        out[r["model"], r["pos"]] = r["s"] / r["n"] / FINE
    return out


def _prior(rows: DataFrame, dealt: DataFrame, slices: int, bands: Bands, p: np.ndarray, p_fold: np.ndarray) -> float:
    """The class prior over all of rows(x, fold, trusted), each scored by a p-against-all model that its fold took no part in."""

    def fit(u, u_fold, times):
        models = []
        for k in range(FOLDS):
            a, b, n = p[p_fold != k], u[u_fold != k], times[u_fold != k]
            y, often = np.r_[np.ones(len(a)), np.zeros(len(b))], np.r_[np.ones(len(a)), n]
            models.append(fit_logistic(np.r_[a, b], y, ridge=5.0, times=often) if len(a) and len(b) else np.zeros(bands.width + 1))
        return models

    weights = average(dealt, slices, bands, fit)

    def make():
        def work(batch):
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            return {"trusted": batch.column("trusted"), "s": np.einsum("ij,ij->i", bands(x), weights[batch.column("fold").to_numpy(), :-1]).tolist()}

        return work

    scores = stored(map_batches(rows.select("x", "fold", "trusted"), "trusted boolean, s double", make, 4096), "prior-scores", batch_rows=4096)
    at = sorted(set(scores.where("trusted").agg(F.percentile_approx("s", [float(q) for q in np.linspace(0.02, 0.7, 35)], 10_000)).first()[0] or []))
    reach = [F.sum(((F.col("s") >= t) & c).cast("long")) for t in at for c in (F.col("trusted"), F.lit(True))]
    found = scores.agg(F.sum(F.col("trusted").cast("long")), F.count("*"), *reach).first()
    return share_ratio(np.array(found[2::2], float), np.array(found[3::2], float), (found[0] or 0, found[1]))


def learn(table: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, positives: int = POSITIVES, slice_rows: int = SLICE_ROWS) -> dict[str, list]:
    """The model for table = described(docs): edges of the bands, coefficients, the prior.

    Only labels 1 are used, those of rows that are not held out (a doc_id with several labels counts as 1 if any is). Without any, every score is 0.5.
    Every training row counts as unlabelled, in slices of some slice_rows. What reaches the driver: quantiles, counts, sums
    of coefficients, and the features of at most positives trusted rows. Texts of any length come as their features.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("label = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("trusted")).distinct()
    rows = table.where(~held_out_rows(modulus, held_out)).join(known, "doc_id", "left")
    rows = stored(rows.select("doc_id", "x", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).alias("fold")), "training-rows")
    total, trusted, *edges = rows.agg(F.count("*"), F.count_if("trusted"), *(F.percentile_approx(F.col("x")[i], list(CUTS), 10_000) for i in range(len(FEATURES)))).first()
    px, p_fold = sample(rows.where("trusted"), trusted, positives)
    if not len(px):
        return {"edges": [[] for _ in FEATURES], "weights": [0.0] * (len(FEATURES) + 1), "prior": [0.5]}
    bands = Bands([sorted(set(e)) for e in edges])
    p, slices = bands(px), -(-total // slice_rows)
    dealt = stored(deal(rows, bands, slices), "slices")
    prior = _prior(rows, dealt, slices, bands, p, p_fold)
    (weights,) = average(dealt, slices, bands, lambda u, _, times: [fit_pu(p, u, prior, times)])
    return {"edges": [e.tolist() for e in bands.edges], "weights": weights.tolist(), "prior": [prior]}


def quality_scores(table: DataFrame, model: dict[str, list], modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of table = described(docs); no shuffle.

    Empty texts are described by zeros and scored like any other. A null doc_id is not held out. Repeated rows give a row
    each; an empty table gives an empty result; a score that ties with the threshold is predicted 1.
    """

    def make():
        bands, w = Bands(model["edges"]), np.array(model["weights"])

        def work(batch):
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            score = _sigmoid(bands(x) @ w[:-1] + w[-1])
            return {"doc_id": batch.column("doc_id"), "score": score.tolist(), "predicted": (score >= threshold).astype(int).tolist()}

        return work

    scored = map_batches(table.select("doc_id", "x"), "doc_id long, score double, predicted int", make, 4096)
    return scored.select("doc_id", held_out_rows(modulus, held_out).alias("held_out"), "score", "predicted")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole documents; edge cases as at learn() and quality_scores()."""
    table = described(documents(spark, sf_dir))
    return quality_scores(table, learn(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))
