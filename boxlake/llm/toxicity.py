"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, against the length of the text.

First a text is made plain: compatibility forms (full-width and mathematical letters), accents and zero-width characters
go, stretched letters shrink, parted ones join. Then folding takes case, homoglyphs and digit substitutions away one
character for one, so places stay. An entry matches a whole word or, as a stem, how a word begins; matches inside an
exception phrase do not count. Weights, further stems and the figures that turn matches into a probability are learned
from labelled rows; those figures from texts that took no part in the weights they are matched with.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, stored

#: Words known beforehand and their weight until labels say more (fixed values).
LEXICON = {
    "idiot": 3.0, "moron": 3.0, "stupid": 2.5, "scum": 3.0, "trash": 2.0, "garbage": 1.5, "loser": 2.5, "clown": 2.0, "pathetic": 2.5, "worthless": 2.5, "disgusting": 2.5,
    "imbecile": 3.0, "dumb": 2.0, "dumbass": 3.5, "jerk": 2.0, "bastard": 3.0, "bitch": 3.5, "asshole": 3.5, "shit": 3.0, "bullshit": 2.5, "fuck": 3.5, "fucking": 3.5, "fucker": 3.5,
    "crap": 1.5, "vermin": 2.5, "filth": 2.0, "filthy": 1.5, "ugly": 1.5, "freak": 2.0, "retard": 3.5, "retarded": 3.5, "whore": 3.5, "slut": 3.5, "pig": 1.0, "kys": 3.5,
    "idiota": 3.0, "estupido": 2.5, "basura": 1.5, "pendejo": 3.0, "mierda": 3.0, "dummkopf": 3.0, "arschloch": 3.5, "abschaum": 3.0, "schlampe": 3.5, "connard": 3.5, "salaud": 3.0, "ordure": 2.0, "imbeciles": 3.0,
}
#: Phrases in which a word of the lexicon is harmless (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "garbage can", "garbage collection", "garbage collector", "garbage truck", "clown fish", "class clown", "pond scum", "soap scum", "guinea pig", "pig iron", "jerk chicken", "freak accident", "crap game", "dumb waiter", "dumb bell", "worthless check", "circus clown")
#: Characters that look like a letter, by letter (fixed values).
HOMOGLYPHS = {"a": "аɑα@4", "b": "вß8", "c": "сϲ¢", "d": "ԁ", "e": "еєε3€", "g": "ɡ9", "h": "һ", "i": "іιı1!|l", "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "оοσ0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "т7", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "у", "z": "2"}
#: Labelled rows used at most (chosen by hash).
TRAIN_ROWS, SEED, FOLDS = 20_000, 9, 5
#: A further stem: its lengths, in which share of the toxic texts it must be (and in how many), its least log odds; the most weight.
STEMS, SHARE, LEAST, ODDS, MOST_WEIGHT = range(3, 9), 0.015, 5, 3.0, 8.0


def _table() -> dict[int, str]:
    out = {ord(x): letter for letter, like in HOMOGLYPHS.items() for x in like}
    for cp in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        low = unicodedata.normalize("NFKC", chr(cp)).lower()
        if cp not in out and len(low) == 1 and low != chr(cp):
            out[cp] = {"l": "i"}.get(low, low)
    return out


FOLD = _table()
_FOLDED = np.arange(0x110000, dtype=np.uint32)
_FOLDED[list(FOLD)] = [ord(x) for x in FOLD.values()]


#: Combining marks, zero-width and direction characters, soft hyphens, variation selectors.
_UNSEEN = np.zeros(0x110000, bool)
for _a, _b in ((0x300, 0x36F), (0x483, 0x487), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0xFEFF, 0xFEFF), (0xAD, 0xAD)):
    _UNSEEN[_a : _b + 1] = True
_STRETCHED = re.compile(r"([^\W\d_])\1\1+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SEPARATORS, _LETTERS = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
_SEPARATORS[[ord(x) for x in "-._*·"]] = True
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xAA, 0x110000)]] = True  # or what may be one
_PARTED = re.compile(r"(?<![^\W_])(?:[^\W_][-._*·]){2,}[^\W_](?![^\W_])")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def plain(text: str) -> str:
    """text without accents and unseen characters, compatibility forms replaced; aaa is a, a-b-c is abc."""
    ascii_ = text.isascii()
    c = _points(text if ascii_ else unicodedata.normalize("NFKD", text))
    if not ascii_:
        c = c[~_UNSEEN[c]]
        text = _text(c)
    # Most texts have neither three equal characters in a row nor two separators a letter apart; that is cheap to see.
    three = c[2:][(c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])]
    if _LETTERS[three].any():
        text = _STRETCHED.sub(r"\1", text)
        c = _points(text)
    apart = _SEPARATORS[c]
    return _PARTED.sub(lambda m: m[0][::2], text) if (apart[2:] & apart[:-2]).any() else text


def fold(text: str) -> str:
    """As long as text. l, like 1, | and !, becomes i: words are folded before they are compared."""
    if text.isascii():
        return text.translate(FOLD)  # fast for these only
    return _text(_FOLDED[_points(text)])


class Matcher:
    """weights: by word, or by stem with a * behind it. Words and exceptions are sought in the plain text, stems, which are
    learned as they are spelt, in the text with its accents."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        words: dict[str, list[float | None]] = {}
        for word, w in [*((k, v) for k, v in weights.items() if not k.endswith("*")), *((e, None) for e in exceptions)]:
            for said in {fold(word), fold(_DOUBLE.sub(r"\1", word)) if w is not None else fold(word)}:
                words.setdefault(said, []).append(w)
        stems: dict[str, list[float | None]] = {}
        for stem, w in weights.items():
            if stem.endswith("*"):
                stems.setdefault(fold(stem[:-1]), []).append(w)
        self.words, self.stems = (self._built(x) for x in (words, stems))

    @staticmethod
    def _built(entries: dict[str, list[float | None]]) -> ahocorasick.Automaton | None:
        automaton = ahocorasick.Automaton()
        for said, found in entries.items():
            automaton.add_word(said, (len(said), found))
        automaton.make_automaton()
        return automaton if entries else None

    def hits(self, text: str) -> list[float]:
        """Weights of the matches in text. A plural s is allowed; else a whole word may not go on into letters or digits."""
        out: list[float] = []
        if self.stems is not None:
            for end, (length, weights) in self.stems.iter(fold(text)):
                if end < length or not text[end - length].isalnum():
                    out += weights
        if self.words is None:
            return out
        found: list[tuple[int, int, float]] = []
        safe: list[tuple[int, int]] = []
        text = plain(text)
        folded, n = fold(text), len(text)
        for end, (length, weights) in self.words.iter(folded):
            a, b = end - length + 1, end + 1
            # Edges are judged on the text as given: "trash!" ends in a mark though "!" folds to a letter.
            if a and text[a - 1].isalnum():
                continue
            whole = b + (b < n and folded[b] == "s")
            if whole < n and text[whole].isalnum():
                continue
            for weight in weights:
                if weight is None:
                    safe.append((a, whole))
                else:
                    found.append((a, b, weight))
        return out + [w for a, b, w in found if not any(x <= a and b <= y for x, y in safe)]


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Of stems with (toxic, clean) counts of texts those that tell, with their log odds: the shortest of each branch,
    then drawn out while nineteen in twenty of its toxic texts have the longer one."""
    least = max(LEAST, SHARE * toxic)
    odds = lambda s: math.log((counts[s][0] + 0.5) / (toxic + 1)) - math.log((counts[s][1] + 0.5) / (clean + 1))
    tells = {s for s, (t, _) in counts.items() if t >= least and odds(s) >= ODDS}
    out = {}
    for s in sorted(tells):
        if s[:-1] in tells:
            continue
        while longer := [c for c in tells if c[:-1] == s and counts[c][0] >= 0.95 * counts[s][0]]:
            s = max(longer, key=lambda c: (counts[c][0], c))
        out[s + "*"] = min(MOST_WEIGHT, odds(s))
    return out


def features(text: str, matcher: Matcher) -> tuple[float, float, float]:
    """log(1 + weight), log(1 + weight per 100 words), whether anything matched."""
    total = math.fsum(matcher.hits(text))
    words = len(text.encode().split())
    return math.log1p(total), math.log1p(100 * total / max(words, 1)), float(total > 0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, times: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton steps for coefficients (the last is the constant) with a ridge on all but the constant; times: how often rows count."""
    x = np.c_[x, np.ones(len(x))]
    b, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (times * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled documents that are not held out, chosen by hash.

    Labels of that many rows are broadcast. A doc_id with several labels has the largest; one with several texts counts
    with one of them (that of the least hash), so that the bound holds for rows too.
    """
    open_ = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("label is not null and doc_id is not null")
    open_ = open_.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = open_.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def weigh(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the lexicon and of chosen stems from (toxic, clean) counts of texts; a word of the lexicon is counted as =word."""
    weights = dict(LEXICON)
    if toxic and clean:
        for w in LEXICON:
            if found := counts.get("=" + fold(w)):
                weights[w] = min(MOST_WEIGHT, max(0.0, math.log((found[0] + 0.5) / (toxic + 1)) - math.log((found[1] + 0.5) / (clean + 1))))
        weights |= choose_stems({k: v for k, v in counts.items() if k and k[0] != "="}, toxic, clean)
    return weights


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """Weights of the lexicon and the coefficients of features(). With one class only, or no labels, those known beforehand.

    Both come from at most `most` labelled texts, equal ones once. The texts are dealt to FOLDS folds; those of a fold are
    matched by weights that the other folds give, and the coefficients are fitted to that. Counts of texts leave Spark
    only for words of the lexicon and for stems in SHARE of the toxic texts, which are few; then three figures a text.
    """
    rows = training_rows(docs, labels, "toxic", modulus, held_out, most).dropDuplicates(["text", "label"])
    rows = stored(rows.select("text", "label", F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")

    def make_counts():
        def work(batch):
            counts: Counter = Counter()
            for t, y, k in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                words, simple = ({w.strip(".,;:?\"'()") for w in fold(x).split()} for x in (t, plain(t)))
                counts.update((f"={w}", y, k) for w in simple & known)
                counts.update((s, y, k) for s in {w[:n] for w in words if w[:3].isalpha() for n in STEMS if len(w) >= n})
                counts["", y, k] += 1
            return {"entry": [w for w, _, _ in counts], "label": [y for _, y, _ in counts], "fold": [k for _, _, k in counts], "n": list(counts.values())}

        return work

    known = {fold(w): w for w in LEXICON}.keys()
    counts = map_batches(rows, "entry string, label int, fold int, n long", make_counts)
    of = lambda y, k: F.sum(F.when((F.col("label") == y) & (F.col("fold") == k), F.col("n")).otherwise(0))
    counts = counts.groupBy("entry").agg(*(F.array(*(of(y, k) for k in range(FOLDS))).alias(name) for name, y in (("toxic", 1), ("clean", 0))))
    counts = counts.withColumn("t", F.aggregate("toxic", F.lit(0).cast("long"), lambda a, x: a + x))
    counts = stored(counts.where((F.col("t") >= LEAST) | (F.length("entry") == 0) | F.col("entry").startswith("=")), "entry-counts")
    default = [1.5, 0.5, 1.0, -4.0]
    total = counts.where(F.length("entry") == 0).first()
    if total is None or not sum(total["toxic"]) or not sum(total["clean"]):
        return dict(LEXICON), default
    least = max(LEAST, SHARE * sum(total["toxic"]) / 2)
    few = {r["entry"]: (np.array(r["toxic"]), np.array(r["clean"])) for r in counts.where((F.col("t") >= least) | F.col("entry").startswith("=")).collect()}
    few[""] = np.array(total["toxic"]), np.array(total["clean"])

    def weights_without(k: int | None) -> dict[str, float]:
        of = lambda a: int(a.sum() - (a[k] if k is not None else 0))
        left = {w: (of(a), of(b)) for w, (a, b) in few.items()}
        return weigh({w: c for w, c in left.items() if w}, *left[""])

    others = [weights_without(k) for k in range(FOLDS)]

    def make_features():
        matchers = [Matcher(w) for w in others]

        def work(batch):
            f = [features(x, matchers[k]) for x, k in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            return {c: [v[i] for v in f] for i, c in enumerate("abc")} | {"label": batch.column("label")}

        return work

    table = map_batches(rows, "a double, b double, c double, label int", make_features).toPandas().to_numpy()
    table = table[np.lexsort(table.T[::-1])]  # partitions set no order; at most `most` rows of four figures, sorted here
    return weights_without(None), [float(v) for v in fit_logistic(table[:, :3], table[:, 3])]


def toxicity(docs: DataFrame, weights: dict[str, float], coefficients: list[float], modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of every row of docs.

    Null and empty texts match nothing and get the score of that. A null doc_id is not held out. Repeated rows give a row
    each; other columns of docs are ignored; an empty table gives an empty result; a score that ties with 0.5 is predicted
    1. A text is matched whole, whatever its length.
    """

    def make():
        matcher, b = Matcher(weights), np.array(coefficients)

        def work(batch):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            x = np.array([features(t, matcher) for t in texts]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(x @ b[:3] + b[3], -30, 30)))
            return {"doc_id": batch.column("doc_id"), "score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist(), "n_hits": [len(matcher.hits(t)) if m else 0 for t, m in zip(texts, x[:, 2], strict=True)]}

        return work

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double, predicted int, n_hits int", make)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_hits")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole documents; edge cases as at learn() and toxicity()."""
    docs = documents(spark, sf_dir)
    return toxicity(docs, *learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
