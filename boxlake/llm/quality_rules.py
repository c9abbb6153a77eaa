"""Quality rules: repetition and length, then the fertility of public tokenisers, with bands per script.

Every word is encoded on its own, with the space before it, by each vocabulary. A text's measures are characters per
token (the least of the vocabularies), the share of byte-fallback tokens and the entropy of its tokens in bits.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, as_bytes, documents, map_batches, trim
from .pieces import MEMO, model_path

SYMBOLS, BLANK, WINDOW = b"#*$%&|<>", b" \t\n\r\x0b\x0c", 8
NON_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
#: Script of a text: that of most of its letters, by ranges of code points.
SCRIPTS = {"latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF),), "cyrillic": ((0x400, 0x52F),), "arabic": ((0x600, 0x6FF),), "devanagari": ((0x900, 0x97F),), "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))}
#: Per script: least and most characters a token, most share of byte tokens, least entropy (bits) and of how many tokens;
#: fewer tokens can't have as much entropy, so least_entropy() falls with their number's logarithm.
#: latin lies just outside the labelled clean rows of sf0.1 (1.64 and 4.94 at the least); the others just outside a passage each.
BANDS = {"latin": (1.63, 5.5, 0.1, 4.8, 60), "vietnamese": (0.75, 5.5, 0.15, 4.8, 60), "greek": (0.6, 3.0, 0.1, 4.0, 60), "cyrillic": (0.65, 4.0, 0.1, 4.5, 60), "arabic": (0.6, 3.0, 0.1, 4.0, 60), "devanagari": (0.42, 2.5, 0.2, 4.0, 60), "cjk": (0.28, 2.5, 0.4, 4.5, 60), "other": (0.28, 3.0, 0.7, 3.6, 60), "none": (2.0, 5.5, 0.1, 4.0, 60)}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_token double, byte_share double, token_entropy double, base_failed boolean, kept boolean"


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of width words that the text has twice or more."""
    if len(words) < width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    start = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    step = np.zeros(len(words) + 1, np.int64)
    step[:-width] += start
    step[width:] -= start
    return int((np.cumsum(step)[:-1] > 0).sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def script_of(sample: Counter) -> str:
    """Of characters counted; letters and marks of no listed range are 'other', a text without letters is 'none'."""
    seen: Counter = Counter()
    for ch, n in sample.items():
        if ch.isalpha():
            seen[next((s for s, ranges in SCRIPTS.items() if any(a <= ord(ch) <= b for a, b in ranges)), "other")] += n
    found = max(sorted(seen), key=seen.get) if seen else "none"
    toned = sum(n for ch, n in sample.items() if 0x1EA0 <= ord(ch) <= 0x1EF9)  # letters that hardly any other language has
    return "vietnamese" if found == "latin" and 20 * toned > seen["latin"] else found


def rank_paths() -> tuple[str, ...]:
    import public_tokenizers

    return tuple(public_tokenizers.path(f"{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k"))


class Fertility:
    """Tokens of single words for the piece vocabulary at path and byte-level ones (rank files; None: rank_paths()).

    learn() encodes the words of a batch that are not yet known, all at once; measure() then only looks up and sums.
    """

    def __init__(self, path: str, ranks: tuple[str, ...] | None = None) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.others = []
        for p in rank_paths() if ranks is None else ranks:
            import public_tokenizers
            import tiktoken

            with open(p, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            begins = np.zeros(max(table.values()) + 1, bool)
            begins[[i for t, i in table.items() if t.startswith(b" ")]] = True
            self.others.append((tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary, begins))
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.counts = np.empty((len(self.others), 0), np.int64)

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.index) > MEMO or len(self.flat) > 8 * MEMO:
            self.forget()
        new = list(set().union(*texts).difference(self.index))
        if not new:
            return
        said = [w.decode(errors="replace") for w in new]
        ids = self.pieces.encode(said)
        plain = [i for i, w in enumerate(said) if w.isascii() or w == "".join(w.split())]  # no blank of any kind in it
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.counts = np.concatenate([self.counts, [self.token_counts(said, plain, *o) for o in self.others]], axis=1) if self.others else np.empty((0, len(self.at) - 1), np.int64)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))

    @staticmethod
    def token_counts(words: list[str], plain: list[int], encode: Callable[[str], list[int]], begins: np.ndarray) -> np.ndarray:
        """Tokens of each word with a space before it. Plain words are encoded in one go: a token that starts with a space starts a word."""
        out = np.empty(len(words), np.int64)
        for i in set(range(len(words))).difference(plain) if len(plain) < len(words) else ():
            out[i] = len(encode(" " + words[i]))
        if plain:
            first = np.flatnonzero(begins[np.array(tokens := encode(" " + " ".join([words[i] for i in plain])))])
            out[plain] = np.diff(np.r_[first, len(tokens)])
        return out

    def measure(self, words: list[bytes], chars: int) -> tuple[float, float, float, int]:
        """Least characters per token, share of byte tokens, entropy of the tokens, number of tokens; for words learnt."""
        if not words:
            return 0.0, 0.0, 0.0, 0
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        start = self.at[which]
        count = self.at[which + 1] - start
        total = int(count.sum())
        tokens = self.flat[np.repeat(start - np.cumsum(count) + count, count) + np.arange(total)]
        often = np.unique(tokens, return_counts=True)[1]
        entropy = math.log2(total) - float(often @ np.log2(often)) / total
        return chars / max(total, *self.counts[:, which].sum(axis=1).tolist()), int(self.is_byte[tokens].sum()) / total, max(entropy, 0.0), total


def least_entropy(bits: float, tokens: int, total: int) -> float:
    """The bound for a text of total tokens: bits from that many tokens on, below in proportion to the most that total tokens can have."""
    return bits * min(1.0, math.log2(max(total, 1)) / math.log2(tokens))


@lru_cache(2)
def fertility_of(path: str, ranks: tuple[str, ...]) -> Fertility:
    """One for all tasks of a Python worker: vocabularies are read, and known words encoded, once."""
    return Fertility(path, ranks)


def assess(texts: list[bytes], fertility: Fertility, bands: dict[str, tuple[float, ...]]) -> list[tuple]:
    split = [t.split() for t in texts]
    fertility.learn(split)
    return [_assess(t, words, fertility, bands) for t, words in zip(texts, split, strict=True)]


def _assess(text: bytes, words: list[bytes], fertility: Fertility, bands: dict[str, tuple[float, ...]]) -> tuple:
    n, repeated = len(words), repeat_words(words)
    chars = len(text.decode(errors="replace")) - (len(text) - len(text.translate(None, BLANK)))
    failed = n < 20 or 100 * repeated > 30 * n
    script = "latin" if text.isascii() and text.lower() != text.upper() else script_of(Counter(text.decode(errors="replace")))
    per_token, byte_share, entropy, total = fertility.measure(words, chars)
    least, most, bytes_most, bits, tokens = bands.get(script, bands["other"])
    kept = not failed and least <= per_token <= most and byte_share <= bytes_most and entropy >= least_entropy(bits, tokens, total)
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), dup_lines(text), repeated, script, per_token, byte_share, entropy, failed, kept


def quality_rules(docs: DataFrame, path: str, ranks: tuple[str, ...] | None = None, bands: dict[str, tuple[float, ...]] = BANDS) -> DataFrame:
    """Measures and verdict of every row of docs, in the columns of SCHEMA; no shuffle.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of 8 words. kept: not base_failed and
    within the script's band, its ends included. A null or empty text has no words and fails. Repeated rows and null
    doc_ids each give their row; other columns of docs are ignored; an empty table gives an empty result. A text is
    measured whole, whatever its length, with a number a word and a token.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    ranks = rank_paths() if ranks is None else ranks

    def make():
        fertility = fertility_of(path, ranks)

        def work(batch):
            rows = assess(as_bytes(batch, "text"), fertility, bands)
            return {"doc_id": batch.column("doc_id")} | dict(zip(names[1:], map(list, zip(*rows, strict=True)) if rows else [[] for _ in names[1:]], strict=True))

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, make)


def keep_good(docs: DataFrame, path: str, ranks: tuple[str, ...] | None = None, bands: dict[str, tuple[float, ...]] = BANDS) -> DataFrame:
    """The rows of docs (with all their columns) that the rules keep; texts don't leave their task, which forgets its words.

    Null and empty texts go; repeated rows stay or go together; an empty table stays one. No column name is reserved.
    """
    import pyarrow as pa

    if "text" not in docs.columns:
        raise ValueError("docs needs a column text")

    ranks = rank_paths() if ranks is None else ranks

    def run(batches):
        fertility = fertility_of(path, ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                yield part.filter(pa.array([row[-1] for row in assess(as_bytes(part, "text"), fertility, bands)], pa.bool_()))
        fertility.forget()
        trim()

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on whole documents; edge cases as at quality_rules()."""
    return quality_rules(documents(spark, sf_dir), model_path())
