"""SentencePiece encoding and decoding for models of type BPE, by a table of each prefix's last token.

The encoding of any prefix of a text ends in one token only. Going up the prefixes, an automaton gives all pieces that
end there; that piece is the last token whose pair with the last token of what stands before it is compatible, which
means that merging the two pieces' text alone gives the pair back. Ids are then read backwards from the end.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, trim

SPACE = "▁"
#: Segments that a generation of the table of results may hold (there are two), and the longest segment it holds.
MEMO, LONGEST = 150_000, 64


class PieceCodec:
    """Encodes and decodes as the library does for the model at path; models with other options are refused."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.normal, self.bytes, self.control = kinds.NORMAL, kinds.BYTE, kinds.CONTROL
        self.score = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.unknown_id = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        # Per piece: its length, its id, and whether the piece of an id (-1: none) may stand before it, as far as asked.
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.score.items():
            self.automaton.add_word(piece, (len(piece), i, {}))
        self.automaton.make_automaton()
        self.chars = {p for p in self.score if len(p) == 1}
        self.lengths = [len(p) for p in self.names]
        self.n_pairs = 0
        self.rare = {i for i, k in enumerate(self.kinds) if k != kinds.NORMAL}
        # No merge crosses a place that no piece spans: before a space that follows another character, around a line end.
        spans = any(SPACE in p.lstrip(SPACE) for p in self.score)
        line = "\n" if not any("\n" in p for p in self.score) else ""
        self.parts = re.compile(f"{line}|{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" if line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if not spans else lambda s: [s]
        self.memo = MEMO
        self.known: dict[str, tuple[list[int], str, str]] = {}
        self.older: dict[str, tuple[list[int], str, str]] = {}

    def forget(self) -> None:
        """Drops the results that are kept of segments and of pairs."""
        self.known, self.older, self.n_pairs = {}, {}, 0
        for _, _, table in self.automaton.values():
            table.clear()

    def merged(self, text: str) -> list[str]:
        """Plain merging: the pair of best score, the leftmost of equals, until none is a piece. For short texts."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((s[0], -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1]))), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: int, piece: int, asked: dict[int, bool]) -> bool:
        """Whether merging keeps the two pieces as they are; before -1 asks it of piece alone."""
        pair = [self.names[before]] * (before >= 0) + [self.names[piece]]
        self.n_pairs += 1
        if self.n_pairs > 10 * MEMO:
            for _, _, table in self.automaton.values():
                table.clear()
            self.n_pairs = 0
        found = asked[before] = self.merged("".join(pair)) == pair
        return found

    def tokens(self, text: str) -> list[int]:
        """Ids of an escaped text all of whose characters are pieces."""
        last = [-1] + [-2] * len(text)
        for end, (length, piece, asked) in self.automaton.iter(text):
            end += 1
            if last[end] == -2 and (before := last[end - length]) != -2:
                ok = asked.get(before)
                if self.fits(before, piece, asked) if ok is None else ok:
                    last[end] = piece
        out, i, lengths = [], len(text), self.lengths
        while i:
            out.append(t := last[i])
            i -= lengths[t]
        out.reverse()
        return out

    def ids_of(self, text: str) -> list[int]:
        """Ids of any escaped text. Characters that are no piece merge with nothing: they become bytes and part the rest."""
        if self.chars.issuperset(text):
            return self.tokens(text)
        out: list[int] = []
        start = 0
        for i, ch in enumerate(text + "\0"):
            if ch not in self.chars or i == len(text):
                out += self.tokens(text[start:i])
                if i < len(text):
                    out += [self.byte_id[b] for b in ch.encode()]
                start = i + 1
        return out

    def segment(self, s: str) -> tuple[list[int], str, str]:
        """ids, the ids as text, and the decoded text of a part of an escaped text. The last `memo` parts or more are kept."""
        found = self.older.get(s)
        if found is None:
            ids = self.ids_of(s)
            found = ids, " ".join(map(str, ids)), self.surface(ids)
        if len(s) <= LONGEST:
            if len(self.known) >= self.memo:
                self.known, self.older = {}, self.known
            self.known[s] = found
        return found

    def segments(self, text: str) -> list[tuple[list[int], str, str]]:
        segment, out = self.segment, []
        known = self.known
        for s in self.parts(self.escaped(text)):
            found = known.get(s)
            if found is None:
                found = segment(s)
                known = self.known
            out.append(found)
        return out

    @staticmethod
    def escaped(text: str) -> str:
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def surface(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become U+FFFD each."""
        if not self.rare.intersection(ids):
            return "".join([self.names[i] for i in ids]).replace(SPACE, " ")
        out, held = [], bytearray()

        def flush() -> None:
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + "�")
                    del held[: e.start + 1]

        for i in ids:
            if self.kinds[i] == self.bytes:
                held.append(int(self.names[i][3:5], 16))
                continue
            flush()
            if self.kinds[i] == self.normal:
                out.append(self.names[i].replace(SPACE, " "))
            elif i == self.unknown_id:
                out.append(" ⁇ ")
        flush()
        return "".join(out)

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [i for ids, _, _ in self.segments(text) for i in ids] + [self.end_id] * end

    def decode(self, ids: list[int]) -> str:
        ids = [i for i in ids if self.kinds[i] != self.control]
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") and ids and self.kinds[ids[0]] == self.normal else text


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a process and path."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int, with the end id) and decoded of every row; null texts count as empty.

    Repeated rows and null doc_ids each give their row; other columns are ignored; an empty table gives an empty result.
    """

    def make():
        def work(batch):
            c = codec(path)
            ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [c.decode(x) for x in ids]}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, ids array<int>, decoded string", make)


def encoding_digests(docs: DataFrame, path: str, keep_ids: bool = False, memo: int = MEMO, forget: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, and ids (array of int) if asked.

    Ids end with the end id. Null and empty texts have that id only and decode to nothing. Repeated rows and null
    doc_ids each give their row; other columns are ignored; an empty table gives an empty result. Texts are encoded
    whole, one at a time. Digests are made where the ids are, which then needn't move; a text that equals the one before
    it (copies of a mix follow each other) is not encoded again. memo: segments whose results are kept at least; forget:
    they go after each task, for jobs whose other stages share the workers.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def make():
        codec(path).memo = memo

        def work(batch):
            c, rows, last = codec(path), [], None
            end = str(c.end_id)
            for text in batch.column("text").to_pylist():
                if not rows or text != last:
                    parts, last = c.segments(text or ""), text
                    decoded = "".join([p[2] for p in parts])
                    # The dummy prefix goes again, as decode() does it.
                    decoded = decoded[1:] if parts and decoded[:1] == " " else decoded
                    said = " ".join([p[1] for p in parts] + [end])
                    row = [sum(len(p[0]) for p in parts) + 1, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    row += [[*chain.from_iterable([p[0] for p in parts]), c.end_id]] * keep_ids
                rows.append(row)
            return {"doc_id": batch.column("doc_id")} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, make, after=(lambda: (codec(path).forget(), trim())) if forget else None)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts of whole documents; edge cases as at encoding_digests()."""
    return encoding_digests(documents(spark, sf_dir), model_path())
