"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (dummy prefix, extra blanks,
blank to its mark), the pieces with byte fallback for characters that no piece spells, and, for BPE
models, one that reads adjacent pieces. Each input is composed with them, and the path of least
weight in the tropical semiring (add along a path, least over paths) is its encoding.

- Unigram models: a piece weighs minus its score; any piece may follow any.
- BPE models: pieces weigh nothing, and a pair of neighbours weighs nothing if merging their joint
  text gives back just these two, else infinity. A sequence whose neighbours all stand is the one
  that the merges give, so there is one path of finite weight, and it equals the merge result.

A text is cut where no piece can reach across, and what a cut encodes to is kept for its next
occurrence, so most of a corpus is looked up.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import map_batches, texts_of

MARK = "▁"  # stands for a blank in pieces
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
# Cuts and pairs that a Python worker keeps; beyond that it starts anew.
KEPT_CUTS = 400_000
KEPT_PAIRS = 500_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of one message in the protocol-buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + size]
        at += size


class Transducer:
    """The compiled model. Supports models without a character map and without user-defined pieces."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze = True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                normaliser = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
                if normaliser.get(2) or not normaliser.get(5, 1):
                    raise ValueError("models with a character map or with plain blanks are not supported")
        if self.kind not in (UNIGRAM, BPE) or not {*self.kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        # Arcs of the piece transducer.
        self.weights = dict.fromkeys(self.ids, 0.0) if self.kind == BPE else {p: -s for p, s in self.scores.items()}
        self.fallback = 0.0 if self.kind == BPE else UNKNOWN_PENALTY - min(self.scores.values(), default=0.0)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.cuts: dict[str, tuple[int, ...]] = {}
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.cut = re.compile(self._cuts()).findall
        self.spelt = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _cuts(self) -> str:
        """A pattern for stretches that no piece reaches across.

        A stretch ends where a mark follows another character, before punctuation that follows
        something else, and around line ends and tabs, each unless some piece of this model has
        that inside.
        """
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return r"[\s\S]+"
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        opening, before = None, {c for p in self.ids for c in p if c != MARK and not c.isalpha() and not c.isdecimal()}
        while before != opening:
            opening = before
            before = opening - {p[k] for p in self.ids for k in range(1, len(p)) if p[k - 1] != MARK and p[k - 1] not in opening}
        # Only plain punctuation cuts, so that the pattern stays fast.
        points = re.escape("".join(sorted(c for c in opening if c.isascii())))
        like_points = re.escape("".join(sorted(c for c in opening if re.match(r"[^\W_]", c))))
        pattern = f"{MARK}*[^{MARK}{alone}]+|{MARK}+"
        if points:
            behind = f"(?<![{like_points}])" if like_points else ""
            pattern = f"{MARK}*[{points}]*[^\\W_]+{behind}(?=[{points}])|{pattern}"
        return pattern + (f"|[{alone}]" if alone else "")

    def normalise(self, text: str) -> str:
        """The first transducer: blanks squeezed if the model says so, prefix, marks."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = f" {text}"
        return text.replace(" ", MARK)

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is left."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _stands(self, left: str, right: str) -> bool:
        """The third transducer: may ``right`` follow ``left``? (BPE)"""
        if self.n_pairs >= KEPT_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        stands = self.merge(left + right) == [left, right]
        self.pairs.setdefault(left, {})[right] = stands
        return stands

    def shortest_path(self, text: str) -> list[str]:
        """Pieces of the path of least weight through the composition with ``text``, a cut."""
        return self._lightest(text) if self.kind == UNIGRAM else self._standing(text)

    def _lightest(self, text: str) -> list[str]:
        size, weights, starts = len(text), self.weights, self.starts
        weight = [0.0] + [float("inf")] * size
        before = [0] * (size + 1)
        for i in range(size):
            for j in range(i + 1, size + 1):
                piece = text[i:j]
                step = weights.get(piece)
                if step is None and j == i + 1:
                    step = self.fallback
                if step is not None and weight[i] + step < weight[j]:
                    weight[j], before[j] = weight[i] + step, i
                if piece not in starts:
                    break
        out, at = [], size
        while at:
            out.append(text[before[at] : at])
            at = before[at]
        return out[::-1]

    def _standing(self, text: str) -> list[str]:
        """With pair weights of nothing or infinity: the first path that reaches a position is the only finite one."""
        size, weights, starts, pairs = len(text), self.weights, self.starts, self.pairs
        last: list[str | None] = [""] + [None] * size
        for i in range(size):
            state = last[i]
            known = pairs.get(state, {}) if state else None
            for j in range(i + 1, size + 1):
                piece = text[i:j]
                if last[j] is None and (piece in weights or j == i + 1):
                    if known is None:
                        last[j] = piece
                    else:
                        stands = known.get(piece)
                        if self._stands(state, piece) if stands is None else stands:
                            last[j] = piece
                if piece not in starts:
                    break
        out, at = [], size
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _cut_ids(self, cut: str) -> tuple[int, ...]:
        found: list[int] = []
        for piece in self.shortest_path(cut):
            number = self.ids.get(piece)
            if number is not None:
                found.append(number)
            elif self.byte_fallback:
                found += [self.byte_ids[b] for b in piece.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        if len(self.cuts) >= KEPT_CUTS:
            self.cuts.clear()
        self.cuts[cut] = tuple(found)
        return self.cuts[cut]

    def encode(self, text: str) -> np.ndarray:
        known = self.cuts
        parts = [known.get(c) or self._cut_ids(c) for c in self.cut(self.normalise(text))]
        return np.fromiter(chain.from_iterable(parts), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement mark. Unknown numbers raise."""
        text = b"".join([self.spelt[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    key = hash(model)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def _shared_model(df: DataFrame, model_path: str):
    with open(model_path, "rb") as file:
        model = file.read()
    Transducer(model)  # says on the driver what is not supported
    return df.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_pieces, round_trip, ids)`` of every row: whole texts, one row per given row.

    ``round_trip``: decoding gives the text back, as the model's normaliser leaves it. Null or
    empty text: no ids, true. Rows are encoded one by one, so null or repeated keys stay as they
    are; other columns, whatever their names, are not read. An empty table gives none. The model
    file (below 1 MB) is read on the driver and broadcast.
    """
    shared = _shared_model(docs, model_path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _transducer(shared.value)
        texts = texts_of(batch.column(1))
        found = [model.encode(t) for t in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        back = [model.decode(ids.tolist()) == plain(model, t) for ids, t in zip(found, texts, strict=True)]
        flat = np.concatenate(found) if found else np.empty(0, np.int32)
        return pa.record_batch([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(back), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "n_pieces", "round_trip", "ids"])

    encoded = map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, n_pieces bigint, round_trip boolean, ids array<int>")
    return encoded.withColumnRenamed("key", key)


def plain(model: Transducer, text: str) -> str:
    """What decoding must give back: the normalised text with its marks as blanks and no prefix."""
    text = model.normalise(text).replace(MARK, " ")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of every row of ids. Null ids give the empty text."""
    shared = _shared_model(encoded, model_path)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _transducer(shared.value)
        return pa.record_batch([batch.column(0), pa.array([model.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["key", "text"])

    given = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return map_batches(given, run, f"key {kind}, text string").withColumnRenamed("key", key)
