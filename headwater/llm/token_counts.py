"""Token counts of texts under a BPE vocabulary with word ends (a ``tokenizers`` file).

Whole-token shortcut: which vocabulary strings come out of the merges alone as one token is proven
once, over the vocabulary. A pre-token in that table counts one and is never merged; only the
others are. Texts are cut at white space, which no pre-token spans, and what a piece between blanks
counts is kept for the next time it occurs.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm.common import map_batches, texts_of

# Pieces whose counts a Python worker keeps; beyond that it starts anew.
KEPT_PIECES = 200_000
# Words that go through the merges at one time; the library's answers are large.
MERGED_AT_ONCE = 2_000
# Python's split() also cuts at these four, which are not white space to the library.
SEPARATORS = regex.compile("[\x1c-\x1f]")
BLANKS = regex.compile(r"\p{White_Space}+")


def whole_tokens(spec: str) -> set[str]:
    """Pre-tokens (normalised text) that encode alone as exactly one token.

    Every vocabulary string with a word end is put back into text and run through the merges; it
    counts as proven only if the outcome is the one token it names.
    """
    model = json.loads(spec)["model"]
    end = model["end_of_word_suffix"]
    tokenizer = Tokenizer.from_str(spec)
    to_byte = {char: byte for byte, char in enumerate(byte_chars())}
    proven = set()
    for piece, number in model["vocab"].items():
        if not piece.endswith(end):
            continue
        try:
            text = bytes(to_byte[c] for c in piece[: -len(end)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if tokenizer.encode(text, add_special_tokens=False).ids == [number]:
            proven.add(text)
    return proven


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Counter:
    """Counts the tokens of texts; one per Python worker and vocabulary."""

    def __init__(self, spec: str, whole: Iterable[str]):
        parsed = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = frozenset(whole)
        pattern = next(p["pattern"]["Regex"] for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre_tokens = regex.compile(pattern).findall
        added = [t["content"] for t in parsed["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The normalised text cut at white space, and the special strings cut out of it before that."""
        special = 0
        parts = [text]
        if self.added is not None and "<" in text:
            parts = self.added.split(text)
            special = len(parts) - 1
        out: list[str] = []
        for part in parts:
            # Letter by letter: the library knows no final sigma.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += [p for p in BLANKS.split(part) if p] if SEPARATORS.search(part) else part.split()
        return out, special

    def learn(self, pieces: set[str]) -> None:
        """Count pieces not met before: table first, merges for the rest, all at once."""
        counts: dict[str, int] = {}
        rest: list[tuple[str, str]] = []
        for piece in pieces:
            n = 0
            for token in self.pre_tokens(piece):
                if token in self.whole:
                    n += 1
                else:
                    rest.append((piece, token))
            counts[piece] = n
        words = list({token for _, token in rest})
        # Every word is a pre-token already, so each stands alone here.
        merged: dict[str, int] = {}
        for start in range(0, len(words), MERGED_AT_ONCE):
            some = words[start : start + MERGED_AT_ONCE]
            merged.update((w, len(e)) for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))
        for piece, token in rest:
            counts[piece] += merged[token]
        self.known.update(counts)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        new = {p for p in set().union(*(p for p, _ in cut)) if p not in self.known}
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known.clear()
            new = set().union(*(p for p, _ in cut))
        self.learn(new)
        known = self.known
        return [sum(map(known.__getitem__, pieces)) + special for pieces, special in cut]


_counters: dict[int, Counter] = {}


def _counter(spec: str, whole: Iterable[str]) -> Counter:
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec, whole)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row, whole texts.

    Null or empty text: 0 bytes, 0 tokens. Rows are counted one by one, so null or repeated keys
    stay as they are; other columns, whatever their names, are not read. An empty table gives
    none. The vocabulary file is read on the driver (a few MB) and broadcast with its proven table.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        counts = _counter(*shared.value).count(texts)
        return pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sizes: Callable[[Column], Column] = lambda c: F.coalesce(F.octet_length(c).cast("bigint"), F.lit(0).cast("bigint"))
    rows = given.select(F.struct("key", sizes(F.col("text")).alias("n_bytes")).alias("key"), "text")
    counted = map_batches(rows, run, f"key struct<key:{kind},n_bytes:bigint>, n_tokens bigint")
    return counted.select(F.col("key.key").alias(key), F.col("key.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
