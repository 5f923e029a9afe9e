"""Alignment of two tokenizers over the same bytes, from fragments that compose.

Where tokens of both tokenizers end at one byte, a group ends. A byte range of a text gives a fragment: its
tokens, and the ends that both have inside it. What lies before the first common end is the open prefix,
what lies after the last one the open suffix, the rest are closed groups. Two neighbouring fragments
compose into one: the left suffix and the right prefix are matched with each other, everything else
stays. This is associative, with the empty fragment as its one, so a very long document is cut into
ranges, its ranges are encoded by any tasks, and a tree of compositions gives its groups.

Each tokenizer is cut where itself never joins across, so the ranges of the two need not end at the
same byte; the open ends take that up.

A group links every token of the one with every token of the other. Links are kept as counts of
distinct pairs per document; a pack of documents holds its distinct pairs once, so what is shuffled
to count pairs over the corpus, and to hand the counts back, grows with packs and not with tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headwater.llm.common import Scratch, byte_slices, ship_package, texts_of
from headwater.session import shuffle_width

RANGE = 1 << 16  # characters of a range; a longer text is cut
PACK = 1 << 20  # bytes of texts that are aligned together
FAN = 8  # neighbouring fragments that one step of the tree composes
WIDE = 1 << 12  # links of a group beyond which its distinct ids are paired instead of its tokens
MARK = "▁"  # stands for a blank in sentencepiece
# Fixed value: how byte-level BPE files of the common kind cut a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Where the pattern always cuts, whatever stands around.
CUT_BYTES = re.compile(r"(?<=\S) |(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
CUT_PIECES = re.compile(r"(?<=[^ ]) (?=[\s\S])")  # the library gives a lone blank no piece


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level files: itself if it is seen, else the next one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """A byte-level BPE of a ``tokenizers`` file. ``bytes[id]`` are a token's bytes.

    If every entry encodes alone as itself, merging the neighbours of least rank gives what the file's
    merges give, and the faster library does it; very long unbroken texts, and other files, are left to
    the file's own library.
    """

    def __init__(self, spec: bytes):
        said = json.loads(spec)
        cut = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or said["model"].get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(not t["special"] for t in said.get("added_tokens", [])):
            raise ValueError("files with added tokens that are not special are not supported")
        letters = _byte_letters()
        vocabulary = said["model"]["vocab"]
        added = {t["id"]: t["content"] for t in said.get("added_tokens", [])}
        self.bytes = [b""] * (max([*vocabulary.values(), *added]) + 1)
        for entry, number in vocabulary.items():
            self.bytes[number] = bytes(letters[c] for c in entry) if number not in added else added[number].encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.own = Tokenizer.from_str(spec.decode())
        self.own.encode_special_tokens = True
        plain = {e: n for e, n in vocabulary.items() if n not in added}
        alone = self.own.model
        if all([t.id for t in alone.tokenize(e)] == [n] for e, n in plain.items()) and sorted(plain.values()) == list(range(len(plain))):
            self.fast = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks={self.bytes[n]: n for n in plain.values()}, special_tokens={})
        else:
            self.fast = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, np.int32) for e in self.own.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int32) if len(t) <= 4 * RANGE else np.array(self.own.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]


class PieceTokens:
    """A sentencepiece model that puts a blank before each text. Texts are given with that blank."""

    def __init__(self, model: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.own.get_piece_size()
        pieces = [self.own.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.own.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        if not self.own.encode("x", out_type=str)[0].startswith(MARK):
            raise ValueError("only models that put a blank before the text are supported")
        self.cut = None if any(MARK in p.lstrip(MARK) for p in pieces) else CUT_PIECES

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.own.encode([t[1:] for t in texts], num_threads=1)]


@dataclass
class Pair:
    """Both tokenizers, made once per worker from the bytes of their files."""

    a: ByteTokens
    b: PieceTokens


_pairs: dict[tuple[int, int], Pair] = {}


def _pair(files: tuple[bytes, bytes]) -> Pair:
    key = (hash(files[0]), hash(files[1]))
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(ByteTokens(files[0]), PieceTokens(files[1]))
    return _pairs[key]


@dataclass
class Fragment:
    """Tokens of a range, how many of each stand up to each common end, and where the range starts and last closes."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    a_from: int
    b_from: int
    last: int = -1
    whole: bool = True  # the tokens' bytes are those of the text


NONE = np.empty(0, np.int64)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each stand up to each byte at which both end; ends rise strictly."""
    if not len(ends_a) or not len(ends_b):
        return NONE, NONE
    at = np.searchsorted(ends_b, ends_a)
    same = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a
    return np.flatnonzero(same) + 1, at[same] + 1


def fragment(pair: Pair, a: np.ndarray, b: np.ndarray, a_from: int, b_from: int, whole: bool = True) -> Fragment:
    ends_a, ends_b = a_from + np.cumsum(pair.a.lengths[a]), b_from + np.cumsum(pair.b.lengths[b])
    cut_a, cut_b = common_ends(ends_a, ends_b)
    return Fragment(a, b, cut_a, cut_b, a_from, b_from, int(ends_a[cut_a[-1] - 1]) if len(cut_a) else -1, whole)


def compose(pair: Pair, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    keep_a, keep_b = (int(left.cut_a[-1]), int(left.cut_b[-1])) if len(left.cut_a) else (0, 0)
    stop_a, stop_b = (int(right.cut_a[0]), int(right.cut_b[0])) if len(right.cut_a) else (len(right.a), len(right.b))
    open_a, open_b = np.concatenate([left.a[keep_a:], right.a[:stop_a]]), np.concatenate([left.b[keep_b:], right.b[:stop_b]])
    closed = len(left.cut_a) > 0
    # The right side's first common end, if it has one, is the last one met here.
    met = fragment(pair, open_a, open_b, left.last if closed else left.a_from, left.last if closed else left.b_from)
    return Fragment(
        np.concatenate([left.a, right.a]),
        np.concatenate([left.b, right.b]),
        np.concatenate([left.cut_a, keep_a + met.cut_a, len(left.a) + right.cut_a[1:]]),
        np.concatenate([left.cut_b, keep_b + met.cut_b, len(left.b) + right.cut_b[1:]]),
        left.a_from,
        left.b_from,
        max(left.last, met.last, right.last),
        left.whole and right.whole,
    )


def ranges(pair: Pair, text: str, size: int | None = None) -> Iterator[tuple[int, int, str, str]]:
    """``(a_from, b_from, a_text, b_text)`` of each range of a text, offsets in bytes. The blank before the text is part of the first."""
    size = size or RANGE
    text = f" {text}"
    a = b = a_from = b_from = 0
    for nominal in [*range(size, len(text), size), None]:
        ends = []
        for pattern, at in ((CUT_BYTES, a), (pair.b.cut, b)):
            if nominal is None or pattern is None:
                ends.append(len(text) if nominal is None else at)
            elif at >= nominal:
                ends.append(at)
            else:
                found = pattern.search(text, nominal)
                ends.append(found.start() if found else len(text))
        a_text, b_text = text[a : ends[0]], text[b : ends[1]]
        if a_text or b_text:
            yield a_from, b_from, a_text, b_text
        a, b = ends
        a_from, b_from = a_from + len(a_text.encode()), b_from + len(b_text.encode())


def spelt(tokens: ByteTokens | PieceTokens, ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.bytes.__getitem__, ids.tolist()))


def range_fragment(pair: Pair, a_from: int, b_from: int, a_text: str, b_text: str) -> Fragment:
    a = pair.a.encode([a_text])[0] if a_text else np.empty(0, np.int32)
    b = pair.b.encode([b_text])[0] if b_text else np.empty(0, np.int32)
    return fragment(pair, a, b, a_from, b_from, spelt(pair.a, a) == a_text.encode() and spelt(pair.b, b) == b_text.encode())


@dataclass
class Groups:
    """Aligned documents one after the other: their tokens, common ends, and how many tokens and groups each has."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray


def align_texts(pair: Pair, texts: list[str]) -> Groups:
    """Texts that are aligned at once: every text ends in a common end, so one matching does for all. Texts that do not come back have no tokens."""
    blank = [f" {t}" for t in texts]
    empty = np.empty(0, np.int32)
    full = [i for i, t in enumerate(texts) if t]
    found_a, found_b = [empty] * len(texts), [empty] * len(texts)
    for i, a, b in zip(full, pair.a.encode([blank[i] for i in full]), pair.b.encode([blank[i] for i in full]), strict=True):
        raw = blank[i].encode()
        if spelt(pair.a, a) == raw and spelt(pair.b, b) == raw:
            found_a[i], found_b[i] = a, b
    return joined([Fragment(a, b, NONE, NONE, 0, 0) for a, b in zip(found_a, found_b, strict=True)], pair)


def joined(parts: list[Fragment], pair: Pair | None = None) -> Groups:
    """Documents' fragments as one; with ``pair`` their common ends are found first, for all together."""
    n_a, n_b = (np.array([len(getattr(p, s)) for p in parts], np.int64) for s in "ab")
    a, b = (np.concatenate([getattr(p, s) for p in parts]) if parts else np.empty(0, np.int32) for s in "ab")
    if pair:
        cut_a, cut_b = common_ends(np.cumsum(pair.a.lengths[a]), np.cumsum(pair.b.lengths[b]))
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(cut_a, np.cumsum(n_a), "right")]))
        return Groups(a, b, cut_a, cut_b, n_a, n_b, n_groups)
    cut_a = np.concatenate([s + p.cut_a for s, p in zip(np.cumsum(n_a) - n_a, parts, strict=True)]) if parts else NONE
    cut_b = np.concatenate([s + p.cut_b for s, p in zip(np.cumsum(n_b) - n_b, parts, strict=True)]) if parts else NONE
    return Groups(a, b, cut_a, cut_b, n_a, n_b, np.array([len(p.cut_a) for p in parts], np.int64))


def written_groups(of: Groups, names: list[bytes]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: ids in order, groups in order. ``names[id]`` is a number's text."""
    if not len(of.a):
        return [b""] * len(of.n_a)
    sign_a, sign_b = np.zeros(len(of.a), np.int64), np.zeros(len(of.b), np.int64)
    sign_a[of.cut_a - 1], sign_b[of.cut_b - 1] = 1, 2
    # Both streams in one order: by group, the first tokenizer's tokens before the other's.
    group_a = np.repeat(np.arange(len(of.cut_a)), np.diff(np.concatenate([[0], of.cut_a])))
    group_b = np.repeat(np.arange(len(of.cut_b)), np.diff(np.concatenate([[0], of.cut_b])))
    place_a = np.arange(len(of.a)) + np.concatenate([[0], of.cut_b])[group_a]
    place_b = np.arange(len(of.b)) + of.cut_a[group_b]
    coded = np.empty(len(of.a) + len(of.b), np.int64)
    coded[place_a], coded[place_b] = 3 * of.a.astype(np.int64) + sign_a, 3 * of.b.astype(np.int64) + sign_b
    ends = np.cumsum(of.n_a + of.n_b)
    return [b"".join(map(names.__getitem__, coded[e - n : e].tolist()))[:-1] for e, n in zip(ends.tolist(), (of.n_a + of.n_b).tolist(), strict=True)]


def id_names(size: int) -> list[bytes]:
    """For each id its number followed by a comma, a bar and a semicolon."""
    return [f"{i}{sign}".encode() for i in range(size) for sign in ",|;"]


def linked(of: Groups, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (``a * width + b``) and number of links of each distinct pair of each document, sorted; links of groups all to all."""
    size_a, size_b = (np.diff(np.concatenate([[0], c])) for c in (of.cut_a, of.cut_b))
    links = size_a * size_b
    doc = np.repeat(np.arange(len(of.n_a)), of.n_groups)
    plain = np.flatnonzero(links <= WIDE)
    each = links[plain]
    group = np.repeat(plain, each)
    within = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
    pairs = of.a[(of.cut_a - size_a)[group] + within // size_b[group]].astype(np.int64) * width + of.b[(of.cut_b - size_b)[group] + within % size_b[group]]
    docs, counts = doc[group], None
    wide = np.flatnonzero(links > WIDE)
    if len(wide):
        more = [(docs, pairs, np.ones(len(pairs), np.int64))]
        for g in wide:
            ids_a, times_a = np.unique(of.a[of.cut_a[g] - size_a[g] : of.cut_a[g]], return_counts=True)
            ids_b, times_b = np.unique(of.b[of.cut_b[g] - size_b[g] : of.cut_b[g]], return_counts=True)
            made = (ids_a.astype(np.int64)[:, None] * width + ids_b[None, :]).ravel()
            more.append((np.full(len(made), doc[g]), made, (times_a[:, None] * times_b[None, :]).ravel()))
        docs, pairs, counts = (np.concatenate(c) for c in zip(*more, strict=True))
    order = np.lexsort((pairs, docs))
    docs, pairs = docs[order], pairs[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(pairs) != 0)])) if len(docs) else NONE
    times = np.diff(np.concatenate([starts, [len(docs)]])) if counts is None else np.add.reduceat(counts[order], starts)
    return docs[starts], pairs[starts], times


PACKED = (
    "rec bigint, keys array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, "
    "pairs array<bigint>, docs array<bigint>, ends array<bigint>, places binary, times binary"
)
CUT = "chunk int, key {kind}, a_from bigint, b_from bigint, a_text string, b_text string"


def _packed(pair: Pair, names: list[bytes], rec: int, keys: pa.Array, of: Groups) -> list[pa.Array]:
    """One row for a pack of documents: what each has, its distinct pairs once, and per document where its pairs stand among them."""
    docs, pairs, times = linked(of, len(pair.b.bytes))
    distinct, places = np.unique(pairs, return_inverse=True)
    n = len(of.n_a)
    size_a, size_b = (np.diff(np.concatenate([[0], c])) for c in (of.cut_a, of.cut_b))
    sums = np.concatenate([[0], np.cumsum(size_a * size_b)])
    last = np.cumsum(of.n_groups)
    digests = [hashlib.sha256(t).hexdigest() if t else "" for t in written_groups(of, names)]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int64)))
    many = [of.n_a, of.n_b, of.n_groups, sums[last] - sums[last - of.n_groups]]
    return [
        pa.array([rec], pa.int64()),
        pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys),
        *map(one, many),
        pa.array([digests], pa.list_(pa.string())),
        one(distinct),
        one(np.bincount(places, minlength=len(distinct))),
        one(np.cumsum(np.bincount(docs, minlength=n))),
        pa.array([places.astype(np.int32).tobytes()], pa.binary()),
        pa.array([times.astype(np.int64).tobytes()], pa.binary()),
    ]


class _Worker:
    """The pair and the names of ids, made when a task first needs them."""

    def __init__(self, shared):
        self.pair = _pair(shared.value)
        self.names = id_names(max(len(self.pair.a.bytes), len(self.pair.b.bytes)))


def _schema_names(schema: str) -> list[str]:
    return [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]


def _first_pass(docs: DataFrame, shared, key: str, text: str) -> DataFrame:
    """Packs of the texts that are no longer than a range, and the ranges of the others, stored together."""
    given = docs.select(F.monotonically_increasing_id().alias("rec"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    schema = f"{PACKED.format(kind=kind)}, {CUT.format(kind=kind)}"
    names, n_packed = _schema_names(schema), len(_schema_names(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(shared)
        for batch in batches:
            for part in byte_slices(batch, 2, PACK):
                texts, recs = texts_of(part.column(2)), part.column(0).to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= RANGE]
                keys = part.column(1).take(pa.array(short, pa.int64()))
                if short:
                    made = _packed(worker.pair, worker.names, recs[short[0]], keys, align_texts(worker.pair, [texts[i] for i in short]))
                    cut = [pa.nulls(1, t) for t in (pa.int32(), keys.type, pa.int64(), pa.int64(), pa.string(), pa.string())]
                    yield pa.record_batch([*made, *cut], names)
                for i in set(range(len(texts))).difference(short):
                    for number, (a_from, b_from, a_text, b_text) in enumerate(ranges(worker.pair, texts[i])):
                        none = [pa.nulls(1, c.type) for c in _packed(worker.pair, worker.names, 0, keys.slice(0, 0), joined([]))[1:]]
                        same = a_from == b_from and a_text == b_text
                        cut = [pa.array([number], pa.int32()), part.column(1).slice(i, 1), pa.array([a_from]), pa.array([b_from]), pa.array([a_text]), pa.array([None if same else b_text], pa.string())]
                        yield pa.record_batch([pa.array([recs[i]]), *none, *cut], names)

    assert n_packed == len(names) - 6
    ship_package(docs.sparkSession)
    return given.mapInArrow(run, schema)


FRAGMENT = "a binary, b binary, cut_a binary, cut_b binary, a_from bigint, b_from bigint, last bigint, whole boolean"
_FIELDS = _schema_names(FRAGMENT)


def _as_row(f: Fragment) -> list[pa.Array]:
    raw = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((f.a, np.int32), (f.b, np.int32), (f.cut_a, np.int64), (f.cut_b, np.int64))]
    return [*raw, *(pa.array([x], pa.int64()) for x in (f.a_from, f.b_from, f.last)), pa.array([f.whole])]


def _from_row(row: dict) -> Fragment:
    a, b = (np.frombuffer(row[c], np.int32) for c in ("a", "b"))
    cut_a, cut_b = (np.frombuffer(row[c], np.int64) for c in ("cut_a", "cut_b"))
    return Fragment(a, b, cut_a, cut_b, row["a_from"], row["b_from"], row["last"], row["whole"])


def _long_packs(cut: DataFrame, shared, scratch: Scratch) -> DataFrame:
    """Packs of the documents that were cut: their ranges' fragments, composed by a tree. ``cut`` must not be empty."""
    kind = cut.schema["key"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared.value)
        for batch in batches:
            for i, row in enumerate(batch.select(["a_from", "b_from", "a_text", "b_text"]).to_pylist()):
                found = range_fragment(pair, row["a_from"], row["b_from"], row["a_text"], row["a_text"] if row["b_text"] is None else row["b_text"])
                yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), *_as_row(found)], ["rec", "node", "key", *_FIELDS])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [_from_row(r) for r in batch.column(3)[i].as_py()]
                yield pa.record_batch([*(batch.column(c).slice(i, 1) for c in range(3)), *_as_row(reduce(lambda x, y: compose(pair, x, y), parts))], ["rec", "node", "key", *_FIELDS])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker(shared)
        empty = np.empty(0, np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                found = _from_row(batch.slice(i, 1).to_pylist()[0])
                if not found.whole:
                    found = Fragment(empty, empty, NONE, NONE, 0, 0)
                yield pa.record_batch(_packed(worker.pair, worker.names, batch.column(0)[i].as_py(), batch.column(2).slice(i, 1), joined([found])), _schema_names(PACKED))

    schema = f"rec bigint, node int, key {kind}, {FRAGMENT}"
    dealt = cut.select("rec", F.col("chunk").alias("node"), "key", "a_from", "b_from", "a_text", "b_text").repartition(shuffle_width(cut.sparkSession), "rec", "node")
    level, number = scratch.keep(dealt.mapInArrow(encoded, schema), "fragments0"), 0
    top = level.agg(F.max("node")).first()[0]
    while top:
        node = (F.col("node") / FAN).cast("int").alias("node")
        parts = F.array_sort(F.collect_list(F.struct("node", *_FIELDS))).alias("parts")
        level = scratch.keep(level.groupBy("rec", node).agg(F.first("key").alias("key"), parts).select("rec", "node", "key", "parts").mapInArrow(composed, schema), f"fragments{number + 1}")
        scratch.drop(f"fragments{number}")
        top, number = top // FAN, number + 1
    return level.mapInArrow(packed, PACKED.format(kind=kind))


def _packs(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """The stored packs, and the number of ids of the second tokenizer."""
    files = tuple(open(p, "rb").read() for p in (a_path, b_path))  # some MB, which bounds the broadcast
    width = len(_pair(files).b.bytes)
    shared = docs.sparkSession.sparkContext.broadcast(files)
    first = scratch.keep(_first_pass(docs, shared, key, text), "first")
    packs = first.where("chunk IS NULL").select(*_schema_names(PACKED))
    cut = first.where("chunk IS NOT NULL")
    if not cut.isEmpty():
        packs = packs.unionByName(scratch.keep(_long_packs(cut, shared, scratch), "long"))
    return packs, width


def _counted(packs: DataFrame, width: int) -> DataFrame:
    """``(pair, n, best)``: documents that hold the pair linked, and whether no other pair of its first id is in more."""
    each = packs.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    first = F.floor(F.col("pair") / width).alias("first")
    highest = counts.groupBy(first).agg(F.max("n").alias("highest"))
    return counts.select("*", first).join(highest, "first").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def count_links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(a_id, b_id, n_docs, is_best)``: in how many documents two tokens are linked, and whether that is the first one's highest."""
    packs, width = _packs(docs, a_path, b_path, key, text, Scratch(docs.sparkSession))
    return _counted(packs, width).select(F.floor(F.col("pair") / width).cast("int").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"), F.col("n").alias("n_docs"), F.col("best").alias("is_best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row, whole texts.

    A text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens:
    zeros and an empty digest. Each row is a document, repeated or with a null key too; other columns, whatever
    their names, are not read. Among pairs of one first id with equal counts all are best. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    packs, width = _packs(docs, a_path, b_path, key, text, scratch)
    counts = scratch.keep(_counted(packs, width), "counts")
    asked = packs.select("rec", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    told = asked.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("told"))
    both = packs.join(told, "rec", "left").select("keys", "n_a", "n_b", "n_groups", "n_links", "digests", "ends", "places", "times", "told.n", "told.best")
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n_a, n_b, n_groups, n_links, digests, ends, places, times, n, best = (c.slice(i, 1) for c in batch.columns)
                at, of = np.frombuffer(places[0].as_py(), np.int32), np.frombuffer(times[0].as_py(), np.int64)
                stops = np.concatenate([[0], ends.flatten().to_numpy()]).astype(np.int64)
                sums = []
                for values in (best, n):
                    value = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    so_far = np.concatenate([[0], np.cumsum(value[at] * of)]) if len(at) else np.zeros(1, np.int64)
                    sums.append(pa.array(np.diff(so_far[stops]), pa.int64()))
                yield pa.record_batch([keys.flatten(), *(c.flatten() for c in (n_a, n_b, n_groups, n_links)), *sums, digests.flatten()], names)

    out = both.mapInArrow(run, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("key", key)
