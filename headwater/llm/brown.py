"""Class-based bigram language model (Brown): P(word | last) = P(class | last class) * P(word | class).

Counts come from all training documents. The most frequent words ("seeds") are put into classes by
exchange: a word moves to the class that raises the likelihood of the class bigrams most, as seen from
the counts of its neighbours' classes, in rounds over all seeds until a round gains next to nothing.
Then every other word that occurs at least ``LEAST_COUNT`` times is put into the class where its own
bigrams with classed neighbours raise the likelihood most: first the words of a bounded list, which all
tasks hold, from their neighbours among the seeds; then all words beyond the list, which are met by
joins, from their neighbours in the list. Rarer words are one class with add-one emission, which also
has room for words never seen; the end of a text is a class of its own, and is what a text starts from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import ROWS_AT_ONCE, Scratch, fold_is, ship_package, texts_of
from headwater.llm.quality import bucket

CLASSES = 32
RARE, END, OTHER = CLASSES, CLASSES + 1, CLASSES + 2  # kinds of neighbours beside the classes; OTHER: no class known yet
WIDTH = CLASSES + 3
SEEDS = 8192  # so many words are exchanged until the likelihood stops rising; the others are placed by these
LEAST_COUNT = 8  # words that occur less often are rare
LISTED_WORDS = 200_000  # at most so many words are broadcast with their counts and classes; the rest is joined
TOLERANCE = 0.005  # log likelihood a word that a round of exchanges must gain for another one
SMOOTHING = 5.0  # pseudo-counts of a class's transitions, dealt by how frequent classes are
TEXTS_AT_ONCE = 500  # their words are held as one row
KEPT_WORDS = 400_000  # counts that a task holds before it hands them on
KEPT_PAIRS = 2_000_000


def tokens(text: str) -> list[bytes]:
    """Words between blanks of ASCII, A-Z in lower case; the end of the text is not among them."""
    return text.encode().lower().split()


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            yield part, texts_of(part.column(column))


def numbered(texts: list[str], get: Callable, other: int, end: int) -> tuple[list[bytes | None], np.ndarray, list[int]]:
    """One row of words and one of their numbers for all texts, with an end before and behind each; and where the ends are."""
    words: list[bytes | None] = [None]
    ends = [0]
    for text in texts:
        words += tokens(text)
        ends.append(len(words))
        words.append(None)
    ids = np.fromiter(map(get, words, repeat(other)), np.int64, len(words))
    ids[ends] = end
    return words, ids, ends


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over a table of one text column; ends of texts are not counted here."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for _, part in _texts(batches, 0):
            for text in part:
                counts.update(tokens(text))
            if len(counts) > KEPT_WORDS:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Listed:
    """The listed words, most frequent first, and how many of them are seeds."""

    def __init__(self, words: list[str], counts: list[int], seeds: int):
        self.number = {w.encode(): i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.seeds = seeds


_listed: list = [None, None]


def _shared_list(shared) -> Listed:
    if _listed[0] != shared.id:
        _listed[:] = [shared.id, Listed(*shared.value)]
    return _listed[1]


class _Shared:
    """A broadcast and its number, by which workers know what they have unpacked."""

    def __init__(self, sc, value):
        self.broadcast = sc.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def pair_counts(texts: DataFrame, shared: _Shared) -> DataFrame:
    """``(a, b, n)``: neighbours by number; words that are no seeds are ``seeds``, ends ``seeds + 1``."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _shared_list(shared)
        rare, end = listed.seeds, listed.seeds + 1
        get = {w: i for w, i in listed.number.items() if i < rare}.get
        width = np.int64(end + 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, number = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(number, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)), pa.array(counts)], ["a", "b", "n"])

        for _, part in _texts(batches, 0):
            _, ids, _ = numbered(part, get, rare, end)
            held.append(np.unique(ids[:-1] * width + ids[1:], return_counts=True))
            size += len(held[-1][0])
            if size > KEPT_PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if size > KEPT_PAIRS // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*merged())

    return texts.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to what no exchange can change."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def exchange(classes: np.ndarray, after: np.ndarray, before: np.ndarray, same: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Move each of ``words`` to its best class. ``after[w, c]``: how often w precedes class c; ``before``: follows it; ``same``: itself."""
    classes, k = classes.copy(), after.shape[1]
    table = np.zeros((k, k))
    np.add.at(table, classes, after)
    for w in words:
        a, s = classes[w], same[w]
        r, c = after[w].copy(), before[w].copy()
        r[a] -= s
        c[a] -= s
        table[a] -= r
        table[:, a] -= c
        table[a, a] -= s
        table_now = np.maximum(table, 0)
        row, col = table_now.sum(axis=1)[:CLASSES], table_now.sum(axis=0)[:CLASSES]
        block, cross = table_now[:CLASSES], table_now[:, :CLASSES].T
        gain = (_xlogx(block + r) - _xlogx(block)).sum(axis=1) + (_xlogx(cross + c) - _xlogx(cross)).sum(axis=1)
        own = np.diagonal(table_now)[:CLASSES]
        rb, cb = r[:CLASSES], c[:CLASSES]
        gain += _xlogx(own + rb + cb + s) - _xlogx(own + rb) - _xlogx(own + cb) + _xlogx(own)
        rt, ct = r.sum() + s, c.sum() + s
        gain -= _xlogx(row + rt) - _xlogx(row) + _xlogx(col + ct) - _xlogx(col)
        b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
        table[b] += r
        table[:, b] += c
        table[b, b] += s
        classes[w] = b
    return classes


def learn_classes(pairs: DataFrame, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each number (seeds, rare, end) and the table of class bigrams.

    Each turn sums the pairs by word and neighbour's class; what reaches the driver is one number
    per seed and class. A round is two turns, each for half of the seeds; rounds end when one has
    gained less than the tolerance.
    """
    spark = pairs.sparkSession
    k = CLASSES + 2
    classes = np.concatenate([np.arange(seeds) % CLASSES, [RARE, END]])
    best, best_value, since = None, -math.inf, 0
    for turn in count():
        named = spark.createDataFrame(list(enumerate(classes.tolist())), "number int, class int")
        right = pairs.join(F.broadcast(named), F.col("b") == F.col("number")).groupBy("a", "class").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).toArrow()
        left = pairs.join(F.broadcast(named), F.col("a") == F.col("number")).groupBy("b", "class").agg(F.sum("n").alias("n")).toArrow()
        after, before, same = np.zeros((seeds + 2, k)), np.zeros((seeds + 2, k)), np.zeros(seeds + 2)
        after[right["a"].to_numpy(), right["class"].to_numpy()] = right["n"].to_numpy()
        before[left["b"].to_numpy(), left["class"].to_numpy()] = left["n"].to_numpy()
        np.add.at(same, right["a"].to_numpy(), right["same"].to_numpy())
        table = np.zeros((k, k))
        np.add.at(table, classes, after)
        value = likelihood(table)
        since = 0 if best is None or value - best_value >= TOLERANCE * table.sum() else since + 1
        if best is None or value > best_value:
            best, best_value = (classes, after, before, same, table), value
        if since == 2 or not seeds:
            return best[0], best[4]
        # Half of the words at a time: neighbours that move at once would chase each other.
        classes = exchange(*best[:4], np.arange(turn % 2, seeds, 2))


def word_code(word: bytes) -> int:
    """The hash that stands for a word beyond the list, as ``code_of`` gives it."""
    code = xxhash.xxh64_intdigest(word, 42)
    return code - (code >> 63 << 64)


def code_of(word: Column) -> Column:
    return F.xxhash64(word)


def neighbour_counts(texts: DataFrame, shared: _Shared, kinds: np.ndarray, unlisted: bool) -> DataFrame:
    """``(word, slot, n)``: how often a word stands before (slot below ``WIDTH``) or behind each kind of word.

    ``kinds`` are those of the listed words; ``unlisted`` asks for the words beyond the list, by code, and
    also gives the table of kinds in rows with slot -1 (word: first kind * ``WIDTH`` + second); else listed
    words of the kind ``OTHER`` are asked for, by number.
    """
    ship_package(texts.sparkSession)
    every_kind = texts.sparkSession.sparkContext.broadcast(np.concatenate([kinds, [END]]).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, kinds = _shared_list(shared).number.get, every_kind.value
        end = len(kinds) - 1
        local: dict[bytes, int] = {}
        table = np.zeros(WIDTH * WIDTH, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, number = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(number, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            words = codes // (2 * WIDTH)
            if unlisted:
                words = np.array([word_code(w) for w in local], np.int64)[words - end - 1]
            return pa.record_batch([pa.array(words), pa.array((codes % (2 * WIDTH)).astype(np.int32)), pa.array(counts)], ["word", "slot", "n"])

        for _, part in _texts(batches, 0):
            words, ids, _ = numbered(part, get, end + 1, end)
            if unlisted:
                at = np.flatnonzero(ids > end)
                ids[at] = [local.setdefault(words[i], end + 1 + len(local)) for i in at.tolist()]
            kind = np.where(ids <= end, kinds[np.minimum(ids, end)], OTHER)
            asked = ids > end if unlisted else (ids < end) & (kind == OTHER)
            first, second = asked[:-1], asked[1:]
            codes = np.concatenate([ids[:-1][first] * (2 * WIDTH) + kind[1:][first], ids[1:][second] * (2 * WIDTH) + WIDTH + kind[:-1][second]])
            if unlisted:
                table += np.bincount(kind[:-1] * WIDTH + kind[1:], minlength=WIDTH * WIDTH)
            held.append(np.unique(codes, return_counts=True))
            size += len(held[-1][0])
            if size > KEPT_PAIRS or len(local) > KEPT_WORDS:
                held = [merged()]
                size = len(held[0][0])
                if size > KEPT_PAIRS // 2 or len(local) > KEPT_WORDS:
                    yield rows(*held[0])
                    held, size = [], 0
                    local.clear()
        if size:
            yield rows(*merged())
        cells = np.flatnonzero(table)
        if len(cells):
            yield pa.record_batch([pa.array(cells), pa.array(np.full(len(cells), -1, np.int32)), pa.array(table[cells])], ["word", "slot", "n"])

    return texts.mapInArrow(run, "word bigint, slot int, n bigint")


def placed(counts: DataFrame, table: np.ndarray) -> DataFrame:
    """``(word, class)``: for each word of ``neighbour_counts`` the class where its bigrams raise the likelihood of ``table`` most.

    Each word is placed by itself, so the result does not hang on their order; a group has one row per slot.
    """
    ship_package(counts.sparkSession)
    block, cross = table[:CLASSES], table[:, :CLASSES].T

    def gains(after: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = (_xlogx(block + after[:, None]) - _xlogx(block)).sum(axis=2) + (_xlogx(cross + before[:, None]) - _xlogx(cross)).sum(axis=2)
        for side, added in ((block, after), (cross, before)):
            whole = side.sum(axis=1)
            out -= _xlogx(whole + added.sum(axis=1)[:, None]) - _xlogx(whole)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lists = part.column(1)
                entries = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                sums = np.zeros((part.num_rows, 2 * WIDTH))
                sums[row, entries.field(0).to_numpy()] = entries.field(1).to_numpy()
                best = gains(sums[:, :WIDTH], sums[:, WIDTH:]).argmax(axis=1)
                yield pa.record_batch([part.column(0), pa.array(best.astype(np.int32))], ["word", "class"])

    slots = counts.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    return slots.mapInArrow(run, "word bigint, class int")


class Model:
    """Log probabilities by number of the listed words; then of any word beyond (without its emission) and of the end."""

    def __init__(self, listed: Listed, kinds: np.ndarray, table: np.ndarray, by_class: np.ndarray, rare: tuple[int, int], total: int, distinct: int, ends: int):
        n = listed.counts
        self.kinds = np.concatenate([kinds, [RARE, END]])
        frequent = table.sum(axis=0)
        share = (frequent + 1) / (frequent.sum() + len(frequent))
        self.moves = np.log10((table + SMOOTHING * share) / (table.sum(axis=1, keepdims=True) + SMOOTHING))
        self.by_class = by_class  # tokens of each class
        self.rare_base = rare[0] + rare[1] + 1
        classed = kinds < RARE
        emission = np.where(classed, n / by_class[np.where(classed, kinds, 0)].clip(1), (n + 1) / self.rare_base)
        self.emission = np.log10(np.concatenate([emission, [1.0, 1.0]]))
        self.base_total = total + distinct + 1
        self.base = np.log10(np.concatenate([n + 1, [1], [ends + 1]]) / self.base_total)
        self.total, self.ends = total, ends


def _summed(counts: DataFrame) -> DataFrame:
    """Sums by word and slot, laid out by word, so that grouping by word needs no further shuffle."""
    return counts.repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))


def fit(learned: DataFrame, scratch: Scratch) -> tuple[_Shared, Model, DataFrame]:
    """The listed words, the model, and ``(word, n, class)`` of all words beyond the list, from a table of one text column."""
    spark = learned.sparkSession
    ends = learned.count()
    words = scratch.keep(word_counts(learned), "words")
    total, distinct, rare_tokens, rare_words = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("n") < LEAST_COUNT, F.col("n"))), F.lit(0)), F.count(F.when(F.col("n") < LEAST_COUNT, 1))
    ).first()
    total, distinct = total + ends, distinct + (ends > 0)
    # The least count from which on words are listed, by buckets of counts: a bounded histogram.
    steps = sorted(words.groupBy(bucket(F.col("n")).alias("least")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.least)
    sums = np.cumsum([r.words for r in steps])
    fits = [r.least for r, s in zip(steps, sums, strict=True) if s <= LISTED_WORDS]
    least = fits[-1] if fits else 1 << 62
    rows = words.where(F.col("n") >= least).toArrow()
    order = sorted(zip(rows["n"].to_pylist(), rows["word"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    shared = _Shared(spark.sparkContext, ([w for _, w in order], [n for n, _ in order], min(SEEDS, sum(n >= LEAST_COUNT for n, _ in order))))
    listed = Listed(*shared.value)

    pairs = scratch.keep(pair_counts(learned, shared), "pairs")
    seeds, narrow = learn_classes(pairs, listed.seeds)
    scratch.drop("pairs")
    kinds = np.where(listed.counts >= LEAST_COUNT, OTHER, RARE)
    kinds[: listed.seeds] = seeds[: listed.seeds]
    if (kinds == OTHER).any():
        # What is no seed is one kind of neighbour here, whether it is rare or not.
        table = np.zeros((WIDTH, WIDTH))
        to = np.r_[np.arange(CLASSES), OTHER, END]
        table[np.ix_(to, to)] = narrow
        found = placed(_summed(neighbour_counts(learned, shared, np.where(kinds == RARE, OTHER, kinds), False)), table).toArrow()
        number = found["word"].to_numpy()
        kinds[number] = np.where(kinds[number] == OTHER, found["class"].to_numpy(), kinds[number])

    counts = scratch.keep(_summed(neighbour_counts(learned, shared, kinds, True)), "counts")
    wide = np.zeros(WIDTH * WIDTH)
    for r in counts.where("slot < 0").collect():
        wide[r.word] = r.n
    counts = counts.where("slot >= 0")
    wide = wide.reshape(WIDTH, WIDTH)
    beyond = words.where(F.col("n") < least).withColumn("code", code_of(F.col("word")))
    asked = beyond.where(F.col("n") >= LEAST_COUNT).select(F.col("code").alias("word"))
    classes = placed(counts.join(asked, "word", "left_semi"), wide).select(F.col("word").alias("code"), "class")
    dictionary = scratch.keep(beyond.join(classes, "code", "left").select("word", "n", "code", F.when(F.col("n") >= LEAST_COUNT, F.col("class")).otherwise(RARE).alias("class")), "dictionary")
    # Words beyond the list take their place in the table; two in a row meet the average class of such words.
    by_code = dictionary.groupBy("code").agg(F.min("class").alias("class"))
    sides = np.zeros((CLASSES + 1, 2 * WIDTH))
    for r in counts.join(by_code.withColumnRenamed("code", "word"), "word").groupBy("class", "slot").agg(F.sum("n").alias("n")).collect():
        sides[r["class"], r.slot] = r.n
    after, before = sides[:, :WIDTH], sides[:, WIDTH:]
    final = wide[:OTHER, :OTHER].copy()
    final[:END] += after[:, :OTHER]
    final[:, :END] += before[:, :OTHER].T
    final[:END, :END] += np.outer(after[:, OTHER], before[:, OTHER] / max(before[:, OTHER].sum(), 1))
    by_class = np.bincount(kinds, weights=listed.counts, minlength=CLASSES + 1)[:CLASSES]
    for r in dictionary.where(F.col("class") < RARE).groupBy("class").agg(F.sum("n").alias("n")).collect():
        by_class[r["class"]] += r.n
    scratch.drop("counts")
    return shared, Model(listed, kinds, final, by_class, (rare_tokens, rare_words), total, distinct, ends), dictionary


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` of every row.

    ``train`` marks the rows that are learned from; ``held_out`` is passed through (not ``train`` if
    omitted). A null or empty text is its end alone. Without training rows every count is 0 and all words are
    rare. Rows are scored one by one, repeated ones too; columns with other names are not read. An
    empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    train = F.coalesce(train, F.lit(False))
    shared, model, dictionary = fit(docs.where(train).select(F.col(text).alias("text")), scratch)
    shared_model = spark.sparkContext.broadcast(model)

    def lists(ends: list[int], rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.ListArray:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields.values(), strict=True)]
        columns = [c.cast(pa.string()) if c.type == pa.binary() else c for c in columns]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, model = _shared_list(shared), shared_model.value
        get, other, end = listed.number.get, len(listed.counts), len(listed.counts) + 1
        for part, texts in _texts(batches, 3):
            open_words: list[tuple] = []
            open_pairs: list[tuple] = []
            words_end, pairs_end = [0], [0]
            words, ids, ends = numbered(texts, get, other, end)
            kinds, is_other = model.kinds[ids], ids == other
            # A word beyond the list goes to the joins once, with its neighbours' classes; two such words in a row also as a pair.
            at, both = np.flatnonzero(is_other), np.flatnonzero(is_other[:-1] & is_other[1:])
            around = np.where(is_other, -1, kinds)
            open_at = list(zip([words[i] for i in at.tolist()], around[at - 1].tolist(), around[at + 1].tolist(), strict=True))
            both_at = [(words[i], words[i + 1]) for i in both.tolist()]
            for single, pair in zip(pairwise(np.searchsorted(at, ends).tolist()), pairwise(np.searchsorted(both, ends).tolist()), strict=True):
                open_words += [(*w, n) for w, n in Counter(open_at[slice(*single)]).items()]
                open_pairs += [(*p, n) for p, n in Counter(both_at[slice(*pair)]).items()]
                words_end.append(len(open_words))
                pairs_end.append(len(open_pairs))
            moves = np.where(is_other[:-1] | is_other[1:], 0.0, model.moves[kinds[:-1], kinds[1:]])
            own = ids[1:]
            # Every text has its end, so no part is empty.
            sums = [np.add.reduceat(np.where(is_other[1:], 0, x), ends[:-1]) for x in (np.ones(len(own), np.int64), model.base[own], moves + model.emission[own])]
            found = (np.diff(ends), sums[0] - (0 if model.ends else 1), *sums[1:])
            columns = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            columns.append(lists(words_end, open_words, {"word": pa.binary(), "before": pa.int32(), "after": pa.int32(), "times": pa.int64()}))
            columns.append(lists(pairs_end, open_pairs, {"a": pa.binary(), "b": pa.binary(), "times": pa.int64()}))
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), *columns], ["row", "key", "held_out", "n_tokens", "known", "base", "score", "words", "pairs"])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), (F.coalesce(held_out, F.lit(False)) if held_out is not None else ~train).alias("held_out"), F.col(text).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    # Stored with its row numbers, so that both readers below see the same ones.
    scored = scratch.keep(
        given.mapInArrow(
            run,
            f"row bigint, key {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
            "words array<struct<word:string,before:int,after:int,times:bigint>>, pairs array<struct<a:string,b:string,times:bigint>>",
        ),
        "scored",
    )
    times = F.col("times")
    move_of = F.array(*(F.lit(float(x)) for x in model.moves.ravel()))

    def move(first: Column, second: Column) -> Column:
        return F.element_at(move_of, first * model.moves.shape[1] + second + 1)

    rare = F.lit(RARE)
    words = scored.select("row", F.explode("words").alias("w")).select("row", "w.*").join(dictionary.select("word", "n", "class"), "word", "left")
    words = words.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", F.coalesce("class", rare))
    totals = F.element_at(F.array(*(F.lit(float(max(x, 1))) for x in model.by_class), F.lit(1.0)), F.col("class") + 1)
    emission = F.when(F.col("class") < RARE, F.log10(F.col("n") / totals)).otherwise(F.log10((F.col("n") + 1) / F.lit(float(model.rare_base))))
    none = F.lit(0.0)
    into = F.when(F.col("before") >= 0, move(F.col("before"), F.col("class"))).otherwise(none)
    out_of = F.when(F.col("after") >= 0, move(F.col("class"), F.col("after"))).otherwise(none)
    met = words.select("row", F.when(F.col("n") > 0, times).otherwise(0).alias("more_known"), (times * F.log10((F.col("n") + 1) / F.lit(float(model.base_total)))).alias("more_base"), (times * (emission + into + out_of)).alias("more_score"))
    pairs = scored.select("row", F.explode("pairs").alias("p")).select("row", "p.*")
    for side in ("a", "b"):
        pairs = pairs.join(dictionary.select(F.col("word").alias(side), F.col("class").alias(f"class_{side}")), side, "left")
    between = times * move(F.coalesce("class_a", rare), F.coalesce("class_b", rare))
    met = met.unionByName(pairs.select("row", F.lit(0).cast("bigint").alias("more_known"), none.alias("more_base"), between.alias("more_score")))
    sums = met.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more_known", "more_base", "more_score")))
    joined = scored.drop("words", "pairs").join(sums, "row", "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    whole = joined.select("key", "held_out", "n_tokens", plus("known", "more_known").alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))
    return whole.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("key", key)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from documents whose fold is not 2, score all; ``held_out`` marks fold 2."""
    held_out = fold_is(F.col("doc_id"), 7, 2)
    return score_documents(docs, ~held_out, held_out=held_out)
