"""Language of texts by bit-sliced Bloom filters over character n-grams.

One table of bit masks serves all languages: each n-gram has three places in it, and the AND of the
masks there names all languages whose filter may hold the n-gram. Counts per language over a text,
corrected for the filters' false positives, decide.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import fold_is, map_batches, texts_of

GRAM = 4
PLACES = 3
BITS = 21  # three places of 21 bits fill a 63-bit hash; the table has 2**21 masks
# The filters are fitted on about this many labelled documents of each language, chosen by hash.
LEARNING_DOCS = 3000
# An n-gram enters a language's filter if it occurs there this often, and with at least this part
# of the frequency that it has in the language where it is most frequent.
LEAST_COUNT = 3
LEAST_SHARE = 0.3
UNDECIDED = "und"
BLANK = 32


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter; anything that is no letter to a blank."""
    lower = np.full(0x110000, BLANK, np.int64)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            small = char.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    return lower


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram, and which texts have a letter.

    Texts are letters with single blanks between, before and behind words.
    """
    chars = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    codes = _letters()[chars]
    blank = codes == BLANK
    lettered = np.zeros(len(texts), bool)
    lettered[owner[~blank]] = True
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    n = max(len(codes) - GRAM + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    inside = owner[:n] == owner[GRAM - 1 :][:n]
    return (mixed[inside] >> np.uint64(1)).astype(np.int64), owner[:n][inside], lettered


class Filters:
    """The fitted table: ``masks[place, word]`` and what is known of each language."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        bits = [(masks[:, i // 63] >> np.int64(i % 63)) & 1 for i in range(len(languages))]
        self.false_rate = np.array([b.mean() ** PLACES for b in bits])
        if len(languages) <= 8:
            self.masks = masks.astype(np.uint8)

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        hashes, owner, lettered = gram_hashes(texts)
        seen = np.bincount(owner, minlength=len(texts))
        found = None
        for j in range(PLACES):
            mask = self.masks[(hashes >> np.int64(BITS * j)) & np.int64((1 << BITS) - 1)]
            found = mask if found is None else found & mask
        counts = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            has = (found[:, i // 63] >> found.dtype.type(i % 63)) & found.dtype.type(1)
            hits = np.bincount(owner, weights=has, minlength=len(texts))
            rate = self.false_rate[i]
            counts[:, i] = np.maximum((hits - seen * rate) / max(1 - rate, 1e-9), 0)
        total = counts.sum(axis=1)
        best = counts.argmax(axis=1)
        names = [self.languages[b] if ok else UNDECIDED for b, ok in zip(best, lettered, strict=True)]
        scores = np.where(lettered & (total > 0), counts[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        return names, scores.tolist()


def learn_filters(labelled: DataFrame, key: str, text: str, lang: str) -> Filters | None:
    """Fit the table on a sample of ``LEARNING_DOCS`` documents per language; None if none has a label.

    Language values are few, like a dictionary's keys; they and the table's masks (2**21 at most)
    are all that reaches the driver.
    """
    spark = labelled.sparkSession
    named = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    found = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    # The most frequent first: it is what ties and texts without any known n-gram get.
    order = sorted(found, key=lambda r: (-r.n, r.lang))
    buckets = 1 << 30
    cuts = spark.createDataFrame([(r.lang, i, min(buckets, LEARNING_DOCS * buckets // r.n)) for i, r in enumerate(order)], "lang string, number int, cut long")
    sample = named.join(F.broadcast(cuts), "lang").where(F.pmod(F.xxhash64("key"), F.lit(buckets)) < F.col("cut")).select("number", "text")

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        numbers = batch.column(0).to_numpy()
        hashes, owner, _ = gram_hashes(texts_of(batch.column(1)))
        both, counts = np.unique(np.stack([numbers[owner].astype(np.int64), hashes]), axis=1, return_counts=True)
        return pa.record_batch([pa.array(both[0], pa.int64()), pa.array(both[1]), pa.array(counts.astype(np.int64))], ["number", "hash", "n"])

    counted = map_batches(sample, grams, "number bigint, hash bigint, n bigint").groupBy("number", "hash").agg(F.sum("n").alias("n"))
    sizes = counted.groupBy("number").agg(F.sum("n").alias("size"))
    shares = counted.join(F.broadcast(sizes), "number").withColumn("share", F.col("n") / F.col("size"))
    kept = shares.withColumn("most", F.max("share").over(Window.partitionBy("hash"))).where((F.col("n") >= LEAST_COUNT) & (F.col("share") >= LEAST_SHARE * F.col("most")))
    places = F.explode(F.array(*(F.shiftrightunsigned("hash", BITS * j).bitwiseAND(F.lit((1 << BITS) - 1)) for j in range(PLACES)))).alias("place")
    bit = F.expr("shiftleft(1L, cast(number % 63 AS int))")
    masks = kept.select("number", places).groupBy("place", (F.expr("number div 63")).alias("word")).agg(F.bit_or(bit.alias("b")).alias("mask"))
    rows = masks.toArrow()
    table = np.zeros((1 << BITS, (len(order) - 1) // 63 + 1), np.int64)
    table[rows["place"].to_numpy(), rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return Filters([r.lang for r in order], table)


def identify(docs: DataFrame, learn_from: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", carry: dict | None = None) -> DataFrame:
    """``(key, <carry>, lang_pred, score)`` of every row of ``docs``, whole texts.

    ``learn_from`` gives the labelled texts. A null text, or one without a letter, is ``und`` with
    score 0; a text none of whose n-grams is known gets the most frequent language with score 0.
    Equal counts go to the more frequent language, then the smaller name. Without any labelled
    text every row is ``und``. Rows are judged one by one; columns with other names are not read.
    ``carry``: further columns, by name.
    """
    filters = learn_filters(learn_from, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    row = F.struct(F.col(key).alias("key"), *(c.alias(n) for n, c in (carry or {}).items()))
    given = docs.select(row.alias("row"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        names, scores = shared.value.decide(texts) if shared.value else ([UNDECIDED] * len(texts), [0.0] * len(texts))
        return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    kind = given.schema["row"].dataType.simpleString()
    judged = map_batches(given, run, f"row {kind}, lang_pred string, score double")
    return judged.select(F.col("row.key").alias(key), *(F.col("row").getField(n).alias(n) for n in carry or {}), "lang_pred", "score")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from documents whose fold is not 0, judge all; ``held_out`` marks fold 0."""
    held_out = fold_is(F.col("doc_id"), 5, 0)
    return identify(docs, docs.where(~held_out), carry={"held_out": held_out})
