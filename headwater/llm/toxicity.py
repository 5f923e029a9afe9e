"""Severity of toxic text by cumulative-link ordinal regression on the words of a document.

P(grade <= k) = sigmoid(threshold_k - score), score = sum of one weight per distinct known word.
The weights are shared by all thresholds; thresholds keep their order because each is the last plus
an exponential. The expected severity is the sum of P(grade > k) over the thresholds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import Scratch, map_batches, texts_of, unpacked, with_columns_of

# The model is fitted on about this many labelled documents of each grade, chosen by hash; the lowest
# grade weighs as much as all others together, however rare they are. Everything kept on the driver is bounded by this sample.
LEARNING_DOCS = 4000
LEAST_DOCS = 5  # a word is a feature if it occurs in as many documents of the sample
PENALTY = 0.02  # on weights before they are scaled by a word's rarity
REJECT_FROM = 0.5
ROUNDS = 40
GRADES = "grade"

words_of = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> set[str]:
    return set(words_of(text.lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """The first as it is, each further one the last plus exp of its parameter."""
    return np.cumsum(np.concatenate([free[:1], np.exp(np.clip(free[1:], -20, 20))]))


def loss_and_gradient(parameters: np.ndarray, n_words: int, rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log likelihood of some documents, without the penalty."""
    coefficients, free = parameters[:n_words], parameters[n_words:]
    cuts = np.concatenate([[-np.inf], thresholds_of(free), [np.inf]])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    scores = np.bincount(owner, weights=coefficients[flat], minlength=len(rows))
    upper, lower = _sigmoid(cuts[grades + 1] - scores), _sigmoid(cuts[grades] - scores)
    likely = np.maximum(upper - lower, 1e-12)
    at_upper, at_lower = upper * (1 - upper), lower * (1 - lower)
    by_score = weights * (at_upper - at_lower) / likely
    gradient = np.zeros(len(parameters))
    gradient[:n_words] = np.bincount(flat, weights=by_score[owner], minlength=n_words)
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, grades + 1, -weights * at_upper / likely)
    np.add.at(by_cut, grades, weights * at_lower / likely)
    inner = by_cut[1:-1]
    # A parameter moves its own threshold and all later ones.
    tails = np.cumsum(inner[::-1])[::-1]
    gradient[n_words:] = tails * np.concatenate([[1.0], np.exp(np.clip(free[1:], -20, 20))])
    return float(-(weights * np.log(likely)).sum()), gradient


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """L-BFGS with halving steps; each evaluation is one pass over the sample."""
    at, (value, slope), steps = start, evaluate(start), []
    for _ in range(rounds):
        way, used = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ way / (y @ s)
            way -= a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(np.linalg.norm(way), 1e-12)
        for (s, y), a in zip(steps, reversed(used), strict=True):
            way += s * (a - y @ way / (y @ s))
        size = 1.0
        for _ in range(8):
            then = at - size * way
            new_value, new_slope = evaluate(then)
            if new_value <= value - 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        s, y = then - at, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        at, value, slope = then, new_value, new_slope
        if done:
            break
    return at


class Model:
    """Weights by word and ordered thresholds; without thresholds every document has grade 0.

    ``decides`` is the model of the lowest threshold alone, where there are more: what separates the
    higher grades must not cost it anything.
    """

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray, decides: Model | None = None):
        self.weights, self.thresholds, self.decides = weights, thresholds, decides

    def above(self, found: list[set[str]]) -> np.ndarray:
        """Per set of words and threshold the probability to be above it."""
        weights = self.weights
        scores = np.array([sum(weights[w] for w in ws if w in weights) for ws in found])
        return _sigmoid(scores[:, None] - self.thresholds[None, :]) if found else np.zeros((0, len(self.thresholds)))

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and P(grade > 0)."""
        found = [words(t) for t in texts]
        above = self.above(found)
        decided = self.decides.above(found) if self.decides else above
        return above.sum(axis=1), decided[:, 0] if len(self.thresholds) else np.zeros(len(texts))


def fit(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on documents with a grade (0, 1, ...; table ``(key, grade)``, the highest counts if several).

    The sample is drawn from the grades alone, so only its texts are read further. Its size bounds
    the broadcast, the words and the gradients.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    graded = grades.where(F.col(key).isNotNull() & F.col(GRADES).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(GRADES).cast("int").alias(GRADES))
    counts = {r[GRADES]: r.n for r in graded.groupBy(GRADES).agg(F.count(F.lit(1)).alias("n")).collect()}
    levels = sorted(counts)
    if len(levels) < 2:
        return Model({}, np.empty(0))
    buckets = 1 << 30
    cut, level = F.lit(0).cast("long"), F.lit(0)
    for i, g in enumerate(levels):
        this = F.col(GRADES) == g
        cut = F.when(this, min(buckets, LEARNING_DOCS * buckets // counts[g])).otherwise(cut)
        level = F.when(this, i).otherwise(level)
    sample = graded.where(F.pmod(F.xxhash64("k"), F.lit(buckets)) < cut).select("k", level.alias("level"))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(words(t)) for t in texts_of(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["level", "words"])

    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(sample), "k").select("level", "text")
    split_docs = scratch.keep(map_batches(texts, split, "level int, words array<string>"), "words")
    features = split_docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    frequency = {r.word: r.n for r in features.collect()}
    vocabulary = sorted(frequency)
    numbers = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    n_words = len(vocabulary)
    sampled = {r.level: r.n for r in split_docs.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sampled) < len(levels):  # labels of documents that are not there
        present = [levels[i] for i in sorted(sampled)]
        return fit(docs, graded.where(F.col(GRADES).isin(present)).withColumnRenamed("k", key), key, text)
    above = sum(sampled.values()) - sampled[0]
    share = np.array([0.5 / (above if i else sampled[0]) for i in range(len(levels))])
    rarity = np.log(sum(sampled.values()) / np.array([frequency[w] for w in vocabulary], float))

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = numbers.value
        found = [[known[w] for w in ws if w in known] for ws in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["level", "features"])

    rows = scratch.keep(map_batches(split_docs, number, "level int, features array<int>"), "features")
    scratch.drop("words")

    def fitted(top: int, decides: Model | None = None) -> Model:
        """The model of the levels up to ``top``, to which all higher ones are added."""

        def evaluate(parameters: np.ndarray) -> tuple[float, np.ndarray]:
            scaled = np.concatenate([parameters[:n_words] * rarity, parameters[n_words:]])
            shared = spark.sparkContext.broadcast(scaled)

            def part(batches):
                value, gradient = 0.0, np.zeros(len(parameters))
                for b in batches:
                    levels_here = b.column(0).to_numpy().astype(np.int64)
                    v, g = loss_and_gradient(shared.value, n_words, [np.asarray(f, np.int64) for f in b.column(1).to_pylist()], np.minimum(levels_here, top), share[levels_here])
                    value, gradient = value + v, gradient + g
                yield pa.record_batch([pa.array([value]), pa.array([gradient.tobytes()], pa.binary())], ["value", "gradient"])

            # One row per task of the bounded sample.
            parts = rows.mapInArrow(part, "value double, gradient binary").collect()
            shared.destroy()
            coefficients = parameters[:n_words]
            gradient = sum(np.frombuffer(p.gradient) for p in parts)
            gradient[:n_words] = gradient[:n_words] * rarity + PENALTY * coefficients
            return sum(p.value for p in parts) + PENALTY / 2 * float(coefficients @ coefficients), gradient

        below = np.cumsum([share[i] * sampled[i] for i in range(len(levels))])[:top]
        cuts = np.log(below / (1 - below))
        start = np.concatenate([np.zeros(n_words), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
        best = minimise(evaluate, start)
        return Model({w: float(c) for w, c in zip(vocabulary, best[:n_words] * rarity, strict=True) if c}, thresholds_of(best[n_words:]), decides)

    return fitted(len(levels) - 1, fitted(1) if len(levels) > 2 else None)


def severity_grades(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Grades from the labels: 0 not toxic, 1 toxic in otherwise good text, 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select(F.col(key), grade.alias(GRADES))


def judge(docs: DataFrame, model: Model, key: Column, text: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """``(key, severity, p_toxic, toxic)`` of every row, whole texts; ``key`` may be any column or struct.

    Null or empty texts have no words and get what the thresholds alone say. Rows are judged one by
    one, so null or repeated keys stay. ``toxic`` (rejected): P(grade > 0) is ``reject_from`` or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(key.alias("key"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        severity, toxic = shared.value.judge(texts_of(batch.column(1)))
        return pa.record_batch([batch.column(0), pa.array(severity, pa.float64()), pa.array(toxic, pa.float64())], ["key", "severity", "p_toxic"])

    judged = map_batches(given, run, f"key {given.schema['key'].dataType.simpleString()}, severity double, p_toxic double")
    return judged.withColumn("toxic", F.col("p_toxic") >= reject_from)


def grade_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, severity, p_toxic, toxic)`` of every document. Without two grades among the labels nothing is toxic."""
    return judge(docs, fit(docs, severity_grades(labels)), F.col("doc_id")).withColumnRenamed("key", "doc_id")


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", reject_from: float = REJECT_FROM) -> DataFrame:
    """The rows of ``docs``, with their columns, that are not rejected.

    A row is judged by its text alone: null and empty texts get what the thresholds alone say, repeated rows share one
    verdict and null keys are as good as others. A probability of exactly ``reject_from`` rejects. An empty table gives none;
    without two grades among the labels all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, severity_grades(labels)))
    judged = with_columns_of(docs, text, lambda texts: [pa.array(shared.value.judge(texts)[1], pa.float64())], "p_toxic double")
    return unpacked(judged.where(F.col("p_toxic") < reject_from), docs.columns)
