"""Rates of documents that bring the expected token totals of domains to their targets.

A naive Bayes classifier, fitted on labelled documents and tempered on a part of them held out, gives
each document its membership in every domain. Then non-negative rates are fitted by projected
gradient descent on least squares: the expected total of each domain (rate * tokens * membership)
against its target, in units of the target, and a small pull of each rate to 1. A document whose most
likely domain is to be kept has a rate of at least 1 in every step. A rate follows from
the document's membership and the residuals of the rounds, a few numbers each, so rounds move
nothing but sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import Scratch, map_batches, texts_of, unpacked, with_columns_of

# About this many labelled documents of each domain are learned from, chosen by hash; one in five of
# them only sets the temperature. This bounds the words and counts on the driver.
LEARNING_DOCS = 2000
LEAST_COUNT = 5
TEMPERATURES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0)
PULL = 0.02  # weight of (rate - 1)^2 against the squared relative errors
ROUNDS = 60
CLOSE = 1e-3  # a relative change of the residuals at which rounds end
LOW_QUALITY_TO = 0.5  # the part of its tokens that low quality keeps

features_of = re.compile(r"[^\W\d_]+|[^\w\s]+").findall


@dataclass
class Domains:
    """The classifier: log probability of each known feature per domain, at a temperature."""

    names: list[str]
    prior: np.ndarray
    numbers: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    temperature: float = 1.0

    def evidence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.names)))
        get = self.numbers.get
        for i, text in enumerate(texts):
            ids = [n for n in map(get, features_of(text.lower())) if n is not None]
            if ids:
                out[i] = self.logs[ids].sum(axis=0)
        return out

    def membership(self, evidence: np.ndarray) -> np.ndarray:
        if not self.names:
            return np.zeros((len(evidence), 0))
        scores = np.log(self.prior) + evidence / self.temperature
        scores -= scores.max(axis=1, keepdims=True)
        shares = np.exp(scores)
        return shares / shares.sum(axis=1, keepdims=True)


@dataclass
class Rates:
    """What the rounds have found: the step, and each round's slope per domain; and which domains are kept whole."""

    step: float
    slopes: list[np.ndarray] = field(default_factory=list)
    kept: np.ndarray | None = None

    def _walk(self, membership: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rate = ahead = np.ones(len(membership))
        least = self.kept[membership.argmax(axis=1)].astype(float) if self.kept is not None and self.slopes else 0.0
        t = 1.0
        for slope in self.slopes:
            new = np.maximum(least, ahead - self.step * (membership @ slope + PULL * (ahead - 1)))
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            ahead, rate, t = new + (t - 1) / t_new * (new - rate), new, t_new
        return rate, ahead

    def of(self, membership: np.ndarray) -> np.ndarray:
        return self._walk(membership)[0]

    def ahead(self, membership: np.ndarray) -> np.ndarray:
        """Where the next slope is taken: beyond the last rate, by momentum."""
        return self._walk(membership)[1]


def learn_domains(labelled: DataFrame, docs: DataFrame) -> Domains:
    """Fit on ``labelled(key, domain)`` and the texts of ``docs``; domains are few, and their names and sizes come to the driver.

    Keys are drawn first, so only the sample, which is bounded, is joined with texts.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark)
    named = labelled.where("domain IS NOT NULL")
    sizes = sorted((r.domain, r.n) for r in named.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return Domains([], np.empty(0))
    buckets = 1 << 30
    cuts = spark.createDataFrame([(d, i, min(buckets, LEARNING_DOCS * buckets // n)) for i, (d, n) in enumerate(sizes)], "domain string, number int, cut long")
    draw = F.pmod(F.xxhash64("key"), F.lit(buckets))
    drawn = named.join(F.broadcast(cuts), "domain").where(draw < F.col("cut")).select("key", "number", (F.pmod(F.xxhash64("key", F.lit("temper")), F.lit(5)) == 0).alias("tempers"))
    # A key with several rows is drawn with each of them, and must not be multiplied by itself.
    once = drawn.groupBy("key").agg(F.min("number").alias("number"), F.first("tempers").alias("tempers"))
    sample = docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(once), "key").select("number", "tempers", "text")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features_of(t.lower()) for t in texts_of(batch.column(2))]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["number", "tempers", "features"])

    docs = scratch.keep(map_batches(sample, split, "number int, tempers boolean, features array<string>"), "sample")
    learn = docs.where("NOT tempers") if docs.where("tempers").limit(1).count() and docs.where("NOT tempers").limit(1).count() else docs
    counted = learn.select("number", F.explode("features").alias("feature")).groupBy("feature", "number").agg(F.count(F.lit(1)).alias("n"))
    wide = counted.groupBy("feature").agg(F.sum("n").alias("n"), F.collect_list(F.struct("number", "n")).alias("by")).where(F.col("n") >= LEAST_COUNT).select("feature", "by").collect()
    features = sorted((r.feature, r.by) for r in wide)
    counts = np.zeros((len(features), len(sizes)))
    for i, (_, by) in enumerate(features):
        for number, n in by:
            counts[i, number] = n
    smooth = counts + 0.5
    logs = np.log(smooth / np.maximum(smooth.sum(axis=0), 1)) if len(features) else np.zeros((0, len(sizes)))
    prior = np.array([n for _, n in sizes], float)
    model = Domains([d for d, _ in sizes], prior / prior.sum(), {f: i for i, (f, _) in enumerate(features)}, logs - logs.mean(axis=1, keepdims=True) if len(features) else logs)
    shared = spark.sparkContext.broadcast(model)

    def evidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.evidence([" ".join(f) for f in batch.column(1).to_pylist()])
        return pa.record_batch([batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], ["number", "evidence"])

    held = map_batches(docs.where("tempers").select("number", "features"), evidence, "number int, evidence array<double>").collect()
    if held:
        truth, found = np.array([r.number for r in held]), np.array([r.evidence for r in held])

        def loss(temperature: float) -> float:
            model.temperature = temperature
            return -np.log(np.maximum(model.membership(found)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = min(TEMPERATURES, key=loss)
    return model


def memberships(docs: DataFrame, model: Domains, row: Column, text: str = "text") -> DataFrame:
    """``(row, n_tokens, membership)`` of every row; ``row`` is any column or struct to carry."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(row.alias("row"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        found = shared.value.membership(shared.value.evidence(texts))
        return pa.record_batch([batch.column(0), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["row", "n_tokens", "membership"])

    return map_batches(given, run, f"row {given.schema['row'].dataType.simpleString()}, n_tokens bigint, membership array<double>")


def _sums(found: DataFrame, shared_rates, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over all documents: tokens * rate * membership, tokens * membership * membership, tokens."""

    def part(batches):
        total, gram, tokens = np.zeros(k), np.zeros((k, k)), 0.0
        for b in batches:
            weight = b.column(0).to_numpy().astype(float)
            m = b.column(1).flatten().to_numpy().reshape(b.num_rows, k)
            total += (weight * shared_rates.value.ahead(m)) @ m
            gram += (m * weight[:, None]).T @ m
            tokens += weight.sum()
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary()), pa.array([tokens])], ["total", "gram", "tokens"])

    parts = found.select("n_tokens", "membership").mapInArrow(part, "total binary, gram binary, tokens double").collect()
    return sum((np.frombuffer(p.total) for p in parts), np.zeros(k)), sum((np.frombuffer(p.gram).reshape(k, k) for p in parts), np.zeros((k, k))), sum(p.tokens for p in parts)


def fit_rates(found: DataFrame, shares_to: dict[str, float], names: list[str], kept: list[bool] | None = None) -> Rates:
    """Fit rates of ``found(n_tokens, membership)`` so that each domain's expected total becomes ``shares_to`` times what it is.

    Documents whose most likely domain is ``kept`` get no rate below 1; the others make up for it.

    A round is one pass over the stored memberships; one row of sums per task comes to the driver.
    """
    k = len(names)
    spark = found.sparkSession
    rates = Rates(0.0, kept=None if kept is None else np.array(kept, bool))
    total, gram, tokens = _sums(found, spark.sparkContext.broadcast(rates), k)
    if not k or not tokens:
        return rates
    now, gram = total / tokens, gram / tokens
    target = np.maximum(now * np.array([shares_to.get(n, 1.0) for n in names]), 1e-9)
    scale = 1 / np.sqrt(target)
    rates.step = 1 / (float(np.linalg.eigvalsh(scale[:, None] * gram * scale[None, :]).max()) + PULL)
    last = None
    for _ in range(ROUNDS):
        residual = (now - target) / target
        if last is not None and np.abs(residual - last).max() < CLOSE:
            break
        last = residual
        rates.slopes.append(residual)
        now = _sums(found, spark.sparkContext.broadcast(rates), k)[0] / tokens
    return rates


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, domain)`` of labelled documents: language and quality."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").alias("quality"))
    return docs.select(F.col("doc_id").alias("key"), "lang").join(one, "key").select("key", F.concat_ws(":", F.coalesce("lang", F.lit("?")), F.col("quality").cast("string")).alias("domain"))


def is_low(domain: str) -> bool:
    return domain.rsplit(":", 1)[1] == "0"


def quality_targets(names: list[str], totals: np.ndarray) -> dict[str, float]:
    """Low quality keeps half of its tokens in each language; the good text of the language makes up for it."""
    size = dict(zip(names, totals.tolist(), strict=True))
    out = {}
    for name in names:
        lang, quality = name.rsplit(":", 1)
        low = f"{lang}:0"
        good = sum(n for d, n in size.items() if d.rsplit(":", 1)[0] == lang and d != low)
        out[name] = LOW_QUALITY_TO if quality == "0" else 1 + (1 - LOW_QUALITY_TO) * size.get(low, 0) / good if good else 1.0
    return out


def learn_mix(docs: DataFrame, labels: DataFrame, row: Column) -> tuple[Domains, Rates, DataFrame]:
    """Classifier, rates and the stored memberships with ``row``."""
    scratch = Scratch(docs.sparkSession)
    model = learn_domains(domain_labels(docs, labels), docs)
    found = scratch.keep(memberships(docs, model, row), "memberships")
    k = len(model.names)
    totals, _, _ = _sums(found, docs.sparkSession.sparkContext.broadcast(Rates(0.0)), k)
    good = [not is_low(n) for n in model.names]
    return model, fit_rates(found, quality_targets(model.names, totals), model.names, good), found


def with_rates(found: DataFrame, rates: Rates, k: int) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(rates)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, k)
        return pa.record_batch([*batch.columns, pa.array(shared.value.of(m))], [*batch.schema.names, "rate"])

    return map_batches(found, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", rate double")


def copies_of(rate: Column, *by: Column) -> Column:
    """Whole copies of a row: the rate rounded down or up, by a hash of the row, so that the mean is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(*by), F.lit(1 << 20)) / float(1 << 20)).cast("bigint")


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, domain, n_tokens, membership, rate, copies)`` of every row.

    ``domain`` is that of the largest membership (the first of equals). Null or empty texts have no tokens and the
    membership that the labels' shares give. Without labelled documents: no domains, rate 1. Rows
    are judged one by one, so null or repeated keys stay; a label of a document counts once, the lower
    quality if several. An empty table gives none.
    """
    model, rates, found = learn_mix(docs, labels, F.col("doc_id"))
    rated = with_rates(found, rates, len(model.names))
    names = F.array(*map(F.lit, model.names)) if model.names else F.array().cast("array<string>")
    domain = F.get(names, (F.array_position("membership", F.array_max("membership")) - 1).cast("int"))
    return rated.select(F.col("row").alias("doc_id"), domain.alias("domain"), "n_tokens", "membership", "rate", copies_of(F.col("rate"), F.col("row")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each row as often as its copies say; memberships are found anew, so no text is stored or joined.

    Null and empty texts have the membership that the labels' shares give. Rows are judged one by one: repeated
    rows and rows with null keys are each repeated or left out like others. An empty table gives none; without labelled documents each row
    stays once. Where memberships tie, the first domain decides which rows are kept whole.
    """
    model, rates, _ = learn_mix(docs, labels, F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast((model, rates))

    def rate_of(texts: list[str]) -> list[pa.Array]:
        classifier, fitted = shared.value
        return [pa.array(fitted.of(classifier.membership(classifier.evidence(texts))), pa.float64())]

    rated = with_columns_of(docs, text, rate_of, "rate double")
    copies = copies_of(F.col("rate"), F.col("row.doc_id"))
    repeated = rated.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies))).where(F.col("copy") < copies)
    return unpacked(repeated, docs.columns)
