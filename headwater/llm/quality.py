"""Quality rules whose thresholds follow the data: one mergeable quantile sketch per language and source.

A sketch is a table of (bucket, count): values up to 64 are kept as they are, larger ones by their
leading six bits, so a bucket is at most 1/32 wide of its value. Sketches merge by adding counts,
in any order, with the same result; those of the sources of a language make that of the language.
They hold what the documents show that pass the base rule, values of 0 left out: most documents
repeat nothing, and how much is usual where there is some is what differs between sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import Scratch, map_batches, texts_of

BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
# Per metric, a scaled integer: whether low values fail as well, and the least spread that counts, so
# that values that all agree do not make every other one an outlier: a fixed one, or half the median.
METRICS = {"word_length": (True, 40), "symbols": (False, None), "dup_lines": (False, None), "repeats": (False, None)}
# How many spreads from the median a value may lie.
REACH = 5
# A metric with fewer values in a group takes the sketch of the language, then that of all documents.
LEAST_VALUES = 30


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of five found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code, bound = ids[:n], distinct
    for k in range(1, WINDOW):
        if bound >= 2**62 // max(distinct, 1):
            values, code = np.unique(code, return_inverse=True)
            bound = len(values)
        code, bound = code * distinct + ids[k : k + n], bound * distinct
    order = np.argsort(code)
    same = np.diff(code[order]) == 0
    if not same.any():
        return 0
    twice = order[np.r_[same, False] | np.r_[False, same]]
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[twice] += 1
    edge[twice + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines with a word, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    index: dict[bytes, int] = {}
    ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int64, len(words))
    return len(words), len(text) - blanks, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(ids, len(index))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def document_counts(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    kinds = [docs.schema[c].dataType.simpleString() for c in (key, lang, source)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t) for t in texts_of(batch.column(3))]
        columns = [pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *columns], ["key", "lang", "source", *COUNTS])

    given = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    return map_batches(given, run, f"key {kinds[0]}, lang {kinds[1]}, source {kinds[2]}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def bucket(value: Column) -> Column:
    """The lowest value of the sketch bucket: all but the leading six bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def with_metrics(counts: DataFrame) -> DataFrame:
    def share(what: str, of: str, scale: int) -> Column:
        return F.expr(f"if({of} > 0, ({scale} * {what}) div {of}, 0)")

    return counts.withColumns(
        {"word_length": share("word_chars", "n_words", 100), "symbols": share("n_symbols", "n_words", 10_000), "dup_lines": share("n_dup_lines", "n_lines", 10_000), "repeats": share("n_repeat_words", "n_words", 10_000)}
    )


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, metric, bucket, n)``: partial sums per task, then one row per bucket."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS))).alias("v")
    found = measured.where(~F.expr(BASE_FAILED)).select("lang", "source", values).where("v.bucket > 0")
    return found.groupBy("lang", "source", "v.metric", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def _bounds(metric: str) -> dict[str, str]:
    """The least and the greatest value that passes, from the quantiles; the same in Spark and in the SQL twin."""
    both, least = METRICS[metric]
    at = lambda p: f"{metric}_{p}"
    floor = str(least) if least else f"CAST(floor({at(50)} / 2) AS BIGINT)"
    low = f"{at(50)} - {REACH} * greatest({at(90)} - {at(50)}, {floor})" if both else "0"
    # The lower half shows the spread of good text even where much of the upper half is bad.
    return {f"{metric}_low": low, f"{metric}_high": f"{at(50)} + {REACH} * greatest({at(50)} - {at(10)}, {floor})"}


BOUNDS = {name: text for m in METRICS for name, text in _bounds(m).items()}


def fences(sketch: DataFrame, by: list[str], suffix: str) -> DataFrame:
    """Per group and metric: how many values its sketch holds, the least and the greatest value that passes.

    A window holds the buckets of one metric of one group: below 2,000 rows, whatever the input.
    """
    group = Window.partitionBy(*by, "metric")
    up_to = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.select(*by, "metric", "bucket", up_to.alias("up_to"), F.sum("n").over(group).alias("of"))

    def quantile(percent: int, metric: str) -> Column:
        return F.min(F.when((F.col("metric") == metric) & (100 * F.col("up_to") >= percent * F.col("of")), F.col("bucket")))

    quantiles = [quantile(p, m).alias(f"{m}_{p}") for m in METRICS for p in (10, 50, 90)]
    sizes = [F.coalesce(F.max(F.when(F.col("metric") == m, F.col("of"))), F.lit(0)).alias(f"{m}_n") for m in METRICS]
    found = ranked.groupBy(*by).agg(*sizes, *quantiles)
    return found.select(*by, F.struct(*(f"{m}_n" for m in METRICS), *(F.expr(text).cast("bigint").alias(name) for name, text in BOUNDS.items())).alias(f"fence{suffix}"))


def group_fences(sketch: DataFrame) -> DataFrame:
    """``(lang, source, fence)``: per metric of the group if it has enough values, else of its language, else of all."""
    by_lang = merge(sketch, ["lang"])
    groups = fences(sketch, ["lang", "source"], "")
    langs = fences(by_lang, ["lang"], "_lang").withColumnRenamed("lang", "l")
    whole = fences(merge(by_lang, []).withColumn("one", F.lit(1)), ["one"], "_all")
    joined = groups.withColumn("one", F.lit(1)).join(langs, F.col("lang").eqNullSafe(F.col("l"))).join(whole, "one")

    def chosen(metric: str, end: str) -> Column:
        of = lambda suffix, name: F.col(f"fence{suffix}.{metric}_{name}")
        return F.when(of("", "n") >= LEAST_VALUES, of("", end)).when(of("_lang", "n") >= LEAST_VALUES, of("_lang", end)).otherwise(of("_all", end)).alias(f"{metric}_{end}")

    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), F.struct(*(chosen(m, e) for m in METRICS for e in ("low", "high"))).alias("fence"))


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` per row.

    Null or empty text has no words and fails the base rule. A null language or source is a group of
    its own. Repeated rows are judged one by one and count in the sketches; a text of one word or of
    millions is measured whole. Columns with other names are not read. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(with_metrics(document_counts(docs, key, text, lang, source)), "counts")
    limits = group_fences(scratch.keep(sketches(measured), "sketches"))
    judged = measured.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed = F.expr(BASE_FAILED)
    # A metric that is 0 in every document has no fence.
    inside = [F.coalesce(F.col(m).between(F.col(f"fence.{m}_low"), F.col(f"fence.{m}_high")), F.lit(True)) for m in METRICS]
    passes = inside[0] & inside[1] & inside[2] & inside[3]
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes).alias("kept"))


def _fence_sql(by: str, suffix: str) -> str:
    quantiles = ", ".join(f"min(bucket) FILTER (metric = '{m}' AND 100 * up_to >= {p} * of) AS {m}_{p}" for m in METRICS for p in (10, 50, 90))
    sizes = ", ".join(f"coalesce(max(of) FILTER (metric = '{m}'), 0) AS {m}_n" for m in METRICS)
    return f"""
    fence{suffix} AS (
      SELECT *, {", ".join(f"{text} AS {name}" for name, text in BOUNDS.items())} FROM (
        SELECT {by}, {sizes}, {quantiles}
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}, metric ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {by}, metric) AS of
              FROM (SELECT {by}, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL))
        GROUP BY {by}))"""


_CHOSEN = ", ".join(
    f"CASE WHEN g.{m}_n >= {LEAST_VALUES} THEN g.{m}_{e} WHEN l.{m}_n >= {LEAST_VALUES} THEN l.{m}_{e} ELSE a.{m}_{e} END AS {m}_{e}" for m in METRICS for e in ("low", "high")
)
ORACLE = rf"""
WITH given AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
word AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM given)),
gram AS (SELECT rid, i, w, CASE WHEN lead(w, 4) OVER p IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) END AS g
         FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)),
seen AS (SELECT rid, i, w, CASE WHEN g IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY rid, g) END AS c FROM gram),
cover AS (SELECT rid, w, max(c) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM seen),
words AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (c >= 2) AS n_repeat_words FROM cover GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM given) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (SELECT rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM given LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid)),
measured AS (SELECT *, CASE WHEN n_words > 0 THEN (100 * word_chars) // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN (10000 * n_symbols) // n_words ELSE 0 END AS symbols,
             CASE WHEN n_lines > 0 THEN (10000 * n_dup_lines) // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN (10000 * n_repeat_words) // n_words ELSE 0 END AS repeats FROM counts),
passing AS (SELECT * FROM measured WHERE NOT ({BASE_FAILED})),
long AS (SELECT lang, source, metric, CAST(v AS BIGINT) AS v FROM (UNPIVOT passing ON word_length, symbols, dup_lines, repeats INTO NAME metric VALUE v)),
sketch AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n, 1 AS one FROM long WHERE v > 0 GROUP BY ALL),
{_fence_sql("lang, source", "_group")},
{_fence_sql("lang", "_lang")},
{_fence_sql("one", "_all")},
fence AS (SELECT g.lang, g.source, {_CHOSEN} FROM fence_group g JOIN fence_lang l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN fence_all a),
judged AS (SELECT m.*, {BASE_FAILED} AS failed, {" AND ".join(f"coalesce({m} BETWEEN {m}_low AND {m}_high, TRUE)" for m in METRICS)} AS inside
           FROM measured m LEFT JOIN fence f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed, NOT failed AND inside AS kept
FROM judged
"""
