"""Secrets in texts, with DataFrame functions only.

Three fixed patterns give the base spans. Beside them, strings that look random are found by
Shannon entropy over a sliding window: each step takes one character out of the window's counts
and puts one in, and changes the sum of count * log2(count) by just these two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order that spans of one start take.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short from its first AKIA on is so from any later one
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

WINDOW = 20
# Candidate strings, the classes tried on them in this order, and the bits per character at which a
# window of the class looks random. A window of 20 has at most log2(20) = 4.32 bits.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
CLASSES = ((r"^[0-9A-Fa-f]+$", 3.1), (r"^[0-9A-Za-z]+$", 3.7), (r"", 3.9))
# What is not a secret however random it looks, judged on whole candidates without the separators at their ends:
# words and names in letters only (joined or not), identifiers in the form of a UUID, paths of several parts. Loops are over single
# characters or possessive, so that Java neither recurses nor steps back, however long the candidate is.
ALLOWED = (
    r"^[A-Za-z][A-Za-z/_=+-]*+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[-_=+/]*$",
    r"^/?[a-z0-9_-]++(?:/[a-z0-9_-]++){2,}+/?$",
)
SEPARATORS = "-_=+/"
# Dates, placeholders and rows of separators, each with its length: their characters count as one repeated
# character, so they are not random themselves and clear nothing beside them.
COVERED = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 10),
    (r"(?i)placeholder", 11),
    (r"(?i)changeme", 8),
    (r"(?i)example", 7),
    (r"(?i)your[-_]", 5),
    (r"(?i)xxxx|0000|[-_=+/]{4}", 4),
)
# Sums are kept as whole millionths, so a step back undoes a step forward exactly.
SCALE = 1_000_000
TERMS = [round(SCALE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
BLOCK = 256  # running sums over long arrays go by blocks


def _running(lengths: str) -> str:
    """SQL for the sum of all earlier elements at each element of an array of ints.

    Sums run inside blocks and over the blocks' totals, so that a text with very many matches does
    not copy its array once per match.
    """

    def fold(array: str) -> str:
        return f"aggregate({array}, named_struct('s', 0, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('s', a.s + x, 'out', array_append(a.out, a.s)), a -> a.out)"

    blocks = f"transform(sequence(0, size({lengths}) - 1, {BLOCK}), b -> slice({lengths}, b + 1, {BLOCK}))"
    totals = f"transform({blocks}, b -> aggregate(b, 0, (a, x) -> a + x))"
    inside = f"zip_with({blocks}, {fold(totals)}, (b, o) -> transform({fold('b')}, y -> y + o))"
    return f"if(size({lengths}) > 0, flatten({inside}), cast(array() AS array<int>))"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def with_matches(df: DataFrame, text: str, kind: str, pattern: str) -> DataFrame:
    """Add array ``kind`` of (start, end, hit): leftmost non-overlapping matches, code points, end exclusive."""
    # Most texts hold no match of a kind; they are not copied into gaps.
    found = df.withColumn("_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).withColumn("_gaps", F.when(F.size("_hits") > 0, F.split(text, pattern, -1)))
    # What lies before hit i: gaps 0..i and hits 0..i-1.
    steps = found.withColumn("_steps", F.expr("transform(_hits, (h, i) -> length(_gaps[i]) + if(i > 0, length(_hits[i - 1]), 0))"))
    starts = steps.withColumn("_starts", F.expr(_running("_steps")))
    spans = F.expr("transform(_hits, (h, i) -> named_struct('start', _starts[i] + _steps[i], 'end', _starts[i] + _steps[i] + length(h), 'hit', h))")
    return starts.withColumn(kind, spans).drop("_hits", "_gaps", "_steps", "_starts")


def least_sum(candidate: str) -> str:
    """SQL for the least sum of count * log2(count) over the windows of a string; the most random window has it.

    The counts that change are read off the window's characters, so a step costs the same anywhere
    in a long string.
    """
    terms = "array(" + ", ".join(f"{t}" for t in TERMS) + ")"

    def count(of: str, start: str, size: str) -> str:
        return f"size(filter(slice(z.c, greatest({start}, 1), {size}), x -> x = z.c[{of}]))"

    # i counts characters from 0; the window before it holds i - W .. i - 1.
    gone = count(f"i - {WINDOW}", f"i - {WINDOW - 1}", f"{WINDOW}")
    come = count("i", f"i - {WINDOW - 2}", f"least(i, {WINDOW - 1})")
    minus = f"if(i >= {WINDOW}, {terms}[{gone} - 1] - {terms}[{gone}], 0)"
    plus = f"{terms}[{come} + 1] - {terms}[{come}]"
    now = f"a.s + {minus} + {plus}"
    step = f"named_struct('s', {now}, 'least', if(i >= {WINDOW - 1}, least(a.least, {now}), a.least))"
    # A list of one lends its name to the characters.
    fold = f"aggregate(sequence(0, size(z.c) - 1), named_struct('s', 0, 'least', 2147483647), (a, i) -> {step}, a -> a.least)"
    return f"transform(array(named_struct('c', split({candidate}, ''))), z -> {fold})[0]"


def looks_random(candidate: str) -> str:
    """SQL: some window of the candidate has the entropy of its class, and no allow-list entry fits.

    Separators at its ends do not count, unless fewer characters than a window are left without them.
    """
    top = WINDOW * math.log2(WINDOW)
    limits = " ".join(f"WHEN y.core RLIKE {_literal(p)} THEN {round(SCALE * (top - WINDOW * bits))}" for p, bits in CLASSES)
    allowed = " OR ".join(f"y.core RLIKE {_literal(p)}" for p in ALLOWED)
    judged = f"if(length(y.core) >= {WINDOW}, y.core, {candidate})"
    for pattern, size in COVERED:
        judged = f"regexp_replace({judged}, {_literal(pattern)}, '{' ' * size}')"
    core = f"trim(BOTH '{SEPARATORS}' FROM {candidate})"
    return f"transform(array(named_struct('core', {core})), y -> if({allowed}, false, {least_sum(judged)} <= CASE {limits} END))[0]"


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: sorted arrays of (start, kind_no, end, kind). Null text counts as empty."""
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    for kind, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_candidates", CANDIDATE)):
        df = with_matches(df, "_text", kind, pattern)
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(F.regexp_extract(m.hit, ASSIGN, 2)) >= LEAST_ASSIGNED))

    def named(kind: str, number: int) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(m.start.alias("start"), F.lit(number).alias("kind_no"), m.end.alias("end"), F.lit(kind).alias("kind")))

    df = df.withColumn("base", F.array_sort(F.concat(named("assign", 0), named("access", 1), named("hex", 2))))
    df = df.withColumn("_entropy", F.expr(f"filter(_candidates, m -> NOT exists(base, b -> b.start <= m.start AND b.end >= m.end) AND {looks_random('m.hit')})"))
    df = df.withColumn("spans", F.array_sort(F.concat("base", named("entropy", 3))))
    return df.drop("_assign", "_access", "_hex", "_candidates", "_entropy")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)`` of every row, whole texts.

    Null or empty text: no spans, the digest of the empty text. Rows are scanned one by one, so null or
    repeated keys stay as they are; other columns, whatever their names, are not read. Spans of
    one start are ordered by kind; an entropy span inside a base span is not listed again. An
    empty table gives none.
    """
    found = with_spans(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(F.col("key").alias(key), *map(count, ("assign", "access", "hex", "entropy")), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by ``mask``; overlapping spans by one.

    A text without spans, null included, stays as it is.
    """
    columns = docs.columns
    found = with_spans(docs.select(F.struct("*").alias("_row"), F.col(text).alias("text")))
    kept = f"""aggregate(spans, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', if(s.start < a.at, a.out, array_append(a.out, substring(_text, a.at + 1, s.start - a.at)))),
        a -> array_join(array_append(a.out, substring(_text, a.at + 1)), '{mask}'))"""
    done = found.withColumn("_clean", F.when(F.size("spans") > 0, F.expr(kept)).otherwise(F.col("text")))
    return done.select(*(F.col("_clean").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in columns))
