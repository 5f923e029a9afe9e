"""License notices in texts by diagonal voting, with DataFrame functions only.

Texts and templates are cut into words, and every run of three words is hashed. All rolling hashes
of all texts are joined with the places of the templates' hashes. A match votes for its diagonal, the
offset between the word's place in the text and in the template; words that follow a template without
a gap all vote for one diagonal. Diagonals that lie next to each other (a word put in or left out) are
merged into one span, and a span counts when its verified matches cover a large enough share of the
template's words. A match is verified by a second, independent hash of the run's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import Scratch

# Letters that are lower-cased, what stands between words, and the base phrases with their labels.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))

RUN = 3  # words of a run that is hashed
NEIGHBOURS = 2  # diagonals at most so far apart are merged
LEAST_SHARE = 0.75  # of a template's words
BROADCAST_RUNS = 100_000  # runs of all templates, some 100 bytes each

# Sentences of public license notices, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of a text as an array; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _runs(words: str) -> Column:
    """Of every run of words, in order, two independent hashes made from the hashes of its single words."""
    hashes = f"array(named_struct('a', transform({words}, w -> xxhash64(w)), 'b', transform({words}, w -> hash(w))))"  # an array of one, so that its element gets a name
    each = lambda of: ", ".join(f"get(h.{of}, i + {k})" for k in range(RUN))
    rolling = f"transform({hashes}, h -> transform(sequence(0, size(h.a) - {RUN}), i -> named_struct('run', xxhash64({each('a')}), 'check', xxhash64({each('b')}))))[0]"
    return F.expr(f"if(size({words}) >= {RUN}, {rolling}, cast(array() AS array<struct<run: bigint, check: bigint>>))")


def _phrase_starts(words: str, phrase: tuple[str, ...]) -> str:
    """SQL for the places where the phrase's words stand one after the other."""
    same = " AND ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(phrase))
    return f"filter(sequence(0, greatest(size({words}) - {len(phrase)}, 0)), i -> {same})"


def template_runs(templates: DataFrame) -> DataFrame:
    """``(run, check, template, label, n_template, place)`` of ``templates(label, text)``.

    Equal templates of one label count once. A template of fewer words than a run has no runs.
    """
    cut = templates.where("label IS NOT NULL").select("label", words_of(F.col("text")).alias("words")).distinct()
    named = cut.select(F.xxhash64("label", F.array_join("words", " ")).alias("template"), "label", "words")
    placed = named.select("template", "label", F.size("words").alias("n_template"), F.posexplode(_runs("words")).alias("place", "at"))
    return placed.select("at.run", "at.check", "template", "label", "n_template", "place")


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "label string, text string")


def _matches(docs: DataFrame, templates: DataFrame, key: str, text: str) -> DataFrame:
    """One row with ``n_words`` and the base phrases per text, and one per match of a run, stored.

    A text's own row is the first of its exploded runs, number -1, so that texts are cut once and
    nothing has to be joined back to them. A run carries two hashes and its place, never the text. The templates' runs are
    counted, and broadcast while they are few; else both sides are dealt by hash.
    """
    runs = template_runs(templates)
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    given = docs.select(F.monotonically_increasing_id().alias("rec"), F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    phrases = (F.expr(_phrase_starts("words", p)).alias(f"b{i}") for i, (p, _) in enumerate(PHRASES))
    found = given.select("rec", "key", F.struct(F.size("words").cast("bigint").alias("n_words"), *phrases).alias("facts"), _runs("words").alias("runs"))
    none = F.struct(F.lit(None).cast("bigint").alias("run"), F.lit(None).cast("bigint").alias("check"))
    rows = found.select("rec", "key", "facts", F.posexplode(F.concat(F.array(none), "runs")).alias("n", "at"))
    own = lambda c: F.when(F.col("n") == 0, F.col(c)).alias(c)
    compact = rows.select("rec", own("key"), own("facts"), (F.col("n") - 1).alias("pos"), "at.run", "at.check")
    matched = compact.join(runs, ["run", "check"], "left").where("pos = -1 OR place IS NOT NULL")
    return Scratch(docs.sparkSession).keep(matched.drop("run", "check"), "matches")


def _spans(matches: DataFrame) -> DataFrame:
    """``(rec, label, first_word, last_word, votes, share)``: verified spans, last word included."""
    voted = matches.where("pos >= 0").groupBy("rec", "template", "label", "n_template", (F.col("pos") - F.col("place")).alias("diagonal"))
    diagonals = voted.agg(F.min("pos").alias("first"), (F.max("pos") + RUN - 1).alias("last"), F.count(F.lit(1)).alias("votes"), F.collect_set("place").alias("places"))
    in_order = Window.partitionBy("rec", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > NEIGHBOURS, F.lit(False)).cast("int")
    numbered = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(in_order))
    spans = ["rec", "template", "label", "n_template", "span"]
    extents = numbered.groupBy(*spans).agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.sum("votes").alias("votes"))
    # Places of one span are a set of at most the template's length, however many diagonals were merged.
    covered = numbered.select(*spans, F.explode("places").alias("place")).groupBy(*spans).agg(F.collect_set("place").alias("places"))
    words = F.expr(f"size(array_distinct(flatten(transform(places, p -> sequence(p, p + {RUN - 1})))))")
    judged = extents.join(covered, spans).withColumn("share", words / F.col("n_template"))
    return judged.where(F.col("share") >= LEAST_SHARE).select("rec", "label", "first_word", "last_word", "votes", "share")


def license_spans(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, label, first_word, last_word, votes, share)`` of every verified span, words counted from 0.

    ``templates(label, text)`` default to the notices above. Templates with words in common can each have
    a span over the same words. ``share`` is the part of the template's words that its matches cover.
    """
    matches = _matches(docs, templates if templates is not None else default_templates(docs.sparkSession), key, text)
    names = matches.where("pos = -1").select("rec", F.col("key").alias(key))
    return names.join(_spans(matches), "rec").drop("rec")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_base, first_word, last_word, base_labels, labels, n_spans, score)`` of every row, whole texts.

    ``n_base``, ``first_word`` and ``last_word``: places of the base phrases. ``labels``: those of the phrases and of the
    verified spans. ``score``: 1 where a base phrase stands, else the largest share of a span, else 0. A null
    or empty text has no words and no labels ('' each). Rows are scanned one by one, so null or repeated keys stay
    as they are; other columns, whatever their names, are not read. Places of equal shares all count. An empty table gives
    none, and without templates only the base phrases count.
    """
    matches = _matches(docs, templates if templates is not None else default_templates(docs.sparkSession), key, text)
    places = F.array_sort(F.concat(*(F.col(f"facts.b{i}") for i in range(len(PHRASES)))))
    phrases = F.filter(F.array(*(F.when(F.size(f"facts.b{i}") > 0, label) for i, (_, label) in enumerate(PHRASES))), lambda x: x.isNotNull())
    texts = matches.where("pos = -1").select("rec", "key", F.col("facts.n_words").alias("n_words"), places.alias("places"), phrases.alias("phrases"))
    spans = _spans(matches).groupBy("rec").agg(F.collect_set("label").alias("found"), F.count(F.lit(1)).alias("n_spans"), F.max("share").alias("share"))
    both = texts.join(spans, "rec", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.get("places", F.lit(0)).cast("bigint").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("bigint").alias("last_word"),
        joined(F.col("phrases")).alias("base_labels"),
        joined(F.concat("phrases", "found")).alias("labels"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^{BETWEEN[1:]}')"


_RUN_SQL = ", ' ', ".join(["w", *(f"lead(w, {k}) OVER p" for k in range(1, RUN))])
ORACLE = rf"""
WITH given AS (SELECT row_number() OVER () AS rec, doc_id, {_words_sql("text")} AS words FROM documents),
template AS (SELECT row_number() OVER () AS template, * FROM (SELECT DISTINCT label, {_words_sql("text")} AS words FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}) t(label, text))),
word AS (SELECT rec, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM given),
run AS (SELECT rec, pos, CASE WHEN lead(w, {RUN - 1}) OVER p IS NOT NULL THEN concat({_RUN_SQL}) END AS run FROM word WINDOW p AS (PARTITION BY rec ORDER BY pos)),
tword AS (SELECT template, label, len(words) AS n_template, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS place FROM template),
trun AS (SELECT template, label, n_template, place, CASE WHEN lead(w, {RUN - 1}) OVER p IS NOT NULL THEN concat({_RUN_SQL}) END AS run FROM tword WINDOW p AS (PARTITION BY template ORDER BY place)),
hit AS (SELECT rec, pos, template, label, n_template, place, pos - place AS diagonal FROM run JOIN trun USING (run)),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rec, template ORDER BY diagonal) > {NEIGHBOURS} THEN 1 ELSE 0 END AS apart
          FROM (SELECT DISTINCT rec, template, diagonal FROM hit)),
span AS (SELECT rec, template, diagonal, sum(apart) OVER (PARTITION BY rec, template ORDER BY diagonal) AS span FROM apart),
covered AS (SELECT rec, template, label, span, CAST(count(DISTINCT place + k) AS DOUBLE) / n_template AS share FROM hit JOIN span USING (rec, template, diagonal), range(0, {RUN}) t(k) GROUP BY rec, template, label, span, n_template),
found AS (SELECT rec, list(DISTINCT label) AS found, count(*) AS n_spans, max(share) AS share FROM covered WHERE share >= {LEAST_SHARE} GROUP BY rec),
place AS (SELECT rec, pos, label FROM (SELECT rec, pos, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM word WINDOW p AS (PARTITION BY rec ORDER BY pos)),
          (VALUES {", ".join("(" + ", ".join([*map(_quoted, p), *["NULL"] * (3 - len(p)), _quoted(label)]) + ")" for p, label in PHRASES)}) t(p0, p1, p2, label)
          WHERE w = p0 AND w1 = p1 AND (p2 IS NULL OR w2 = p2)),
base AS (SELECT rec, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS phrases FROM place GROUP BY rec)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(phrases, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(phrases, []), coalesce(found, [])))), ',') AS labels,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM given LEFT JOIN base USING (rec) LEFT JOIN found USING (rec)
"""
