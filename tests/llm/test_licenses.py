import random
import re

import pytest

from headwater.llm import licenses
from headwater.llm.queries import ORACLES, QUERIES
from tests.llm.twins import same_as_twin


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def spans_of(found, templates):
    for label, text in {(label, tuple(words(t))) for label, t in templates}:
        on = {}
        for i in range(len(found) - 2):
            for j in range(len(text) - 2):
                if tuple(found[i : i + 3]) == text[j : j + 3]:
                    on.setdefault(i - j, []).append((i, j))
        merged, last = [], None
        for d in sorted(on):
            if last is None or d - last > licenses.NEIGHBOURS:
                merged.append([])
            merged[-1] += on[d]
            last = d
        for m in merged:
            share = len({j + k for _, j in m for k in range(3)}) / len(text)
            if share >= licenses.LEAST_SHARE:
                yield label, min(i for i, _ in m), max(i for i, _ in m) + 2, len(m), share


def brute(text, templates=licenses.TEMPLATES):
    found = words(text)
    places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(found)) if tuple(found[i : i + len(p)]) == p)
    spans = list(spans_of(found, templates))
    base = {label for _, label in places}
    return (
        len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), len(spans), 1.0 if places else max((s[4] for s in spans), default=0.0),
    )


TEXTS = [
    None, "", " .,- \n", "cc", "cc by", "CC\tBY cc-by by cc by", "ccby cc byx", "all rights reserved all rights reserved", "the general public licenses; General Public License!",
    "x y Released under the MIT License.", "released under a MIT License", "Released under the very MIT License", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0",
    "Éa übe 123 Ünder Ärzte", "Licensed under the Licensed under the " * 300 + "apache license version 2 0", "released under the mit license " * 500,
    "Redistribution and use in source and binary forms, with or w/o modification, are permitted provided that the following conditions are met:",
    "permission is hereby granted free of charge to any person", "w " * 40_000 + "this work is licensed under the gnu general public license version 3",
]


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in words(t)})
    made = []
    for _ in range(60):
        cut = words(rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(cut))
            cut[at : at + rng.randrange(2)] = rng.choices(pool, k=rng.randrange(2))
        made.append(" ".join([*rng.choices(pool, k=rng.randrange(9)), *cut, *rng.choices(pool, k=rng.randrange(9))]))
    rows = [(i, t, "c", 1) for i, t in enumerate(TEXTS + made)] + [(None, TEXTS[4], "c", 1), (3, TEXTS[4], "c", 1), (3, TEXTS[4], "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, labels string, rec int")
    got = sorted(map(tuple, licenses.scan_licenses(df).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=repr)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    listed = sorted(map(tuple, licenses.license_spans(df.where("doc_id > 8")).collect()))
    assert listed == sorted((i, *s) for i, t, _, _ in rows if i is not None and i > 8 for s in spans_of(words(t), licenses.TEMPLATES))


def test_own_templates(spark):
    df = spark.createDataFrame([(1, "you may use a b c d of it, cc by"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    own = [("own", "A b c D"), ("own", "a b c d"), ("short", "a b"), ("none", None), (None, "a b c")]
    given = spark.createDataFrame(own, "label string, text string")
    got = {r.doc_id: (r.labels, r.n_spans, r.score) for r in licenses.scan_licenses(df, given).collect()}
    assert got == {1: ("cc-by,own", 1, 1.0), 2: ("", 0, 0.0), 3: ("", 0, 0.0)}
    assert {r.labels for r in licenses.scan_licenses(df, given.limit(0)).collect()} == {"", "cc-by"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_twin(spark, sf):
    same_as_twin(spark, QUERIES["op13_license_scans"], ORACLES["op13_license_scans"], sf)


def test_no_python_in_the_plan(spark, documents):
    plan = licenses.scan_licenses(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
