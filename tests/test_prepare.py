import random

import pytest
from pyspark.sql import functions as F

from headwater.functions import text
from headwater.operators import prepare


def by_states(line):
    """The rule said one character at a time."""
    out, state = "", "text"
    for c in line:
        if state == "text":
            out += c
            state = {"'": "'", '"': '"', "-": "dash"}.get(c, "text")
        elif state == "dash":
            if c == "-":
                return out[:-1]
            out += c
            state = "text"
        else:
            out += c
            state = "text" if c == state else state
    return out


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("s")).alias("o")).collect())]


def test_comments_follow_the_states(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice("ab-'\" ;") for _ in range(rng.randrange(0, 25))) for _ in range(4000)]
    lines += ["ab-'" * 5000 + "--x", "-" * 20001, "'" + "-" * 20000]
    assert column(spark, lines, text.strip_dash_comment) == [by_states(s) for s in lines]


@pytest.mark.parametrize(
    "given, kept",
    [("test", "test"), ("test-- comm", "test"), ('test--"rrr', "test"), ('test"ti--ti', 'test"ti--ti'), ("test'ti--ti", "test'ti--ti"), ('test"--"--ti--ti', 'test"--"')],
)
def test_comment_pairs(spark, given, kept):
    assert column(spark, [given], text.strip_dash_comment) == [kept]


def test_line_rules(spark):
    assert column(spark, ["#x", " #x", "", None], text.drop_hash_line) == ["", " #x", "", None]
    assert column(spark, ["a STORED AS PARQUET b", "stored as parquet"], text.erase_keywords) == ["a  b", "stored as parquet"]
    given = ["${x}", "DB ${BDD}${BIF_ENV^^} ${p:v^} z", "${a b}", None]
    assert column(spark, given, text.substitute_variables) == ["x", "DB BDDBIF_ENV p-v z", "${a b}", None]


def brute_statements(lines):
    found = {}
    for file in {f for f, _, _ in lines}:
        body = " ".join(t for _, _, t in sorted(x for x in lines if x[0] == file))
        for i, part in enumerate(body.split(";")):
            part = part.strip("".join(map(chr, range(33))))
            if part:
                found[(file, i)] = part
    return found


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_statements_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(prepare, "LINE_BLOCK", block)
    rng = random.Random(block)
    rows = []
    for file, n in (("hot", 400), ("a", 30), ("b", 1), ("no_end", 9)):
        for i in range(n):
            word = "".join(rng.choice(["x", " ", "\t", "y"] + ([";"] if file != "no_end" else [])) for _ in range(rng.randrange(0, 8)))
            rows.append((file, i * 3, word))
    df = spark.createDataFrame(rows, "file string, line_no bigint, line string").repartition(5)
    got = {(r.file, r.seq): r.sql for r in prepare.split_statements(df).collect()}
    assert got == brute_statements(rows)


def test_whole_preparation(spark):
    lines = ["#@ head ; x", "set a=b; -- c ; d", "CREATE TABLE ${DB}.t STORED AS PARQUET AS", "SELECT \"x--y\" AS a FROM ${p:q}.s;", "  ;"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file string, line_no bigint, line string")
    got = [r.sql for r in prepare.prepare_scripts(df).orderBy("seq").collect()]
    assert got == ["set a=b", 'CREATE TABLE DB.t  AS SELECT "x--y" AS a FROM p-q.s']
