import pytest

from headwater.operators import blocks, facts

# One statement for each construct without a rule, in mixed case, and one that only holds its words.
REJECTED = {
    "lateral view": ("SELECT a FROM t Lateral View explode(b) x", "SELECT lateral FROM view"),
    "set operation": ("SELECT a FROM t INTERSECT SELECT a FROM u", "SELECT minus FROM t"),
    "grouping sets": ("SELECT a FROM t GROUP BY a With Rollup", "SELECT cube FROM t"),
    "limit": ("SELECT a FROM t LIMIT 3", "SELECT limits FROM t"),
    "common table expression": ("CREATE TABLE z AS With w AS (SELECT 1 AS a) SELECT a FROM w", "SELECT width FROM t"),
    "filter clause": ("SELECT sum(a) FILTER (WHERE b) FROM t", "SELECT filter FROM t"),
    "interval": ("SELECT a + Interval (b) FROM t", "SELECT interval FROM t"),
}


def rows(spark, *sqls):
    return spark.createDataFrame([(i, i, s) for i, s in enumerate(sqls)], "stmt_id long, seq long, sql string")


@pytest.mark.parametrize("construct", facts.REJECTED)
def test_constructs_without_a_rule_are_told_from_their_words(spark, construct):
    rejected, plain = REJECTED[construct]
    quoted = f"SELECT '{rejected}' AS s FROM t"
    found = facts.reject_reasons(facts.classify_statements(rows(spark, rejected, plain, quoted, None)))
    assert {r.stmt_id: r.reject for r in found.collect()} == {0: construct, 1: None, 2: None, 3: "statement"}
    assert {r.stmt_id for r in facts.readable(rows(spark, rejected, plain, quoted, None)).collect()} == {1, 2}


def test_strings_of_a_statement_are_taken_out_once(spark, capsys):
    """However many patterns a statement is held against, in a filter too."""
    facts.readable(rows(spark, "SELECT a FROM t")).select("stmt_id").explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(") == 1


def test_a_text_is_cut_into_tokens_once(spark, capsys):
    """Not a second time by a filter, which Spark would take down to the tasks that read the table."""
    blocks.tokenize_statements(rows(spark, "SELECT a FROM t").repartition(3)).explain()
    assert capsys.readouterr().out.count("regexp_extract_all(") == 1


def test_texts_without_tokens_give_none(spark):
    found = blocks.tokenize_statements(rows(spark, "SELECT a", "", None, "/* a */", "b")).collect()
    assert sorted((r.stmt_id, r.pos, r.tok) for r in found) == [(0, 0, "select"), (0, 1, "a"), (4, 0, "b")]
