import numpy as np
import pyarrow as pa
import pytest

from headwater.operators import facts, walk
from headwater.operators.lineage import token_links
from headwater.plans import QUERIES
from headwater.plans import lineage as plans

QUERY = "stmt_id long, seq long, sql string"
ODD = (
    "CREATE TABLE m.a AS SELECT x.lot, max(x.bin) AS top FROM (SELECT lot, bin FROM b.s n WHERE n.bay IN (1, 2) UNION SELECT k, 'q' FROM c.z) x, d.w",
    "SELECT CASE WHEN p THEN CASE WHEN q THEN r ELSE s END ELSE t END AS v, * FROM u JOIN (w.a JOIN (SELECT z FROM y) i) g",
    "INSERT INTO m.b SELECT CAST(a.x AS decimal(3,1)), interval 2 days, k.* , (SELECT 1 FROM h) FROM e.a, k WHERE x IN (a.b)",
    "(SELECT a FROM b) UNION (SELECT c AS `D` FROM e.f ORDER BY g)",
    "SELECT a.b.c, ``.d, 'x' FROM ( SELECT ) ) FROM , case end from a where",
)


def links(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", ["lineage_union", "lineage_derived_table", "lineage_passthrough", "lineage_ctas", "bracketed_owners"])
def test_links_of_a_query_need_no_window_over_tokens(spark, monkeypatch, name):
    """F3, F4, F6, F7, F8: tokens are neither rows nor sorted by Spark."""
    for corpus in ("statements", "nested", "bracketed"):
        monkeypatch.setattr(plans.fx, corpus, lambda spark, folder: spark.createDataFrame([(0, 0, ODD[0])], QUERY))
    plan = QUERIES[name](spark, "")._jdf.queryExecution().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_relations_need_no_window_over_tokens(spark):
    """what relations a statement names is found without the windows over select items."""
    rows = spark.createDataFrame([(0, 0, ODD[0])], QUERY)
    for found in (facts.source_relations(rows), facts.target_relations(rows)):
        assert "Window" not in found._jdf.queryExecution().toString()


def test_relations_are_those_of_the_windows(spark):
    rows = spark.createDataFrame([(i, i, text) for i, text in enumerate(ODD)], QUERY)
    windows = facts.select_tokens(rows).where("relation IS NOT NULL").select("stmt_id", "block_id", "relation.*")
    assert sorted(map(repr, facts.source_relations(rows).collect())) == sorted(map(repr, windows.collect())) != []


def test_names_and_depths_are_those_of_the_windows(spark):
    """Output names by item, told from the links that items without a call or a plain name end with."""
    rows = spark.createDataFrame([(i, i, text) for i, text in enumerate(ODD)], QUERY)
    windows = facts.item_references(rows).where("role = 'literal'").selectExpr("stmt_id", "lower(out_name)", "name")
    found = token_links(rows).where("rule = 'value' AND src.tbl IS NULL AND NOT contains(src.col, '(') AND src.scope LIKE '%/%/%/%'")
    assert set(map(tuple, found.selectExpr("stmt_id", "dst.col", "src.col").collect())) >= {tuple(r) for r in windows.collect() if r[1] != "max()"} - {(0, "k", "q")}


def test_rows_that_share_a_key_are_one_text(spark):
    """Word by word, as a window over the key has it: each word comes twice, so only the first of the two relations follows FROM."""
    rows = spark.createDataFrame([(7, 7, "SELECT a.x FROM d.a, e")] * 2, QUERY)
    windows = facts.select_tokens(rows).where("relation IS NOT NULL").select("stmt_id", "block_id", "relation.*")
    found = facts.source_relations(rows).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, windows.collect()))
    assert [(r.db, r.tbl) for r in found] == [("d", "a"), (None, "e")]


def test_statements_do_not_depend_on_their_neighbours(spark, monkeypatch):
    """However tokens are dealt to batches: all statements in one, one by one, and alone."""
    lists = [["select", text, "from", "t", ",", f"u{text}"] for text in "abcd"] + [["select", "1"]]
    keys, made = ["1", "2", "2", None, "5"], []
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(lists), pa.array([None] * 5, pa.string()), pa.array([None] * 5, pa.string())], ["stmt_key", "tokens", "target_db", "target_tbl"]
    )
    for most, size in ((100_000, 5), (1, 5), (7, 1), (100_000, 2)):
        monkeypatch.setattr(walk, "TOKENS_AT_ONCE", most)
        parts = list(walk._whole_statements(batch.slice(i, size) for i in range(0, 5, size)))
        assert [k for p in parts for k in p.column("stmt_key").to_pylist()] == keys
        assert all(set(p.column("stmt_key").to_pylist()).isdisjoint(q.column("stmt_key").to_pylist()) for p in parts for q in parts if p is not q)
        made.append([row for p in parts for row in zip(*(c.to_pylist() for c in walk._links(walk._read(p), p, False)[1].values()))])
    assert made[0] == made[1] == made[2] == made[3] != []


def test_absent_parts_of_a_packed_vertex_are_empty():
    assert walk.packed("#1/-1/0", None, "t", "") == "#1/-1/0\u0001\u0001t\u0001"


def test_last_and_next_keep_to_their_partition():
    lines = walk._Lines(np.array([2, 1, 2, 1, 2]))
    marked = np.array([True, False, False, True, False])
    assert lines.last(marked).tolist() == [0, -1, 0, 3, 0]
    assert lines.next(marked).tolist() == [-1, 3, -1, -1, -1]
    assert lines.count(marked).tolist() == [1, 0, 1, 1, 1]
