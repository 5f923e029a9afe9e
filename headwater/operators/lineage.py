"""Column lineage of a statement corpus.

One pass over the tokens gives ``links``: what feeds what, statement by statement. Names
that several relations could own are settled afterwards against the columns seen so far,
and stars are expanded last, when every column is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.functions.text import full_name
from headwater.operators.facts import readable_queries
from headwater.operators.walk import MARK, PLACE, walk_links

__all__ = ["MARK", "PARTS", "PLACE", "token_links", "with_full_names"]

# A vertex is (scope, db, tbl, col). Scope is null for objects named with a database; all
# other objects live in the statement, block or item that mentions them.
PARTS = ("scope", "db", "tbl", "col")


def unpacked(parts: str) -> str:
    """SQL for the struct of a packed vertex, cut into an array of its parts; null for null."""
    fields = ", ".join(f"'{p}', nullif(element_at({parts}, {i + 1}), '')" for i, p in enumerate(PARTS))
    return f"CASE WHEN {parts} IS NOT NULL THEN named_struct({fields}) END"


def token_links(statements: DataFrame, with_else: bool = False, by_place: bool = False) -> DataFrame:
    """``links(stmt_id, seq, rule, src, dst, candidates)`` of every readable statement.

    A link without ``dst`` only says that its ``src`` is mentioned. ``by_place``: a column that INSERT fills is named by the
    item's number and name, for ``catalog.place_columns`` to turn into the column at that place; items behind a star keep their names.
    """
    # Each end is cut once; its parts are read four times. A list of one row keeps filters of the parts behind the cut, where they do not repeat it.
    parts = ", ".join(f"'{end}_parts', split({end}, '{MARK}')" for end in ("src", "dst"))
    return (
        walk_links(readable_queries(statements, by_place), with_else)
        .selectExpr("stmt_id", "seq", "rule", "candidates", f"inline_outer(array(named_struct({parts})))")
        .selectExpr("stmt_id", "seq", "rule", f"{unpacked('src_parts')} AS src", f"{unpacked('dst_parts')} AS dst", "candidates")
    )


def with_full_names(links: DataFrame) -> DataFrame:
    """Full names of both ends, as ``src`` and ``dst``."""
    name = lambda end: F.when(F.col(end).isNotNull(), full_name(*(F.col(f"{end}.{p}") for p in PARTS[1:])))
    return links.withColumns({"src": name("src"), "dst": name("dst")})
