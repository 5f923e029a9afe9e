"""Facts about statements: kind, target, relations, select items, references, rejects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions import tokens as T
from headwater.operators.blocks import BY_BLOCK, SO_FAR, WHOLE, nest_blocks, with_roles
from headwater.operators.walk import UNNAMED, walk_relations

_NAME = r"([\p{L}\p{N}_$`.]+)"
_CREATE = r"^\s*create\s+(?:external\s+|temporary\s+)*table\s+(?:if\s+not\s+exists\s+)?" + _NAME
_INSERT = r"^\s*insert\s+(?:into|overwrite)\s+(?:table\s+)?" + _NAME
_LIKE = _CREATE + r"\s+like\s+" + _NAME



_UNITS = "|".join(T.INTERVAL_UNITS)
# Kinds of statement, each with the pattern of its head; the first that fits counts.
KINDS = {
    "drop": r"^\s*drop\s+(table|view)\b",
    "rename": r"^\s*alter\s+table\s+\S+\s+rename\s+to\b",
    "set": r"^\s*set\b",
    "create_database": r"^\s*create\s+(database|schema)\b",
    "create_like": _LIKE,
    "ctas": _CREATE + r".*?\bselect\b",
    "create_schema": _CREATE,
    "insert": _INSERT + r".*?\bselect\b",
    "select": r"^[\s(]*select\b",
}
READ_KINDS = ("ctas", "insert", "select")
# Constructs without a lineage rule; a statement that holds one is reported instead.
REJECTED = {
    "lateral view": r"\blateral\s+view\b",
    "set operation": r"\b(intersect|except|minus)\b\s+(all\s+|distinct\s+)?\(?\s*select\b",
    "grouping sets": r"\b(grouping\s+sets|with\s+(cube|rollup))\b|\b(cube|rollup)\s*\(",
    "limit": r"\blimit\s+\d",
    "common table expression": r"\bwith\s+\w+\s+as\s*\(",
    "filter clause": r"\)\s*filter\s*\(\s*where\b",
    # Only a number or string with at most one unit is read; strings stand empty here.
    "interval": rf"\binterval\s*(\(|[-+])|\binterval\s+(\d+|'')\s*({_UNITS})\s*(to\b|\d|'')",
}
# Words of which a statement must hold one to fit the pattern: looking for a word is far cheaper than a search at every place.
REJECTED_WORDS = {
    "lateral view": ("lateral",),
    "set operation": ("intersect", "except", "minus"),
    "grouping sets": ("grouping", "cube", "rollup"),
    "limit": ("limit",),
    "common table expression": ("with",),
    "filter clause": ("filter",),
    "interval": ("interval",),
}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once per row however often it is used, in a filter too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without_strings(sql: Column) -> Column:
    return F.when(sql.contains("'") | sql.contains('"'), F.regexp_replace(sql, r"'[^']*'|\"[^\"]*\"", "''")).otherwise(sql)


def _on_bare(use: Callable[[Column], Column]) -> Column:
    """``use`` of the statement's text without its strings."""
    return _once(F.col("sql"), lambda sql: _once(_without_strings(sql), use))


def _fits(text: Column, *patterns: str) -> Column:
    return text.rlike("(?is)" + "|".join(f"(?:{p})" for p in patterns))


def _first_fit(text: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(_fits(text, p), F.lit(name)) for name, p in patterns.items()))


def _rejection(bare: Column) -> Column:
    """Name of the first construct without a rule, or null."""

    def named(low: Column) -> Column:
        holds = lambda name: reduce(or_, (low.contains(w) for w in REJECTED_WORDS[name]))
        return F.coalesce(*(F.when(holds(name) & _fits(bare, p), F.lit(name)) for name, p in REJECTED.items()))

    return _once(F.lower(bare), named)


def classify_statements(statements: DataFrame) -> DataFrame:
    """Add ``kind``; a kind outside the supported ones becomes ``unsupported``."""
    kind = F.coalesce(_on_bare(lambda bare: _first_fit(bare, KINDS)), F.lit("unsupported"))
    return statements.withColumn("kind", kind)


def reject_reasons(classified: DataFrame) -> DataFrame:
    """Add ``reject``: why a statement gives no lineage, or null."""
    reads = F.col("kind").isin(*READ_KINDS)
    reason = F.when(F.col("kind") == "unsupported", "statement").when(reads, _on_bare(_rejection))
    return classified.withColumn("reject", reason)


def reject_report(statements: DataFrame) -> DataFrame:
    """Number of statements per reason."""
    rejected = reject_reasons(classify_statements(statements)).where("reject is not null")
    return rejected.groupBy(F.col("reject").alias("reason")).agg(F.count("*").alias("n_statements"))


def _name_parts(name: Column, prefix: str = "") -> list[Column]:
    clean = F.lower(F.replace(name, F.lit("`"), F.lit("")))
    parts = F.split(clean, r"\.")
    db = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))
    return [db.alias(prefix + "db"), F.when(clean != "", F.element_at(parts, -1)).alias(prefix + "tbl")]


def _with_target(statements: DataFrame) -> DataFrame:
    """Add the created or filled table of each statement; null for one that has none."""
    extract = lambda p: F.nullif(F.regexp_extract("sql", "(?is)" + p, 1), F.lit(""))
    made = statements.withColumn("target_name", F.coalesce(extract(_INSERT), extract(_CREATE), F.lit("")))
    return made.select("*", *_name_parts(F.col("target_name"), "target_")).drop("target_name")


def readable(statements: DataFrame) -> DataFrame:
    """Statements that have a query to read, with their target."""
    reads = _on_bare(lambda bare: _fits(bare, *(KINDS[k] for k in READ_KINDS)) & _rejection(bare).isNull())
    return _with_target(statements.where(reads))


def schema_statements(statements: DataFrame) -> DataFrame:
    """CREATE TABLE statements that write their columns out, with their target."""
    return _with_target(statements.where(_on_bare(lambda bare: _fits(bare, _CREATE) & ~_fits(bare, r"\bselect\b", _LIKE))))


def like_statements(statements: DataFrame) -> DataFrame:
    """CREATE … LIKE statements, with target and source."""
    found = statements.where(_fits(F.col("sql"), _LIKE)).withColumn("source_name", F.regexp_extract("sql", "(?is)" + _LIKE, 2))
    return _with_target(found).select("*", *_name_parts(F.col("source_name"), "source_")).drop("source_name")


def statement_targets(statements: DataFrame) -> DataFrame:
    """``targets(stmt_id, kind, db, tbl, source_db, source_tbl)``."""
    source = F.regexp_extract("sql", "(?is)" + _LIKE, 2)
    found = _with_target(classify_statements(statements)).where("target_tbl is not null")
    named = found.select("stmt_id", "kind", F.col("target_db").alias("db"), F.col("target_tbl").alias("tbl"), source.alias("source"))
    return named.select("stmt_id", "kind", "db", "tbl", *_name_parts(F.col("source"), "source_"))


def readable_queries(statements: DataFrame, by_place: bool = False) -> DataFrame:
    """What is read of readable statements: key, order where there is one, target and text.

    ``by_place`` adds a column of that name: whether the statement fills a table.
    """
    order = ["seq"] if "seq" in statements.columns else []
    fills = [_fits(F.col("sql"), _INSERT).alias("by_place")] if by_place else []
    return readable(statements).select("stmt_id", *order, "target_db", "target_tbl", *fills, "sql")


def select_tokens(statements: DataFrame) -> DataFrame:
    """Tokens of readable statements with relations and select-list roles marked."""
    return with_roles(nest_blocks(readable_queries(statements)))


def source_relations(statements: DataFrame) -> DataFrame:
    """``relations(stmt_id, block_id, branch, ord, db, tbl, alias, group_alias, derived_block)``.

    ``group_alias`` is the name of the outermost named bracket around the relation; it is what the relation answers to.
    """
    return walk_relations(readable_queries(statements), ["stmt_id"])


def target_relations(statements: DataFrame) -> DataFrame:
    """The relations with the target of their statement, ``target_db`` and ``target_tbl``, instead of its key."""
    return walk_relations(readable_queries(statements), ["target_db", "target_tbl"])


def scope_names(statements: DataFrame) -> DataFrame:
    """The name each relation goes by in its scope, and what stands behind the name."""
    return source_relations(statements).selectExpr(
        "stmt_id",
        "block_id",
        "branch",
        "coalesce(group_alias, alias, tbl) AS scope_name",
        "CASE WHEN derived_block IS NOT NULL THEN 'derived' WHEN alias IS NOT NULL OR group_alias IS NOT NULL THEN 'alias' ELSE 'table' END AS scope_kind",
        "concat_ws('.', db, tbl) AS behind",
    )


def with_items(tokens: DataFrame) -> DataFrame:
    """Alias, output name and shape of the select item each listed token is part of."""
    item = "PARTITION BY stmt_id, block_id, item_no, branch"
    # Only names look relations up, so only they carry them through the sorts that follow.
    in_scope = "CASE WHEN role IN ('ref', 'star') THEN filter(block_relations, r -> r.branch = branch) END AS relations"
    return (
        tokens.where("role IS NOT NULL OR relation IS NOT NULL")
        .selectExpr(
            "*",
            f"collect_list(relation) OVER ({BY_BLOCK} {WHOLE}) AS block_relations",
            f"max(branch) OVER ({BY_BLOCK} {WHOLE}) + 1 AS n_branches",
            f"min(CASE WHEN role = 'star' THEN item_no END) OVER ({BY_BLOCK} {WHOLE}) AS first_star",
        )
        .selectExpr("* EXCEPT (block_relations)", in_scope)
        .selectExpr(
            "*",
            f"max(CASE WHEN role = 'alias' THEN lower({T.UNQUOTED_SQL}) END) OVER ({item}) AS alias",
            f"count_if(role <> 'bracket') OVER ({item}) AS n_content",
            f"max(CASE WHEN role IN ('ref', 'star') THEN {T.LAST_PART_SQL} END) OVER ({item}) AS only_name",
        )
        .selectExpr("*", "alias IS NULL AND n_content = 1 AND only_name IS NOT NULL AS is_plain")
        .selectExpr("*", f"coalesce(alias, CASE WHEN is_plain THEN only_name END, '{UNNAMED}') AS out_name")
        .selectExpr("*", "min_by(out_name, branch) OVER (PARTITION BY stmt_id, block_id, item_no) AS first_name")
        .drop("n_content", "only_name")
    )


def with_calls(items: DataFrame) -> DataFrame:
    """Name and place of the nearest function call around each token, or null."""
    opener = "CASE WHEN call_name IS NOT NULL THEN named_struct('pos', pos - 1, 'name', call_name) END"
    by_depth = f"PARTITION BY stmt_id, call_depth ORDER BY pos {SO_FAR}"
    return items.selectExpr("*", f"last({opener}, true) OVER ({by_depth}) AS call")


def item_tokens(statements: DataFrame) -> DataFrame:
    return with_calls(with_items(select_tokens(statements)))


def select_items(statements: DataFrame) -> DataFrame:
    """``items(stmt_id, block_id, branch, item_no, out_name, is_star, star_qualifier)``."""
    rows = with_items(select_tokens(statements)).where("role IS NOT NULL AND skip = 0")
    return rows.groupBy("stmt_id", "block_id", "branch", "item_no").agg(
        F.first("out_name").alias("out_name"),
        F.expr("bool_or(is_plain AND out_name = '*')").alias("is_star"),
        F.expr("max(CASE WHEN role = 'star' AND tok <> '*' THEN substring(tok, 1, length(tok) - 2) END)").alias("star_qualifier"),
    )


def item_references(statements: DataFrame, with_else: bool = False) -> DataFrame:
    """Every ref, star, call and literal whose value reaches a select item.

    ``case_part`` tells ELSE apart; it is left out unless asked for.
    """
    live = "skip = else_depth" if with_else else "skip = 0"
    rows = item_tokens(statements).where(f"role IN ('ref', 'star', 'call', 'literal') AND {live}")
    return rows.selectExpr(
        "stmt_id",
        "block_id",
        "branch",
        "item_no",
        "pos",
        "role",
        f"CASE WHEN role IN ('ref', 'star') THEN {T.QUALIFIER_SQL} END AS qualifier",
        f"""CASE role WHEN 'call' THEN concat(tok, '()') WHEN 'literal' THEN lower({T.UNQUOTED_SQL})
            ELSE {T.LAST_PART_SQL} END AS name""",
        "call.pos AS func_pos",
        "CASE WHEN else_depth > 0 THEN 'else' ELSE 'value' END AS case_part",
        "out_name",
    )
