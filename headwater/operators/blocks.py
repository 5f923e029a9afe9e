"""Tokens of every statement, and the select block, clause and item each one stands in.

A statement's text is shuffled once, by ``stmt_id``; everything after that is a window
inside one statement, so no token ever crosses the network and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from headwater.functions import tokens as T
from headwater.session import shuffle_width

BY_POS = "PARTITION BY stmt_id ORDER BY pos"
BY_LEVEL = "PARTITION BY stmt_id, level ORDER BY pos"
BY_SELECT_DEPTH = "PARTITION BY stmt_id, select_depth ORDER BY pos"
BY_BLOCK = "PARTITION BY stmt_id, block_id ORDER BY pos"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"

# Name given to the relation that ends at this token, or null.
ALIAS_AFTER = f"""
CASE WHEN next = 'as' THEN next2
     WHEN next_kind = 'word' AND next NOT IN {T.words(T.NOT_RELATION_ALIAS)} THEN next END"""


def _flag(cond: str) -> str:
    return f"coalesce(int({cond}), 0)"


def tokenize_statements(statements: DataFrame) -> DataFrame:
    """``tokens(stmt_id, pos, tok, kind)`` plus the columns the statements bring along."""
    carried = [c for c in statements.columns if c != "sql"]
    # Not ``posexplode``: a filter of empty lists comes with it, which cuts every text once more, in the few tasks that read the table.
    return (
        statements.selectExpr(*carried, f"posexplode_outer({T.TOKENS_SQL}) AS (pos, raw)")
        .where("pos IS NOT NULL")
        .selectExpr("*", f"{T.KIND_SQL} AS kind")
        .selectExpr(*carried, "pos", f"{T.TEXT_SQL} AS tok", "kind")
    )


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """Tokens with those around them, and how many brackets and CASEs are open."""
    return tokens.selectExpr("*", "CASE WHEN tok IN ('(', 'case') THEN 1 WHEN tok IN (')', 'end') THEN -1 ELSE 0 END AS step").selectExpr(
        "*",
        f"lag(tok, 1) OVER ({BY_POS}) AS prev",
        f"lag(tok, 2) OVER ({BY_POS}) AS prev2",
        f"lag(kind, 1) OVER ({BY_POS}) AS prev_kind",
        f"lead(tok, 1) OVER ({BY_POS}) AS next",
        f"lead(kind, 1) OVER ({BY_POS}) AS next_kind",
        f"lead(tok, 2) OVER ({BY_POS}) AS next2",
        f"CAST(sum(step) OVER ({BY_POS} {SO_FAR}) - least(step, 0) AS int) AS level",
        f"count_if(tok = 'select') OVER ({BY_POS} {SO_FAR}) AS selects_before",
        f"last(CASE WHEN kind = 'word' AND tok IN ('select', 'from', 'where', 'having', 'on', 'using', 'by') THEN tok END, true) OVER ({BY_POS} {SO_FAR}) AS near_clause",
    )


def with_openers(tokens: DataFrame) -> DataFrame:
    """What the innermost open bracket or CASE is, and the name behind its closing mark.

    The bracket around a whole query, or around one branch of a union, is no scope of its own. One
    around relations of a FROM clause is a group: its relations belong to the block it stands in. It
    opens where a relation can stand; after a comma, which may part select items as well, only if its first words
    read like a relation with an alias or a join.
    """
    around_query = "coalesce(selects_before = 0 OR prev = 'union' OR (prev = 'all' AND prev2 = 'union'), false)"
    is_block = f"coalesce(tok = '(' AND next = 'select' AND NOT {around_query}, false)"
    names_call = (
        f"prev_kind = 'word' AND (prev NOT IN {T.words(T.RESERVED)} OR prev IN {T.words(T.CALLABLE_RESERVED)})"
    )
    # Brackets that follow each other stand where the first of them does.
    head = f"CASE WHEN prev = '(' THEN last(CASE WHEN tok = '(' AND coalesce(prev <> '(', true) THEN coalesce(prev, '') END, true) OVER ({BY_POS} {SO_FAR}) ELSE prev END"
    joins = f"next2 IN {T.words(T.JOIN_WORDS, ('as',))} OR (next2 RLIKE '^[a-z_]' AND next2 NOT IN {T.words(T.RESERVED)})"
    after_comma = f"head = ',' AND near_clause <> 'select' AND (next = '(' OR (next_kind = 'word' AND next NOT IN {T.words(T.RESERVED)} AND ({joins})))"
    is_group = f"coalesce(tok = '(' AND NOT {is_block} AND selects_before > 0 AND near_clause <> 'select' AND next <> 'select' AND (head IN ('from', 'join') OR ({after_comma})), false)"
    kind = f"""
        CASE WHEN tok = 'case' THEN 'case'
             WHEN prev IN ('in', 'over', 'cast') THEN prev
             WHEN {is_block} THEN 'select'
             WHEN {names_call} THEN 'call'
             ELSE 'group' END"""
    opener = f"""
        CASE WHEN step = 1 THEN named_struct(
            'pos', pos, 'kind', {kind}, 'is_block', {is_block}, 'is_group', {is_group},
            'is_relation', coalesce(head IN ('from', 'join', ','), false), 'prev', prev, 'prev2', prev2) END"""
    return (
        tokens.selectExpr("*", f"{head} AS head")
        .selectExpr("* EXCEPT (head)", f"{opener} AS opener", f"{ALIAS_AFTER} AS alias_after")
        .selectExpr(
            "*",
            f"last(opener, true) OVER ({BY_LEVEL} {SO_FAR}) AS open",
            f"last(CASE WHEN step = 1 OR tok IN ('else', 'as') THEN tok END, true) OVER ({BY_LEVEL} {SO_FAR}) AS mark",
            f"(lead(CASE WHEN step = -1 THEN named_struct('name', alias_after) END, 1) IGNORE NULLS OVER ({BY_LEVEL})).name AS close_alias",
        )
    )


def _without_neighbours(tokens: DataFrame, carried: list[str]) -> DataFrame:
    """Turn all that depends on words and neighbours into a few small columns.

    The sorts that follow then move only those, and no word list is looked at again.
    Value-less surroundings are: ELSE parts, type names of casts, IN lists, OVER clauses
    and sub-selects that are no relation of a FROM clause.
    """
    dead = "(open.kind IN ('in', 'over') OR (open.is_block AND NOT open.is_relation))"
    in_else, ends_else = "(tok = 'else' AND open.kind = 'case')", "(tok = 'end' AND open.kind = 'case' AND mark = 'else')"
    in_type, ends_type = "(tok = 'as' AND open.kind = 'cast')", "(tok = ')' AND open.kind = 'cast' AND mark = 'as')"
    clause_word = f"""
        CASE WHEN kind = 'word' AND tok IN {T.words(T.CLAUSE_WORDS)} THEN tok
             WHEN next = 'by' AND tok IN {T.words(T.CLAUSE_WORDS_BY)} THEN tok END"""
    ends = f"""
        CASE WHEN next IS NULL OR next = ';' THEN 'always'
             WHEN next IN (',', ')') THEN 'same level'
             WHEN next_kind = 'word' AND next IN {T.words(T.CLAUSE_WORDS)} THEN 'clause' END"""
    free_word = f"(kind = 'word' AND tok NOT IN {T.words(T.RESERVED)})"
    after_operand = f"""(prev_kind IN ('number', 'string') OR prev IN (')', 'end', 'null', 'true', 'false')
        OR (prev_kind = 'word' AND prev NOT IN {T.words(T.RESERVED)}))"""
    # The parts of an interval literal, which is one literal under the name of the whole.
    units = T.words(T.INTERVAL_UNITS)
    part = f"""(kind IN ('number', 'string') AND prev = 'interval') OR (tok IN {units} AND prev_kind IN ('number', 'string') AND prev2 = 'interval')"""
    interval = "tok = 'interval' AND next_kind IN ('number', 'string')"
    role = f"""
        CASE WHEN {interval} THEN 'literal'
             WHEN {part} THEN 'other'
             WHEN tok IN ('(', ')') OR (tok IN ('distinct', 'all') AND prev = 'select') THEN 'bracket'
             WHEN tok = '*' AND prev = '(' AND open.kind = 'call' THEN 'literal'
             WHEN tok = '*' AND prev IN ('select', 'distinct', 'all', ',', '(') THEN 'star'
             WHEN kind = 'word' AND endswith(tok, '.*') THEN 'star'
             WHEN kind = 'word' AND next = '(' AND ({free_word} OR tok IN {T.words(T.CALLABLE_RESERVED)}) THEN 'call'
             WHEN kind IN ('number', 'string') THEN 'literal'
             WHEN tok = 'null' AND (prev = 'is' OR (prev = 'not' AND prev2 = 'is')) THEN 'other'
             WHEN tok IN {T.words(T.CONSTANT_WORDS)} THEN 'literal'
             WHEN tok IN {T.words(T.TYPED_LITERAL_WORDS)} AND next_kind = 'string' THEN 'other'
             WHEN {free_word} THEN 'ref'
             ELSE 'other' END"""
    return tokens.selectExpr(
        *carried,
        "pos",
        f"CASE WHEN {interval} THEN concat_ws(' ', tok, btrim(next, '\\'\"'), CASE WHEN next2 IN {units} THEN next2 END) ELSE tok END AS tok",
        "level",
        "step",
        f"{_flag('open.is_block')} * step AS block_step",
        f"{_flag('open.is_group')} * step AS group_step",
        f"{_flag('open.is_group')} * {_flag('CASE step WHEN 1 THEN close_alias WHEN -1 THEN alias_after END IS NOT NULL')} * step AS named_step",
        f"{_flag('open.kind = ' + repr('call'))} * step AS call_step",
        f"{_flag(dead)} * step + {_flag(in_else)} + {_flag(in_type)} - {_flag(ends_else)} - {_flag(ends_type)} AS skip_step",
        f"{_flag(in_else)} - {_flag(ends_else)} AS else_step",
        "CASE WHEN step = 1 AND open.kind = 'call' THEN prev END AS call_name",
        "CASE WHEN step = -1 AND open.is_block AND open.is_relation THEN open.pos END AS derived_block",
        f"{free_word} AND coalesce((prev IN ('from', 'join', ',') OR (prev = '(' AND open.is_group)) AND coalesce(next <> '(', true), false) AS may_be_table",
        f"coalesce((kind IN ('word', 'string') AND prev = 'as') OR ({free_word} AND {after_operand}), false) AS may_be_alias",
        "alias_after",
        "close_alias",
        f"{clause_word} AS clause_word",
        f"{ends} AS ends",
        f"{role} AS role",
    )


def _with_depths(tokens: DataFrame) -> DataFrame:
    """Depth in selects and calls, and how many value-less surroundings a token stands in."""
    depth = lambda step: f"CAST(sum({step}) OVER ({BY_POS} {SO_FAR}) AS int)"
    return tokens.selectExpr(
        "*",
        f"{depth('block_step')} AS select_depth",
        f"{depth('call_step')} AS call_depth",
        f"{depth('group_step')} AS group_depth",
        f"{depth('named_step')} AS named_depth",
        f"{depth('skip_step')} AS skip",
        f"{depth('else_step')} AS else_depth",
        f"lead(level) OVER ({BY_POS}) AS next_level",
        f"first(CASE WHEN tok = 'select' THEN level END, true) OVER ({BY_POS} {WHOLE}) AS root_level",
    ).drop("call_step", "skip_step", "else_step", "group_step")


def _with_blocks(tokens: DataFrame) -> DataFrame:
    opener = """CASE WHEN block_step = 1 THEN named_struct(
        'pos', pos, 'level', level, 'alias', close_alias, 'groups', group_depth, 'named', named_depth) END"""
    # Brackets around relations do not count: what stands in them stands in the block.
    own_level = "level - group_depth + coalesce(block.groups, 0)"
    return (
        tokens.selectExpr("*", f"last({opener}, true) OVER ({BY_SELECT_DEPTH} {SO_FAR}) AS block")
        .selectExpr(
            "*",
            "coalesce(block.pos, -1) AS block_id",
            "coalesce(block.level, root_level, 0) AS block_level",
            "block.alias AS block_alias",
            f"{own_level} AS own_level",
            "named_depth - coalesce(block.named, 0) AS in_named",
        )
        .selectExpr(
            "*",
            "own_level = block_level AND step = 0 AS at_level",
            "own_level <= block_level AS at_most_level",
            """coalesce(ends = 'always' OR (ends = 'same level' AND next_level = block_level)
               OR (ends = 'clause' AND next_level <= block_level), false) AS ends_item""",
        )
        .selectExpr("*", "CASE WHEN named_step = 1 AND in_named = 1 THEN close_alias END AS opens_named")
        .drop("block", "root_level", "select_depth", "block_step", "block_level", "next_level", "ends", "close_alias", "step", "own_level", "group_depth", "named_depth", "named_step")
    )


def _with_clauses(tokens: DataFrame) -> DataFrame:
    """Clause, union branch and select item of every token, inside its own block."""
    clause_word = "CASE WHEN at_level OR (tok = 'union' AND at_most_level) THEN clause_word END"
    from_word = "CASE WHEN at_level AND tok IN ('from', 'join', ',', 'on', 'using') THEN tok END"
    return (
        tokens.selectExpr(
            "*",
            f"last({clause_word}, true) OVER ({BY_BLOCK} {SO_FAR}) AS clause",
            f"last({from_word}, true) OVER ({BY_BLOCK} {SO_FAR}) AS from_part",
            f"CAST(count_if(tok = 'union' AND at_most_level) OVER ({BY_BLOCK} {SO_FAR}) AS int) AS branch",
            # The outermost group with a name hides the names of the relations in it.
            f"CASE WHEN in_named > 0 THEN last(opens_named, true) OVER ({BY_BLOCK} {SO_FAR}) END AS group_alias",
        )
        .selectExpr("*", f"count_if(at_level AND tok = ',' AND clause = 'select') OVER ({BY_BLOCK} {SO_FAR}) AS commas")
        .selectExpr(
            "*",
            f"CAST(commas - last(CASE WHEN at_level AND tok = 'select' THEN commas END, true) OVER ({BY_BLOCK} {SO_FAR}) AS int) AS item_no",
        )
        .drop("commas", "clause_word", "at_most_level", "in_named", "opens_named")
    )


def nest_blocks(statements: DataFrame) -> DataFrame:
    """Every token with its nesting, block, clause and item.

    The number of tasks is set, not left to the planner: tokens take many times the room of
    the text they come from, so tasks sized by the text would be far too few.
    """
    spread = statements.repartition(shuffle_width(statements.sparkSession), "stmt_id")
    carried = [c for c in statements.columns if c != "sql"]
    opened = with_openers(with_neighbours(tokenize_statements(spread)))
    return _with_clauses(_with_blocks(_with_depths(_without_neighbours(opened, carried))))


def with_roles(nested: DataFrame) -> DataFrame:
    """Mark relations of FROM clauses and the part each token of a select list plays.

    ``relation`` sits on the name of a table or on the closing bracket of a derived table.
    ``role`` is ref, star, call, literal, alias, bracket or other inside a select list, and
    null elsewhere.
    """
    in_from = "clause = 'from' AND from_part NOT IN ('on', 'using') AND skip = 0"
    in_list = "coalesce(clause = 'select' AND NOT (at_level AND tok IN ('select', ',')), false)"
    none = "CAST(NULL AS string)"
    return nested.withColumnsRenamed({"role": "own_role", "ends_item": "may_end"}).selectExpr(
        "* EXCEPT (own_role, may_end, may_be_table, may_be_alias, alias_after, derived_block, from_part, group_alias)",
        f"""
        CASE WHEN {in_from} AND at_level AND may_be_table THEN named_struct(
                 'branch', branch, 'ord', pos, 'db', {T.QUALIFIER_SQL}, 'tbl', {T.LAST_PART_SQL},
                 'alias', alias_after, 'group_alias', group_alias, 'derived_block', CAST(NULL AS int))
             WHEN {in_from} AND derived_block IS NOT NULL THEN named_struct(
                 'branch', branch, 'ord', pos, 'db', {none}, 'tbl', {none},
                 'alias', alias_after, 'group_alias', group_alias, 'derived_block', derived_block) END AS relation""",
        f"CASE WHEN NOT {in_list} THEN NULL WHEN at_level AND may_end AND may_be_alias THEN 'alias' ELSE own_role END AS role",
        f"{in_list} AND may_end AS ends_item",
    )
