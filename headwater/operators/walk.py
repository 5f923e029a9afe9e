"""Relations and column links of statements, worked out on the flat tokens of many statements at once.

This says the same as the windows of ``blocks``, ``facts.with_roles``, ``facts.with_items`` and ``facts.with_calls`` do, for what
is asked of whole corpora: a window over a statement is a running sum or a carried position of a numpy array here, so no token is
sorted by Spark or becomes a row. Texts are shuffled once, by ``stmt_id``; rows that share one are read as one statement, as by a window.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from headwater.functions import tokens as T
from headwater.session import ship_package, shuffle_width

# Tokens worked on at a time; a longer statement is worked on alone.
TOKENS_AT_ONCE = 100_000

MARK = "\u0001"
# Between the marks stands the number of the item that fills a column, behind them the name it has.
PLACE = "\u0002"
UNNAMED_DERIVED = "__subquery"
# Fixed value: output name of an expression that has no alias.
UNNAMED = "unresolvedalias"

_NUMBER = re.compile(T.NUMBER_PATTERN.removeprefix("^").removesuffix("$"))
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz_")
WORD, NUMBER, STRING, SYMBOL = 1, 2, 3, 4
REF, STAR, CALL, LITERAL, ALIAS, BRACKET, OTHER = 1, 2, 3, 4, 5, 6, 7

# Texts that a rule names have fixed codes; 0 is no token.
_FIXED = {
    word: code
    for code, word in enumerate(
        dict.fromkeys(
            (*T.RESERVED, *T.CONSTANT_WORDS, *T.TYPED_LITERAL_WORDS, *T.INTERVAL_UNITS, *T.CALLABLE_RESERVED, *T.NOT_RELATION_ALIAS, "(", ")", "*", ",", ";", "partitioned")
        ),
        start=1,
    )
}
_REST = len(_FIXED) + 1


def _in(*groups: tuple[str, ...]) -> np.ndarray:
    """Which codes stand for one of these texts."""
    flags = np.zeros(_REST + 1, bool)
    flags[[_FIXED[word] for group in groups for word in group]] = True
    return flags


_OPENS, _CLOSES = _in(("(", "case")), _in((")", "end"))
_CLAUSE_MARKS = _in(("select", "from", "where", "having", "on", "using", "by"))
_RESERVED, _CALLABLE, _JOINS = _in(T.RESERVED), _in(T.CALLABLE_RESERVED), _in(T.JOIN_WORDS, ("as",))
_NO_ALIAS, _CLAUSES, _CLAUSES_BY = _in(T.NOT_RELATION_ALIAS), _in(T.CLAUSE_WORDS), _in(T.CLAUSE_WORDS_BY)
_UNITS, _CONSTANTS, _TYPED = _in(T.INTERVAL_UNITS), _in(T.CONSTANT_WORDS), _in(T.TYPED_LITERAL_WORDS)
_FROM_JOIN, _FROM_JOIN_COMMA = _in(("from", "join")), _in(("from", "join", ","))
_FROM_PARTS, _ON_USING = _in(("from", "join", ",", "on", "using")), _in(("on", "using"))
_VALUE_ENDS, _ITEM_ENDS = _in((")", "end", "null", "true", "false")), _in((",", ")"))
_BEFORE_STAR, _BRACKETS, _DISTINCT = _in(("select", "distinct", "all", ",", "(")), _in(("(", ")")), _in(("distinct", "all"))
_VALUELESS = _in(("in", "over"))
_LIST_MARKS, _ELSE_AS = _in(("select", ",")), _in(("else", "as"))
_CALL_KIND, _CASE_KIND, _CAST_KIND = 1, 2, 3
_LIST_KIND, _SELECT_KIND, _GROUP_KIND = 4, 5, 6


def _kind(raw: str) -> int:
    first = raw[0]
    if first in "'\"":
        return STRING if len(raw) > 1 else SYMBOL
    if (first == "." or "0" <= first <= "9") and _NUMBER.fullmatch(raw):
        return NUMBER
    if first in "_$`" or (first.isalnum() if first.isascii() else unicodedata.category(first)[0] in "LN"):
        return WORD
    return SYMBOL


def _unquoted(text: str) -> str:
    if text == "*":
        return "1"
    return text[1:-1] if text[:1] in ("'", '"') else text


class _Lines:
    """Rows in the order of a window: those of one partition together, by place inside it."""

    def __init__(self, key: np.ndarray, order: np.ndarray | None = None):
        self.order = np.argsort(key, kind="stable") if order is None else order
        ordered = key[self.order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        self.starts = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        self.first = self.starts[number]
        self.part = np.empty(len(key), np.int64)
        self.part[self.order] = number

    def last(self, marked: np.ndarray) -> np.ndarray:
        """Row of the last marked one up to each row, or -1."""
        at = np.where(marked[self.order], np.arange(len(marked)), -1)
        np.maximum.accumulate(at, out=at)
        found = np.empty(len(marked), np.int64)
        found[self.order] = np.where(at >= self.first, self.order[at], -1)
        return found

    def next(self, marked: np.ndarray) -> np.ndarray:
        """Row of the first marked one behind each row, or -1."""
        size = len(marked)
        at = np.full(size + 1, size)
        at[:-1] = np.where(marked[self.order], np.arange(size), size)
        at = np.minimum.accumulate(at[::-1])[::-1][1:]
        ends = np.append(self.starts[1:], size)[self.part[self.order]]
        found = np.empty(size, np.int64)
        found[self.order] = np.where(at < ends, self.order[np.minimum(at, size - 1)], -1)
        return found

    def count(self, marked: np.ndarray) -> np.ndarray:
        """Marked rows up to each row."""
        there = marked[self.order].astype(np.int64)
        total = np.cumsum(there)
        found = np.empty(len(marked), np.int64)
        found[self.order] = total - (total - there)[self.first]
        return found


def _at(values: np.ndarray, rows: np.ndarray, absent):
    """Values at rows, ``absent`` where there is no row."""
    return np.where(rows >= 0, values[rows], absent)


def _joined(group: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One key for two columns of numbers."""
    low = int(other.min())
    return group.astype(np.int64) * (int(other.max()) - low + 1) + (other - low)


class _Statements:
    """Where the tokens of each statement lie, one statement behind the other."""

    def __init__(self, number: np.ndarray):
        size = len(number)
        self.rows = np.arange(size)
        fresh = np.ones(size, bool)
        fresh[1:] = number[1:] != number[:-1]
        self.starts = np.flatnonzero(fresh)
        inside = np.cumsum(fresh) - 1
        self.start = self.starts[inside]
        self.end = np.append(self.starts[1:], size)[inside]

    def moved(self, values: np.ndarray, by: int) -> np.ndarray:
        """The value so many places before (behind, if negative) in the statement, or 0."""
        found = np.zeros_like(values)
        if by > 0:
            found[by:] = values[:-by]
            found[self.rows - by < self.start] = 0
        else:
            found[:by] = values[-by:]
            found[self.rows - by >= self.end] = 0
        return found

    def depth(self, steps: np.ndarray) -> np.ndarray:
        """Sum of the steps up to each token."""
        total = np.cumsum(steps)
        return total - (total - steps)[self.start]

    def last(self, marked: np.ndarray) -> np.ndarray:
        """Row of the last marked token up to each token, or -1."""
        at = np.where(marked, self.rows, -1)
        np.maximum.accumulate(at, out=at)
        return np.where(at >= self.start, at, -1)


def _is(column: np.ndarray, text: str) -> np.ndarray:
    return column == _FIXED[text]


def _reordered(tokens: SimpleNamespace, by: np.ndarray) -> None:
    """Tokens at the same place of rows that share a statement, in the order of ``by``: that of the sort before, as stable sorts leave it."""
    order = np.lexsort((np.arange(len(by)), by, tokens.pos, tokens.number))
    for name, values in vars(tokens).items():
        setattr(tokens, name, values[order])


def _surroundings(code: np.ndarray, kind: np.ndarray, pos: np.ndarray, number: np.ndarray, row: np.ndarray, texts: list[str], codes: dict[str, int]) -> SimpleNamespace:
    """All that depends on words and neighbours, as numbers and flags; see ``blocks.with_neighbours``, ``with_openers``, ``_without_neighbours``."""
    lie = _Statements(number)
    tok = np.minimum(code, _REST)
    prev, prev2, nxt, next2 = (lie.moved(tok, by) for by in (1, 2, -1, -2))
    prev_kind, next_kind = lie.moved(kind, 1), lie.moved(kind, -1)
    next_code, next2_code = lie.moved(code, -1), lie.moved(code, -2)
    step = _OPENS[tok].astype(np.int64) - _CLOSES[tok]
    level = lie.depth(step) - np.minimum(step, 0)
    is_word, opens, closes = kind == WORD, step == 1, step == -1
    selects_before = lie.depth(_is(tok, "select").astype(np.int64))
    near_clause = _at(tok, lie.last(is_word & _CLAUSE_MARKS[tok]), 0)

    around_query = (selects_before == 0) | _is(prev, "union") | (_is(prev, "all") & _is(prev2, "union"))
    bracket, after_bracket = _is(tok, "("), _is(prev, "(")
    is_block = bracket & _is(nxt, "select") & ~around_query
    names_call = (prev_kind == WORD) & (~_RESERVED[prev] | _CALLABLE[prev])
    # Brackets that follow each other stand where the first of them does.
    head = np.where(after_bracket, _at(prev, lie.last(bracket & ~after_bracket), 0), prev)
    letters = np.fromiter((text[:1] in _LETTERS for text in texts), bool, len(texts))
    joins = _JOINS[next2] | (letters[next2_code] & ~_RESERVED[next2])
    beyond_list = (near_clause > 0) & ~_is(near_clause, "select")
    after_comma = _is(head, ",") & beyond_list & (_is(nxt, "(") | ((next_kind == WORD) & ~_RESERVED[nxt] & joins))
    is_group = bracket & ~is_block & (selects_before > 0) & beyond_list & (nxt > 0) & ~_is(nxt, "select") & (_FROM_JOIN[head] | after_comma)
    opener_kind = np.select(
        [_is(tok, "case"), _is(prev, "cast"), _VALUELESS[prev], is_block, names_call], [_CASE_KIND, _CAST_KIND, _LIST_KIND, _SELECT_KIND, _CALL_KIND], _GROUP_KIND
    )
    alias_after = np.where(_is(nxt, "as"), next2_code, np.where((next_kind == WORD) & ~_NO_ALIAS[nxt], next_code, 0))

    by_level = _Lines(_joined(number, level))
    opened = by_level.last(opens)
    mark = _at(tok, by_level.last(opens | _ELSE_AS[tok]), 0)
    close_alias = _at(alias_after, by_level.next(closes), 0)
    open_kind = _at(opener_kind, opened, 0)
    open_block, open_group, open_relation = _at(is_block, opened, False), _at(is_group, opened, False), _at(_FROM_JOIN_COMMA[head], opened, False)

    dead = (open_kind == _LIST_KIND) | (open_block & ~open_relation)
    in_case, in_cast, in_call = open_kind == _CASE_KIND, open_kind == _CAST_KIND, open_kind == _CALL_KIND
    in_else, ends_else = _is(tok, "else") & in_case, _is(tok, "end") & in_case & _is(mark, "else")
    in_type, ends_type = _is(tok, "as") & in_cast, _is(tok, ")") & in_cast & _is(mark, "as")
    else_step = in_else.astype(np.int64) - ends_else
    free_word = is_word & ~_RESERVED[tok]
    value, value_before, value_next = ((k == NUMBER) | (k == STRING) for k in (kind, prev_kind, next_kind))
    after_operand = value_before | _VALUE_ENDS[prev] | ((prev_kind == WORD) & ~_RESERVED[prev])
    interval = _is(tok, "interval") & value_next
    part = (value & _is(prev, "interval")) | (_UNITS[tok] & value_before & _is(prev2, "interval"))
    star_name = np.fromiter((text.endswith(".*") for text in texts), bool, len(texts))[code]
    role = np.select(
        [
            interval,
            part,
            _BRACKETS[tok] | (_DISTINCT[tok] & _is(prev, "select")),
            _is(tok, "*") & after_bracket & in_call,
            _is(tok, "*") & _BEFORE_STAR[prev],
            is_word & star_name,
            is_word & _is(nxt, "(") & (free_word | _CALLABLE[tok]),
            value,
            _is(tok, "null") & (_is(prev, "is") | (_is(prev, "not") & _is(prev2, "is"))),
            _CONSTANTS[tok],
            _TYPED[tok] & (next_kind == STRING),
            free_word,
        ],
        [LITERAL, OTHER, BRACKET, LITERAL, STAR, STAR, CALL, LITERAL, OTHER, LITERAL, OTHER, REF],
        OTHER,
    )
    # The parts of an interval literal are one literal under the name of the whole.
    named_code = code.copy()
    for i in np.flatnonzero(interval).tolist():
        whole = " ".join([texts[code[i]], texts[next_code[i]].strip("'\""), *([texts[next2_code[i]]] if _UNITS[next2[i]] else [])])
        named_code[i] = codes.setdefault(whole, len(texts))
        if named_code[i] == len(texts):
            texts.append(whole)
    named = open_group & np.where(opens, close_alias > 0, closes & (alias_after > 0))
    return SimpleNamespace(
        code=named_code, pos=pos, number=number, row=row, step=step, level=level, next=nxt, next_kind=next_kind, role=role,
        clause_word=(is_word & _CLAUSES[tok]) | (_is(nxt, "by") & _CLAUSES_BY[tok]),
        block_step=open_block * step, group_step=open_group * step, named_step=named * step, call_step=in_call * step,
        skip_step=dead * step + else_step + in_type - ends_type, else_step=else_step,
        call_name=np.where(opens & in_call, lie.moved(code, 1), 0), call_opens=opens & in_call & (lie.moved(code, 1) > 0),
        closes_derived=closes & open_block & open_relation, derived_block=_at(pos, opened, -1),
        may_be_table=free_word & (_FROM_JOIN_COMMA[prev] | (after_bracket & open_group)) & ~_is(nxt, "("),
        may_be_alias=((is_word | (kind == STRING)) & _is(prev, "as")) | (free_word & after_operand),
        alias_after=alias_after, close_alias=close_alias,
    )


def _nest(t: SimpleNamespace, tied: bool) -> SimpleNamespace:
    """Blocks, clauses, items, relations and roles; see ``blocks._with_depths``, ``_with_blocks``, ``_with_clauses`` and ``with_roles``."""
    if tied:
        _reordered(t, t.level)
    lie = _Statements(t.number)
    tok = np.minimum(t.code, _REST)
    t.skip, t.else_depth, t.call_depth = lie.depth(t.skip_step), lie.depth(t.else_step), lie.depth(t.call_step)
    t.select_depth, group_depth, named_depth = lie.depth(t.block_step), lie.depth(t.group_step), lie.depth(t.named_step)
    # Higher than any where nothing follows.
    next_level = np.where(lie.rows + 1 < lie.end, lie.moved(t.level, -1), len(tok) + 1)
    # The level of the first SELECT of the statement.
    selects = np.flatnonzero(_is(tok, "select"))[::-1]
    root = np.zeros(len(tok), np.int64)
    root[lie.start[selects]] = t.level[selects]

    block = _Lines(_joined(t.number, t.select_depth)).last(t.block_step == 1)
    t.block_id = _at(t.pos, block, -1)
    t.block_alias = _at(t.close_alias, block, 0)
    block_level = np.where(block >= 0, t.level[block], root[lie.start])
    # Brackets around relations do not count: what stands in them stands in the block.
    own_level = t.level - group_depth + _at(group_depth, block, 0)
    t.in_named = named_depth - _at(named_depth, block, 0)
    t.at_level, t.at_most_level = (own_level == block_level) & (t.step == 0), own_level <= block_level
    always = (t.next == 0) | _is(t.next, ";")
    in_level = ~always & _ITEM_ENDS[t.next] & (next_level == block_level)
    before_clause = ~always & ~_ITEM_ENDS[t.next] & (t.next_kind == WORD) & _CLAUSES[t.next] & (next_level <= block_level)
    t.may_end = always | in_level | before_clause
    if tied:
        _reordered(t, t.select_depth)
        tok = np.minimum(t.code, _REST)

    in_block = _Lines(_joined(t.number, t.block_id))
    parts_branch = _is(tok, "union") & t.at_most_level
    clause = _at(tok, in_block.last(t.clause_word & (t.at_level | parts_branch)), 0)
    from_part = _at(tok, in_block.last(t.at_level & _FROM_PARTS[tok]), 0)
    t.block_part, t.branch = in_block.part, in_block.count(parts_branch)
    # The outermost group with a name hides the names of the relations in it.
    group_name = np.where((t.named_step == 1) & (t.in_named == 1), t.close_alias, 0)
    t.group_alias = np.where(t.in_named > 0, _at(group_name, in_block.last(group_name > 0), 0), 0)
    commas = in_block.count(t.at_level & _is(tok, ",") & _is(clause, "select"))
    list_start = in_block.last(t.at_level & _is(tok, "select"))
    # -1 before the first list.
    t.item_no = np.where(list_start >= 0, commas - commas[list_start], -1)

    in_from = _is(clause, "from") & (from_part > 0) & ~_ON_USING[from_part] & (t.skip == 0)
    is_table = in_from & t.at_level & t.may_be_table
    t.is_relation = is_table | (in_from & t.closes_derived)
    t.is_derived = t.is_relation & ~is_table
    in_list = _is(clause, "select") & ~(t.at_level & _LIST_MARKS[tok])
    t.role = np.where(in_list, np.where(t.at_level & t.may_end & t.may_be_alias, ALIAS, t.role), 0)
    t.ends_item = in_list & t.may_end
    return t


def _split_name(name: str) -> tuple[str | None, str]:
    owner, dot, own = name.rpartition(".")
    return (owner if dot else None), own


def _relation_at(found: SimpleNamespace, i: int) -> dict:
    """A relation as a struct."""
    text = lambda code: found.texts[code] if code else None
    derived = bool(found.is_derived[i])
    db, tbl = (None, None) if derived else _split_name(found.texts[found.code[i]])
    return {
        "branch": int(found.branch[i]), "ord": int(found.pos[i]), "db": db, "tbl": tbl, "alias": text(found.alias_after[i]),
        "group_alias": text(found.group_alias[i]), "derived_block": int(found.derived_block[i]) if derived else None,
    }


RELATION = "branch int, ord int, db string, tbl string, alias string, group_alias string, derived_block int"
_RELATION_TYPES = {"branch": pa.int32(), "ord": pa.int32(), "db": pa.string(), "tbl": pa.string(), "alias": pa.string(), "group_alias": pa.string(), "derived_block": pa.int32()}
_CANDIDATES = pa.list_(pa.struct([(part, pa.string()) for part in ("scope", "db", "tbl")]))


def _relations(found: SimpleNamespace, batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
    at = np.flatnonzero(found.is_relation)
    each = [_relation_at(found, i) for i in at.tolist()]
    columns = {name: pa.array([r[name] for r in each], kind) for name, kind in _RELATION_TYPES.items()}
    return found.row[at], {"block_id": pa.array(found.block_id[at], pa.int32()), **columns}


def _items(found: SimpleNamespace, rows: np.ndarray) -> tuple[list, list, list, np.ndarray]:
    """Output name, plainness and name in the first branch of every item, and the item of each row."""
    part, role = found.block_part[rows], found.role[rows]
    place = _joined(part, found.item_no[rows])
    keys, first, item = np.unique(_joined(place, found.branch[rows]), return_index=True, return_inverse=True)
    content = np.bincount(item[(role > 0) & (role != BRACKET)], minlength=len(keys))
    alias: list[str | None] = [None] * len(keys)
    for i, code in zip(item[role == ALIAS].tolist(), found.code[rows[role == ALIAS]].tolist()):
        name = _unquoted(found.texts[code]).lower()
        if alias[i] is None or name > alias[i]:
            alias[i] = name
    # The one token of an item without an alias, if it is a name.
    only = np.zeros(len(keys), np.int64)
    names = (role == REF) | (role == STAR)
    only[item[names]] = found.code[rows[names]]
    only[content != 1] = 0
    out, plain = [], []
    for name, code in zip(alias, only.tolist()):
        plain.append(name is None and code > 0)
        out.append(name if name is not None else _split_name(found.texts[code])[1] if code else UNNAMED)
    # Items are in order of block, number and branch.
    places = place[first]
    leads = np.ones(len(keys), bool)
    leads[1:] = places[1:] != places[:-1]
    lead = np.flatnonzero(leads)[np.cumsum(leads) - 1]
    return out, plain, [out[i] for i in lead.tolist()], item


def _owner_rows(name: str, is_star: bool, scope: list[tuple]) -> tuple[str, list[tuple | None], list[tuple] | None]:
    """The column a name stands for, the relations that own it (one row each) and those that could.

    A relation of the scope is ``(scope, db, tbl, alias, name, full)``. The parts of a dotted name name its relation and its column.
    What names no relation is the field of a struct: of a column of the relation that a shorter start names, else of the column that
    the first part names.
    """
    of, col = _split_name(name)
    if of is not None and not is_star and not any(of == r[4] or of == r[5] for r in scope):
        parts = name.split(".")
        if len(parts) > 2 and any(r[5] == f"{parts[0]}.{parts[1]}" for r in scope):
            of, col = f"{parts[0]}.{parts[1]}", parts[2]
        elif len(parts) > 2 and any(r[4] == parts[0] for r in scope):
            of, col = parts[0], parts[1]
        else:
            of, col = None, parts[0]
    owners = scope if of is None else [r for r in scope if of == r[4] or of == r[5]]
    if is_star or len(owners) == 1:
        return col, owners or [None], None
    if of is not None:
        return col, owners[:1] or [None], None
    return col, [None], owners if len(owners) > 1 else None


def packed(scope: str, db: str | None, tbl: str | None, col: str | None) -> str:
    """A vertex as one string; absent parts are empty."""
    return f"{scope}{MARK}{db or ''}{MARK}{tbl or ''}{MARK}{col or ''}"


def _links(found: SimpleNamespace, batch: pa.RecordBatch, with_else: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """``rule, src, dst, candidates`` of every link, with packed ends; see ``lineage.token_links``."""
    of_row, rules, sources, targets, options = [], [], [], [], []

    def add(at: int, rule: str, src: str, dst: str | None, candidates: list | None = None) -> None:
        of_row.append(at)
        rules.append(rule)
        sources.append(src)
        targets.append(dst)
        options.append(candidates)

    texts, row = found.texts, found.row
    rows = np.flatnonzero((found.role > 0) | found.is_relation)
    if not len(rows):
        return rows, {}
    out_names, plains, first_names, item = _items(found, rows)
    part, role = found.block_part[rows], found.role[rows]
    n_branches = np.zeros(int(found.block_part.max()) + 1, np.int64)
    np.maximum.at(n_branches, part, found.branch[rows] + 1)
    first_star = np.full(len(n_branches), np.iinfo(np.int64).max)
    np.minimum.at(first_star, part[role == STAR], found.item_no[rows[role == STAR]])
    # The nearest function call: the last one opened at the same depth.
    number, depth = found.number[rows], found.call_depth[rows]
    order = np.lexsort((found.branch[rows], found.item_no[rows], found.block_id[rows], found.pos[rows], depth, number)) if found.tied else None
    call = _Lines(_joined(number, depth), order).last(found.call_opens[rows])
    call_pos = np.where(call >= 0, found.pos[rows[call]] - 1, 0)
    call_name = np.where(call >= 0, found.call_name[rows[call]], 0)

    # What lives in a statement without a key has no scope.
    keys = [None if key is None else f"#{key}" for key in batch.column("stmt_key").to_pylist()]
    target_db, target_tbl = batch.column("target_db").to_pylist(), batch.column("target_tbl").to_pylist()
    by_place = batch.column("by_place").to_pylist() if "by_place" in batch.schema.names else None

    # Relations by block and branch, in their order: where the columns live and what the relation answers to.
    relations = {i: _relation_at(found, i) for i in np.flatnonzero(found.is_relation).tolist()}
    scopes: dict[tuple[int, int], list[tuple]] = {}
    for i, r in relations.items():
        key, db, tbl, alias, derived = keys[row[i]], r["db"], r["tbl"], r["alias"], r["derived_block"]
        home = None
        if key is not None and derived is not None:
            home = f"{key}/d{derived}"
        elif key is not None and db is None:
            home = f"{key}/{found.block_id[i]}/{r['branch']}"
        shown = alias if r["group_alias"] is None else r["group_alias"]
        own = (UNNAMED_DERIVED if alias is None else alias) if derived is not None else tbl
        seen = shown if derived is None else r["group_alias"]
        full = ".".join(p for p in (db, tbl) if p is not None) if shown is None else None
        scopes.setdefault((int(found.block_part[i]), r["branch"]), []).append((home, db, own, seen, own if shown is None else shown, full))

    live = found.skip[rows] == (found.else_depth[rows] if with_else else 0)
    live &= ((role > 0) & (role <= LITERAL)) | found.ends_item[rows] | found.is_relation[rows]
    kept = rows[live]
    columns = (
        kept, row[kept], found.block_part[kept], found.block_id[kept], found.block_alias[kept], found.branch[kept], found.item_no[kept],
        found.pos[kept], found.role[kept], found.code[kept], found.ends_item[kept], item[live], call_pos[live], call_name[live],
    )
    branches, stars = n_branches.tolist(), first_star.tolist()
    last_item = None
    for i, at, block_part, block, block_alias, branch, item_no, pos, what, code, ends, in_item, called_at, called in zip(*(c.tolist() for c in columns)):
        if (at, in_item) != last_item:
            # Where the item's value goes next: onto the union, the derived table or the target.
            last_item, key = (at, in_item), keys[at]
            branch_scope, item_scope = ("", "") if key is None else (f"{key}/{block}/{branch}", f"{key}/{block}/{branch}/{item_no}")
            plain, first, out = plains[in_item], first_names[in_item], out_names[in_item]
            flow = first if branches[block_part] > 1 else out
            onward = joint = None
            if block >= 0:
                onward = packed("" if key is None else f"{key}/d{block}", None, texts[block_alias] if block_alias else UNNAMED_DERIVED, flow)
            elif target_tbl[at] is not None:
                if by_place is not None and by_place[at] and item_no < stars[block_part]:
                    flow = f"{PLACE}{item_no}{PLACE}{flow}"
                onward = packed(key if key is not None and target_db[at] is None else "", target_db[at], target_tbl[at], flow)
            if branches[block_part] > 1:
                joint = packed("" if key is None else f"{key}/{block}/u/{item_no}", None, None, first)
            leaves = onward if joint is None else joint
            output = packed(item_scope, None, None, out)
        if not what:
            r = relations[i]
            if r["tbl"] is not None:
                add(at, "table", packed(branch_scope if r["db"] is None else "", r["db"], r["tbl"], None), None)
            continue
        if called:
            feeds = packed("" if key is None else f"{key}@{called_at}", None, None, f"{texts[called]}()")
        else:
            feeds = leaves if plain else output
        ends_output = ends and not plain
        is_name = what == REF or what == STAR
        owners: list[tuple | None] = [None]
        value = candidates = None
        if is_name:
            col, owners, open_to = _owner_rows(texts[code], what == STAR, scopes.get((block_part, branch), []))
            if open_to is not None:
                candidates = [{"scope": r[0], "db": r[1], "tbl": r[2]} for r in open_to]
            if what == REF:
                value = packed(branch_scope, None, None, col)
        elif what == CALL:
            value = packed("" if key is None else f"{key}@{pos}", None, None, f"{texts[code]}()")
        elif what == LITERAL:
            value = packed(item_scope, None, None, _unquoted(texts[code]).lower())
        for owner in owners:
            if owner is None:
                if value is not None:
                    add(at, "value", value, feeds, candidates)
            else:
                base = packed(owner[0] or "", owner[1], owner[2], col)
                seen = None if owner[3] is None else packed(branch_scope, None, owner[3], col)
                add(at, "value", base if seen is None else seen, feeds, candidates)
                add(at, "alias", base, seen)
            if ends_output:
                add(at, "output", output, leaves)
            if joint is not None and (ends_output or (is_name and plain)):
                add(at, "union", joint, onward)
    made = {"rule": pa.array(rules, pa.string()), "src": pa.array(sources, pa.string()), "dst": pa.array(targets, pa.string()), "candidates": pa.array(options, _CANDIDATES)}
    return np.array(of_row, np.int64), made


def _whole_statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about ``TOKENS_AT_ONCE`` tokens that part no statement; its rows follow each other."""
    held: pa.RecordBatch | None = None

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        """Rows with which a statement begins."""
        key = batch.column("stmt_key").dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.flatnonzero(np.append(True, key[1:] != key[:-1]))

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        before = np.append(0, np.cumsum(sizes))
        begins = np.append(runs(batch), batch.num_rows)
        first = 0
        while first < batch.num_rows:
            # As many whole statements as fit, one at least.
            fit = np.searchsorted(before[begins], before[first] + TOKENS_AT_ONCE, "right") - 1
            until = max(int(begins[fit]), int(begins[np.searchsorted(begins, first, "right")]))
            yield batch.slice(first, until - first)
            first = until

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        cut = int(runs(batch)[-1])
        held = batch.slice(cut)
        if cut:
            yield from slices(batch.slice(0, cut))
    if held is not None:
        yield from slices(held)


def _read(batch: pa.RecordBatch) -> SimpleNamespace | None:
    """The nested tokens of whole statements; ``row`` is the row of the batch that each comes from."""
    lists = batch.column("tokens")
    flat = lists.flatten().dictionary_encode()
    if not len(flat):
        return None
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = batch.column("stmt_key").dictionary_encode(null_encoding="encode").indices.to_numpy()
    group = np.cumsum(np.append(False, key[1:] != key[:-1]))[row]

    codes, texts = dict(_FIXED), ["", *_FIXED, ""]
    raws = flat.dictionary.to_pylist()
    kinds, named = np.empty(len(raws), np.int8), np.empty(len(raws), np.int64)
    for i, raw in enumerate(raws):
        kinds[i] = kind = _kind(raw)
        text = raw.replace("`", "").lower() if kind == WORD else raw
        code = codes.get(text)
        if code is None:
            code = codes[text] = len(texts)
            texts.append(text)
        named[i] = code
    index = flat.indices.to_numpy()
    code, kind = named[index], kinds[index]
    # Rows of one statement are one text by place.
    tied = int(group[-1] - group[0]) + 1 < len(np.unique(row))
    if tied:
        order = np.lexsort((row, pos, group))
        code, kind, pos, group, row = code[order], kind[order], pos[order], group[order], row[order]
    found = _nest(_surroundings(code, kind, pos, group, row, texts, codes), tied)
    found.texts, found.tied = texts, tied
    return found


def _walk(statements: DataFrame, carried: list[str], make: Callable, made: str) -> DataFrame:
    """Columns ``carried`` of the statements and those that ``make`` finds in their tokens."""
    spark = statements.sparkSession
    ship_package(spark)
    # Texts, not tokens, are sorted.
    spread = statements.repartition(shuffle_width(spark), "stmt_id").sortWithinPartitions("stmt_id")
    others = [c for c in statements.columns if c not in ("stmt_id", "sql")]
    cut = spread.selectExpr("stmt_id", "CAST(stmt_id AS string) AS stmt_key", *others, f"{T.TOKENS_SQL} AS tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_statements(batches):
            found = _read(batch)
            if found is None:
                continue
            rows, columns = make(found, batch)
            if len(rows):
                kept = [batch.column(c).take(pa.array(rows)) for c in carried]
                yield pa.RecordBatch.from_arrays([*kept, *columns.values()], [*carried, *columns])

    schema = StructType([*(statements.schema[c] for c in carried), *StructType.fromDDL(made)])
    return cut.mapInArrow(run, schema)


def walk_relations(query: DataFrame, carried: list[str]) -> DataFrame:
    """The relations of FROM clauses: ``block_id`` and the fields of ``RELATION``, behind the columns ``carried``."""
    return _walk(query, carried, _relations, f"block_id int, {RELATION}")


def walk_links(query: DataFrame, with_else: bool = False) -> DataFrame:
    """``(stmt_id, seq, rule, src, dst, candidates)`` of ``query(stmt_id, seq, target_db, target_tbl, sql)``, ends packed; ``by_place`` says what goes by place."""
    make = lambda found, batch: _links(found, batch, with_else)
    return _walk(query, ["stmt_id", "seq"], make, "rule string, src string, dst string, candidates array<struct<scope: string, db: string, tbl: string>>")
