"""What a statement's text is made of: the token pattern and the fixed word lists."""

from __future__ import annotations

# Bracketed comment, the two string forms, numbers with an exponent or a leading dot, dotted names (with back-quoted parts and a
# closing star), operators of two or three signs, and any other single sign.
TOKEN_PATTERN = (
    r"/\*[\s\S]*?\*/"
    r"|'(?:[^'\\]++|\\[\s\S])*+'"
    r'|"(?:[^"\\]++|\\[\s\S])*+"'
    r"|(?:[0-9]+(?:\.[0-9]*)?[eE][+-]?[0-9]+|\.[0-9]+(?:[eE][+-]?[0-9]+)?)(?:[lLsSyYdDfF]|[bB][dD])?(?![\p{L}\p{N}_$.])"
    r"|(?:[\p{L}\p{N}_$]+|`[^`]*`)(?:\.(?:[\p{L}\p{N}_$]+|`[^`]*`|\*))*"
    r"|<=>|<>|!=|<=|>=|==|\|\||&&"
    r"|\S"
)
NUMBER_PATTERN = r"^(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][+-]?[0-9]+)?([lLsSyYdDfF]|[bB][dD])?$"

# Words of the SQL dialect.
CLAUSE_WORDS = ("select", "from", "where", "having", "union", "limit", "lateral", "intersect", "except", "minus", "window")
CLAUSE_WORDS_BY = ("group", "order", "sort", "cluster", "distribute")
JOIN_WORDS = ("join", "inner", "left", "right", "full", "outer", "cross", "semi", "anti", "natural", "on", "using")
OPERATOR_WORDS = ("and", "or", "not", "is", "in", "between", "like", "rlike", "regexp", "div", "escape")
EXPRESSION_WORDS = ("case", "when", "then", "else", "end", "as", "distinct", "all", "over", "cast", "exists", "interval", "asc", "desc", "by")
CONSTANT_WORDS = ("null", "true", "false")
TYPED_LITERAL_WORDS = ("date", "timestamp")

INTERVAL_UNITS = tuple(f"{unit}{s}" for unit in ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond") for s in ("", "s"))

RESERVED = CLAUSE_WORDS + CLAUSE_WORDS_BY + JOIN_WORDS + OPERATOR_WORDS + EXPRESSION_WORDS
# Words that may open an argument list although they are reserved elsewhere.
CALLABLE_RESERVED = ("left", "right")
# Words that cannot be the alias of a relation standing before them.
NOT_RELATION_ALIAS = RESERVED + ("tablesample",)


def words(*groups: tuple[str, ...]) -> str:
    """A list for SQL ``IN``."""
    return "(" + ", ".join(f"'{w}'" for group in groups for w in group) + ")"


def text(pattern: str) -> str:
    """A pattern as a SQL string, exactly as written."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Comments are tokens only to be dropped.
TOKENS_SQL = f"filter(regexp_extract_all(sql, {text(TOKEN_PATTERN)}, 0), t -> NOT startswith(t, '/*'))"
KIND_SQL = f"""
CASE WHEN length(raw) > 1 AND substring(raw, 1, 1) IN ('\\'', '"') THEN 'string'
     WHEN raw RLIKE {text(NUMBER_PATTERN)} THEN 'number'
     WHEN raw RLIKE {text(r"^[\p{L}\p{N}_$`]")} THEN 'word'
     ELSE 'symbol' END"""
# Words in lower case without back-quotes; everything else as written.
TEXT_SQL = "CASE WHEN kind = 'word' THEN lower(replace(raw, '`', '')) ELSE raw END"
# A literal or alias without its quotes; the star of count(*) counts as the literal 1. An interval literal is named in full.
UNQUOTED_SQL = r"""CASE WHEN tok = '*' THEN '1' WHEN tok RLIKE '^[\'"]' THEN substring(tok, 2, length(tok) - 2) ELSE tok END"""
# Parts of a dotted name.
LAST_PART_SQL = r"element_at(split(tok, '\\.'), -1)"
QUALIFIER_SQL = r"CASE WHEN size(split(tok, '\\.')) > 1 THEN array_join(slice(split(tok, '\\.'), 1, size(split(tok, '\\.')) - 1), '.') END"
