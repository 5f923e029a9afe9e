"""Column expressions that clean script text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text erased from every line, and the characters a statement is trimmed of.
ERASED_TEXT = ("STORED AS PARQUET",)
BLANKS = "".join(chr(i) for i in range(33))

# What may stand before a comment mark: plain text, a lone dash with the character it
# protects, closed strings. Nothing is given back once matched, so long lines cost neither
# time nor stack, and an unclosed string hides what follows it.
_COMMENT = r"""(?s)^((?:[^'"\-]++|-[^\-]|'[^']*+'|"[^"]*+")*+)--.*$"""


def drop_hash_line(line: Column) -> Column:
    """A line that starts with ``#`` becomes empty; leading blanks keep it."""
    return F.when(line.startswith("#"), F.lit("")).otherwise(line)


def strip_dash_comment(line: Column) -> Column:
    """Cut a line at the first ``--`` outside a quoted string."""
    return F.when(line.contains("--"), F.regexp_replace(line, _COMMENT, "$1")).otherwise(line)


def erase_keywords(line: Column) -> Column:
    for text in ERASED_TEXT:
        line = F.replace(line, F.lit(text), F.lit(""))
    return line


def clean_line(line: Column) -> Column:
    return erase_keywords(strip_dash_comment(drop_hash_line(line)))


def substitute_variables(text: Column) -> Column:
    """``${x}`` gives ``x``, ``${p:x}`` gives ``p-x``; closing ``^`` marks go away."""
    prefixed = F.regexp_replace(text, r"\$\{(\w+?):(\S+?)\^*\}", "$1-$2")
    return F.regexp_replace(prefixed, r"\$\{(\S+?)\^*\}", "$1")


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalize_identifier(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("`"), F.lit("")))


def full_name(*parts: Column) -> Column:
    """Dotted name of the parts that are present."""
    return F.concat_ws(".", *parts)
