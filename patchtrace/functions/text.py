"""Regex fragments and column helpers shared by the operators.

All patterns here are written in the common subset of Java regex (Spark) and RE2
(the SQL oracle): no lookbehind, explicit character classes instead of ``\\s``/``.``
where the two engines differ, and every extract names its group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, which str.strip(), str.split() and the Unicode ``\s``
# of the re module all use. Spelled out because Java's ``\s`` and RE2's ``\s``
# are ASCII and differ from each other (vertical tab).
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
S = f"[{WS}]"          # one whitespace char
NS = f"[^{WS}]"        # one non-whitespace char
# the same set as characters, to trim by
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Python's Unicode ``\w`` (letters, numbers, underscore)
W = r"[\p{L}\p{N}_]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: drop leading and trailing whitespace (the full Unicode set).

    Only the ends are looked at, however long the text is."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def py_lstrip(c) -> Column:
    return F.ltrim(col_(c), F.lit(WS_CHARS))


def py_split_ws(c) -> Column:
    """``str.split()`` without arguments: fields between whitespace runs, no empties."""
    return F.split(py_strip(c), f"{S}+")


def empty_to_null(c) -> Column:
    c = col_(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def count_char(c, ch: str) -> Column:
    """Occurrences of one literal character."""
    c = col_(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("int")


def lit_pattern(p: str) -> Column:
    return F.lit(p)


def sql_str(s: str) -> str:
    """Quote a Python string as an SQL literal (both engines accept '' escaping).

    Backslashes are doubled only for Spark's parser; see ``spark_sql_str``.
    """
    return "'" + s.replace("'", "''") + "'"


def spark_sql_str(s: str) -> str:
    """Quote a Python string as a Spark SQL literal (backslash is an escape there)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
