"""Character classes that mean the same in Java's and RE2's regular expressions.

WORD, DIGIT and SPACE are what one expects of Unicode text: letters, numbers and underscore; decimal digits; white space with
the control characters U+001C to U+001F. Java's own \\w, \\d and \\s are ASCII, so patterns here never use them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Insides of character classes.
W_IN = r"\p{L}\p{N}_"
S_IN = r"\t-\r\x1c-\x20\x85\p{Z}"
W, NOT_W = f"[{W_IN}]", f"[^{W_IN}]"
S, NOT_S = f"[{S_IN}]", f"[^{S_IN}]"
D = r"\p{Nd}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count(text: Column | str, pattern: str) -> Column:
    """Non-overlapping matches; 0 for null."""
    return F.coalesce(F.regexp_count(col(text), F.lit(pattern)), F.lit(0))


def all_of(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(NOT_S)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"^{S}+|(?<!{S}){S}+\z", "")


@lru_cache(maxsize=1)
def digits_to_ascii() -> tuple[str, str]:
    """Every decimal digit outside ASCII and its ASCII twin, from the Unicode tables of this Python."""
    other = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(other), "".join(str(unicodedata.digit(c)) for c in other)


# ---------------------------------------------------------------- the same in DuckDB's SQL


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, {group})"


def sql_count(text: str, pattern: str) -> str:
    return f"len({sql_all(text, pattern)})"


def sql_doubled(text: str) -> str:
    """Each non-word character twice, so that neighbours can both claim one as their border (RE2 has no look-around)."""
    return f"regexp_replace({text}, {quoted(f'({NOT_W})')}, '\\1\\1', 'g')"


def sql_isolated(inner: str) -> str:
    """A pattern for whole words, to be used on sql_doubled text."""
    return f"(?:^|{NOT_W})({inner})(?:{NOT_W}|$)"


def sql_blank(text: str) -> str:
    return f"not regexp_matches(coalesce({text}, ''), {quoted(NOT_S)})"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {quoted(f'^{S}+')}, ''), {quoted(f'{S}+$')}, '')"
