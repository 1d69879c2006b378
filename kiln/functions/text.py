"""Column helpers for text: Unicode-aware strip/split and blank tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.isspace()/str.strip()/str.split()
# treat as whitespace. Java's (?U)\s lacks U+001C..U+001F, so the class is
# spelled out instead of relying on \s.
WHITESPACE_CODEPOINTS = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
]


def _class(fmt) -> str:
    parts = []
    for lo, hi in WHITESPACE_CODEPOINTS:
        parts.append(fmt(lo) if lo == hi else f"{fmt(lo)}-{fmt(hi)}")
    return "[" + "".join(parts) + "]"


# Java regex flavour (Spark) and RE2 flavour (DuckDB oracle) of the same class.
WS_CLASS = _class(lambda c: f"\\x{{{c:X}}}")
WS_CLASS_RE2 = _class(lambda c: f"\\x{{{c:X}}}")
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"
SPLIT_RE = f"{WS_CLASS}+"


STRIP_CHARS = "".join(chr(c) for lo, hi in WHITESPACE_CODEPOINTS for c in range(lo, hi + 1))


def ustrip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (the
    built-in trim looks at the ends only; a regular expression reads it all)."""
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


def usplit(c) -> Column:
    """Python ``str.split()``: whitespace runs separate, no empty tokens."""
    return F.filter(F.split(_col(c), SPLIT_RE), lambda t: t != F.lit(""))


def is_blank(c) -> Column:
    """True when the string is empty after a Unicode strip (null counts as blank)."""
    return F.coalesce(ustrip(c) == F.lit(""), F.lit(True))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
