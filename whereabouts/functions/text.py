"""Lines and literal masking.

Masking makes line rules safe: comments become spaces, and punctuation and
blanks inside string literals move to a private-use block, so no rule can match
brackets or keywords there. Lengths and line breaks stay the same, and
``unmask`` brings a name taken from a quoted key back to its own spelling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sql import literal

_BASE = 0xE000
# Printable ASCII outside [0-9A-Za-z_], with tab.
HIDDEN = "\t " + "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
COVER = "".join(chr(_BASE + ord(c)) for c in HIDDEN)

# A literal over several rows acts as a bracket pair, so the rows stay together.
TEXT_OPEN = chr(_BASE + 0x100)
TEXT_CLOSE = chr(_BASE + 0x101)


def split_lines(content: Column) -> Column:
    """Rows of a text: LF ends a row, one CR before it is dropped, no row after a final LF."""
    trimmed = F.when(content.endswith("\n"), F.left(content, F.length(content) - 1)).otherwise(content)
    rows = F.split(trimmed, "\n", -1)
    rows = F.when(F.instr(content, "\r") > 0, F.transform(rows, lambda x: F.regexp_replace(x, "\r\\z", ""))).otherwise(rows)
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(rows)


def _hide(comment: str, shows_first: bool) -> str:
    """SQL for a hidden token ``t``: comments blank, literals covered between their quotes."""
    many = "instr(t, '\\n') > 0"
    inner = f"translate(substring(t, 2, length(t) - 2), {literal(HIDDEN)}, {literal(COVER)})"
    first = f"IF({many}, {literal(TEXT_OPEN)}, left(t, 1))"
    last = f"IF({many}, {literal(TEXT_CLOSE)}, right(t, 1))"
    quoted = f"IF(length(t) < 2, t, concat({first}, {inner}, {last}))"
    blank = "regexp_replace(t, '[^\\n]', ' ')"
    if shows_first:
        row = "substring_index(t, '\\n', 1)"
        blank = f"concat({row}, substring({blank}, length({row}) + 1))"
    return f"IF(t RLIKE {literal(comment)}, {blank}, {quoted})"


def mask_sql(content: str, token: str, comment: str, shows_first: bool = False) -> str:
    """Hide what ``token`` matches; tokens that match ``comment`` turn to blanks."""
    found = f"array_append(regexp_extract_all({content}, {literal(token)}, 0), '')"
    return (
        f"array_join(zip_with(split({content}, {literal(token)}, -1), {found},"
        f" (g, t) -> concat(g, IF(t = '', t, {_hide(comment, shows_first)}))), '')"
    )


def unmask(name: Column) -> Column:
    return F.translate(name, COVER, HIDDEN)


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))
