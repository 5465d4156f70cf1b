"""Name patterns and name clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_pattern(pattern: Column, ignore_case: Column | None = None) -> Column:
    """The pattern as it is put to a name. ``\\z``, since ``$`` would let a final LF pass."""
    whole = F.concat(F.lit("^("), pattern, F.lit(")\\z"))
    if ignore_case is None:
        return whole
    return F.when(ignore_case, F.concat(F.lit("(?iu)"), whole)).otherwise(whole)


def bad_case_style_at(identifier: Column) -> Column:
    """Byte offset of the first character that a case-style term may not hold, else NULL."""
    head = F.regexp_extract(identifier, r"^[\p{IsAlphabetic}\p{N}_-]*", 0)
    return F.when(F.length(head) < F.length(identifier), F.octet_length(head))


def words(identifier: Column) -> Column:
    """The words of an identifier, lower-case, joined by ``-``."""
    x = F.regexp_replace(identifier, r"(?<=\p{Ll})(\p{N}*)(\p{Lu})", "$1-$2")
    x = F.regexp_replace(x, r"(\p{Lu}\p{N}*)(\p{Lu})(?=\p{Ll})", "$1-$2")
    x = F.regexp_replace(F.lower(x), r"[_-]+", "-")
    return F.regexp_replace(x, r"^-|-\z", "")


def case_style_pattern(identifier: Column) -> Column:
    """A pattern that takes the same words in kebab, snake and camel style."""
    wrapped = F.concat(F.lit("-"), words(identifier), F.lit("-"))
    return F.when(bad_case_style_at(identifier).isNull(), F.replace(wrapped, F.lit("-"), F.lit("[_-]*")))


def squeezed(name: Column) -> Column:
    """Equal for all case styles of a name; a hash-join key, not the full test."""
    return F.regexp_replace(F.lower(name), r"[_-]+", "")


def quoted(name: Column) -> Column:
    """A name as a pattern that takes just that name."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def matching_parts(origin: Column, path: Column) -> Column:
    """Equal parts at the end of a dotted origin and a path, counted from the last one."""
    a = F.reverse(F.split(origin, r"\."))
    b = F.reverse(F.filter(F.split(path, "/"), lambda p: p != ""))
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    miss = F.array_position(same, F.lit(False)).cast("int")
    return F.when(miss == 0, n).otherwise(miss - 1)
