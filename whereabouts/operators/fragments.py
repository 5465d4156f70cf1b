"""Embedded fragments: code fences, front matter, scripts and styles in pages.

All of it is per-row expressions: an opener gets its row number written next to it before the
text is cut, so a fragment knows where it starts without any shuffle or window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .language import hinted_language

_L, _R = chr(0xE300), chr(0xE301)
_MARK = f"{_L}[0-9]+{_R}"
CONTAINERS = ("Markdown", "HTML")
FIRST_GUESS = 4  # levels tried first when the depth of a corpus is looked up

FENCE = rf"(?m:^ {{0,3}}(`{{3,}}|~{{3,}})[^\n]*$)(?s:.*?)(?:(?m:^ {{0,3}}\1[`~]*[ \t]*(?:{_MARK})?$)|\z)"
MATTER = rf"\A---[ \t]*{_MARK}\n(?s:.*?)\n---[ \t]*(?:{_MARK})?(?=\n|\z)"
ELEMENT = r"<!--(?s:.*?)-->|(?i:<(script|style)\b)[^>]*>(?s:.*?)(?i:</\1\s*>)"

FRAGMENTS = "array<struct<ordinal:int,line_no:int,start_line:int,hint:string,body:string>>"


def _numbered(content: Column, opener: str, put: str) -> Column:
    """The text with the row number written at each opener."""
    rows = F.split(content, "\n", -1)
    mark = lambda i: F.concat(F.lit(put + _L), i.cast("string"), F.lit(_R))
    return F.array_join(F.transform(rows, lambda x, i: F.regexp_replace(x, F.lit(opener), mark(i))), "\n")


def _parts(content: Column, first: Column, token: str, lead: str) -> Column:
    """``lead`` is the opener inside a token; what follows it is the body."""
    found = F.regexp_extract_all(content, F.lit(token), F.lit(0))
    found = F.filter(found, lambda t: ~t.startswith("<!--"))

    def part(t: Column, k: Column) -> Column:
        row = F.regexp_extract(t, f"{_L}([0-9]+){_R}", 1).cast("int") + first
        head = F.regexp_extract(t, lead, 0)
        body = F.regexp_replace(F.substring(t, F.length(head) + 1, F.length(t)), _MARK, "")
        fenced = t.rlike(r"^ {0,3}[`~]")
        matter = t.startswith("---")
        body = F.when(fenced, F.regexp_replace(body, r"(?m:^ {0,3}(?:`{3,}|~{3,})[ \t]*)\z", "")).when(
            matter, F.regexp_replace(body, r"---[ \t]*\z", "")
        ).otherwise(F.regexp_replace(body, r"(?i:</(?:script|style)\s*>)\z", ""))
        named = F.regexp_extract(t, rf"^ {{0,3}}[`~]{{3,}}[ \t]*\{{?\.?([^\s`{{}},{_L}]*)", 1)
        kind = F.lower(F.regexp_extract(t, r"^<(\w+)", 1))
        said = F.when(fenced, F.nullif(named, F.lit(""))).when(matter, "YAML").when(kind == "script", "JavaScript").when(kind == "style", "CSS")
        return F.struct(
            k.cast("int").alias("ordinal"),
            row.alias("line_no"),
            (row + T.count_chars(head, "\n")).cast("int").alias("start_line"),
            said.alias("hint"),
            body.alias("body"),
        )

    return F.filter(F.transform(found, part), lambda f: F.length(F.trim(f["body"])) > 0)


def fragments_of(content: Column, language: Column, first: Column) -> Column:
    """Fragments of one text as an array; ``first`` is the row number of its first row."""
    fences = _parts(
        _numbered(content, r"^(---[ \t]*| {0,3}(?:`{3,}|~{3,})[^\n]*)\z", "$1"),
        first,
        rf"{MATTER}|{FENCE}",
        r"^[^\n]*\n",
    )
    pages = _parts(_numbered(content, r"(?i:<(?:script|style)\b)", "$0 "), first, ELEMENT, r"^<[^>]*>")
    empty = F.array().cast(FRAGMENTS)
    return F.when(language == "Markdown", fences).when(language == "HTML", pages).otherwise(empty)


def _cut(f: Column) -> Column:
    """The step that takes a fragment out of the text around it: its rows in the file, from 0, the end left out."""
    rows = T.count_chars(f["body"], "\n") + F.when(f["body"].endswith("\n"), 0).otherwise(1)
    return F.concat(F.lit("rows "), f["start_line"].cast("string"), F.lit("-"), (f["start_line"] + rows).cast("string"))


def _one_argument(make, depth: int):
    """A one-argument function, as ``transform`` asks for; a default would be taken as the index."""
    return lambda parent: make(depth, parent)


def depth_of(files: DataFrame) -> int:
    """Levels of fragments in a corpus, ``FIRST_GUESS`` at least; more levels are tried until the deepest holds no container.

    Runs a job per try, nearly always one. A container at level ``n`` lies within ``n`` openers, so only files with
    enough rows that look like one are cut up; the others are scanned once for them.
    """
    opener = r"(?m:^ {0,3}(?:`{3,}|~{3,}))"
    container = F.col("language").isin(*CONTAINERS)
    many = F.size(F.regexp_extract_all("content", F.lit(opener), F.lit(0))) >= FIRST_GUESS
    deep = files.where(container & many).select("file_id", "language", "content")
    tried = FIRST_GUESS
    while True:
        top = with_fragments(deep, tried).where(container).agg(F.max("depth")).first()[0]
        if top is None or top < tried:
            return max(FIRST_GUESS, (top or 0) + 1)
        tried *= 2


def with_fragments(files: DataFrame, max_depth: int | None = None, ruled: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Units of a corpus: each file, then its fragments, theirs, and so on, until none is left.

    ``max_depth`` is the number of levels where it is known; otherwise it is looked up. ``ruled`` turns the language of a fragment
    into the one whose rules apply. Adds ``unit`` (empty for the file itself), ``start_line``, ``depth`` and ``hint``.
    ``unit`` of a fragment is its parent's with ``/`` and the row or the number of its opener. ``recipe`` tells how to come by
    the text: that of the file, then the rows taken at each level.
    """
    shape = "array<struct<unit:string,parent:string,depth:int,line_no:int,start_line:int,language:string,hint:string,recipe:array<string>,content:string>>"

    def inside(depth: int, parent: Column) -> Column:
        is_page = parent["language"] == "HTML"
        found = fragments_of(parent["content"], parent["language"], parent["start_line"])
        return F.transform(
            found,
            lambda f: F.struct(
                F.concat(parent["unit"], F.lit("/"), F.when(is_page, f["ordinal"]).otherwise(f["line_no"]).cast("string")).alias("unit"),
                parent["unit"].alias("parent"),
                F.lit(depth).alias("depth"),
                f["line_no"].alias("line_no"),
                f["start_line"].alias("start_line"),
                ruled(hinted_language(f["hint"], f["body"])).alias("language"),
                f["hint"].alias("hint"),
                F.array_append(parent["recipe"], _cut(f)).alias("recipe"),
                f["body"].alias("content"),
            ),
        )

    recipe = F.col("recipe") if "recipe" in files.columns else F.array(F.concat(F.lit("cat "), F.col("file_id").cast("string")))
    max_depth = depth_of(files) if max_depth is None else max_depth
    host = F.array(
        F.struct(
            F.lit("").alias("unit"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("line_no"),
            F.lit(0).alias("start_line"), F.col("language").alias("language"), F.lit(None).cast("string").alias("hint"),
            recipe.alias("recipe"), F.col("content").alias("content"),
        )
    ).cast(shape)
    units = files.withColumn("_u0", host)
    is_container = F.col("language").isin(*CONTAINERS)
    for depth in range(1, max_depth + 1):
        above = F.col(f"_u{depth - 1}")
        found = F.flatten(F.transform(above, _one_argument(inside, depth))).cast(shape)
        units = units.withColumn(f"_u{depth}", F.when(is_container & (F.size(above) > 0), found).otherwise(F.array().cast(shape)))
    every = F.concat(*[F.col(f"_u{d}") for d in range(max_depth + 1)])
    others = [c for c in files.columns if c not in ("content", "language", "recipe")]
    return units.select(*others, F.explode(every).alias("_u")).select(*others, "_u.*")
