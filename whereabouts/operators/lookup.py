"""Names asked for, put to the names defined."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import names as N
from ..functions import text as T
from ..session import cut
from .ranges import union_ranges

# What makes a match depend on more than the characters it takes up, and what can take up a row end.
ANCHORED = re.compile(r"\^|\$|\\[AbBGzZQE]|\(\?(?!:)")
CROSSING = re.compile(r"\[\^|\\[^wdS.\\\[\](){}|?*+^$/_-]")


def has_row_matching(content: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Candidate test: the pattern, not anchored, inside one row of the raw text.

    Unless it has anchors or looks around, a match in a row is one in the text, so texts without any are not cut into
    rows; and where it can't take up a row end, nor is there a CR that would be dropped from one, no text is.
    """
    flags = "(?iud)" if ignore_case else "(?d)"
    loose = flags + pattern
    rows = F.exists(T.split_lines(content), lambda x: x.rlike(loose))
    if ANCHORED.search(pattern):
        return rows
    whole = content.rlike(loose)
    if CROSSING.search(pattern):
        return F.when(whole, rows).otherwise(whole)
    return F.when(whole & (F.instr(content, "\r") > 0), rows).otherwise(whole)


def candidate_files(files: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    return files.where(has_row_matching(F.col("content"), pattern, ignore_case))


def name_test(pattern: str, ignore_case: bool = False) -> Callable[[Column], Column]:
    """Whole-name test of a names array, as ``keep`` for an extraction."""
    whole = ("(?iu)" if ignore_case else "") + "^(" + pattern + r")\z"
    return lambda names: F.exists(names, lambda x: x.rlike(whole))


# Marks for what a pattern does not spell out, and for what this reader does not follow.
GAP, LOST = "\ue200", "\ue201"
GRAM = 3
SIZES = (GRAM, 4, 6, 8, 12, 16, 24, 32)  # of runs that names are indexed by; a literal goes by the longest that it has
FEW = 10_000  # rows of a table that may be sent to every task, by way of the driver
# ASCII in one case, and the other letters that a pattern without regard to case takes for ASCII ones.
CASED, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u0130\u0131\u017f\u212a", "abcdefghijklmnopqrstuvwxyziisk"
WHOLE_GROUP = r"(?<=^|[(|])\(([^()]*)\)(?=\z|[|)])"  # a group that is all of an alternative, so its own ones count as the outer's
NESTING = 6  # levels of groups that are looked through
LANES = 64  # shares of the names that a pattern without literals is tried on


def is_valid(pattern: Column) -> Column:
    """Whether a pattern compiles."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def required_literals(pattern: Column, ignore_case: Column) -> Column:
    """Texts of ``GRAM`` characters or more, folded, of which every match holds one; NULL where no such set is seen.

    The pattern is read from the outside: classes, escapes, groups and what may be missing leave a gap, and of every
    alternative the longest text between gaps counts; a group that is all of one is read like the outside. Anything unusual (flags, quoting, look-around, classes in classes) is not read.
    """
    times = r"(?:[?*+]|\{[^}]*\})*"
    known = pattern
    for found, put in (
        (rf"\\[dDwWsSbBzZA]{times}", GAP),
        (r"(?s)\\[A-Za-z0-9].*", LOST),
        (r"(?s)\\.", GAP),
        (rf"\[\^?\]?[^\[\]&]*\]{times}", GAP),
        (r"\(\?:", "("),
        (r"(?s)\(\?.*", LOST),
        *[(WHOLE_GROUP, "$1"), (rf"(?<!^)(?<![(|])\([^()]*\){times}|\([^()]*\)(?!\z|[|)]){times}", GAP)] * NESTING,
    ):
        known = F.regexp_replace(known, found, put)
    known = F.regexp_replace(known, r"[^\\()\[\]](?:[?*][?+]?|\{[^}]*\}[?+]?)", GAP)
    known = F.regexp_replace(known, r"[+.^$]", GAP)
    unread = known.rlike(rf"[{LOST}()\[\]{{}}\\?*&]")
    folded = F.when(ignore_case, F.regexp_replace(F.translate(known, CASED, FOLDED), r"[^\x00-\x7F|]", GAP)).otherwise(F.translate(known, CASED, FOLDED))
    texts = F.transform(
        F.split(folded, r"\|", -1),
        lambda one: F.aggregate(F.split(one, GAP, -1), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)),
    )
    return F.when(~unread & ~F.exists(texts, lambda x: F.length(x) < GRAM), F.array_distinct(texts))


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters of a text, none of a shorter one."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _longest_grams(text: Column) -> Column:
    """The runs of the longest of ``SIZES`` that the text has."""
    of = _grams(text, SIZES[0])
    for size in SIZES[1:]:
        of = F.when(F.length(text) >= size, _grams(text, size)).otherwise(of)
    return of


def unsent(df: DataFrame, many: bool) -> DataFrame:
    """A side of a join; where there are many rows, both sides are shuffled, so none goes through the driver."""
    return df.hint("merge") if many else df


def is_many(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() > FEW


def prepared_terms(terms: DataFrame) -> DataFrame:
    """Patterns ready for use, how each is looked up, and why not: ``not_recaseable``, ``bad_pattern`` or ``no_pattern``.

    ``terms`` has ``term_id, pattern, ignore_case, case_style``. Plain words go by equality,
    words in any case or style by an equal folded key with the pattern as the last test, and
    true patterns by a literal that they require (see ``matching_names``).
    """
    styled = F.coalesce("case_style", F.lit(False))
    cased = F.coalesce("ignore_case", F.lit(False)) | styled
    bad = F.when(styled, N.bad_case_style_at(F.col("pattern")))
    pattern = F.when(styled, N.case_style_pattern(F.col("pattern"))).otherwise(F.col("pattern"))
    word = F.col("pattern").rlike(r"^[A-Za-z0-9_-]+\z")
    how = F.when(styled, "folded").when(word & cased, "folded").when(word, "equal").otherwise("pattern")
    status = F.when(F.col("pattern").isNull(), "no_pattern").when(bad.isNotNull(), "not_recaseable")
    status = status.when((how == "pattern") & ~is_valid(F.col("pattern")), "bad_pattern").otherwise("ok")
    ready = terms.withColumns({"_status": status, "_cased": cased, "_pattern": pattern, "_how": how, "_bad": bad})
    ok = F.col("_status") == "ok"
    return ready.select(
        "term_id",
        F.col("pattern").alias("asked"),
        F.col("_pattern").alias("pattern"),
        F.when(ok, N.whole_pattern(F.col("_pattern"), F.col("_cased"))).alias("full_pattern"),
        N.squeezed(F.col("pattern")).alias("folded"),
        F.when(ok, F.col("_how")).otherwise("none").alias("how"),
        F.col("_cased").alias("cased"),
        F.col("_status").alias("status"),
        F.col("_bad").alias("bad_at"),
    )


def matching_names(names: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term_id, name)`` for distinct ``names`` and prepared ``terms``."""
    ready = cut(terms.where("status = 'ok'").select("term_id", "asked", "pattern", "full_pattern", "folded", "cased", "how"))
    many = is_many(ready)
    equal = names.join(unsent(ready.where("how = 'equal'").select("term_id", F.col("asked").alias("name")), many), "name").select("term_id", "name")
    folded = (
        names.withColumn("folded", N.squeezed(F.col("name")))
        .join(unsent(ready.where("how = 'folded'").select("term_id", "folded", "full_pattern"), many), "folded")
        .where(F.expr("name RLIKE full_pattern"))
        .select("term_id", "name")
    )
    return equal.unionByName(folded).unionByName(_by_pattern(names.select("name"), ready.where("how = 'pattern'").select("term_id", "pattern", "full_pattern", "cased"), many))


def _by_pattern(names: DataFrame, patterns: DataFrame, many: bool = False) -> DataFrame:
    """``(term_id, name)`` of true patterns: names are indexed by their runs of ``SIZES`` characters, and of each literal that
    a pattern requires the rarest of its longest runs leads to the names that are tried. Equal patterns are tried once.

    A pattern of which no literal is seen has to be tried on every name; the names are dealt over lanes for that.
    """
    if patterns.isEmpty():
        return names.sparkSession.createDataFrame([], StructType([patterns.schema["term_id"], names.schema["name"]]))
    tried = patterns.select("pattern", "full_pattern", "cased").distinct().withColumn("literals", required_literals(F.col("pattern"), F.col("cased")))
    tried = cut(tried.select("full_pattern", "literals"))
    wanted = tried.where("literals IS NOT NULL").select("full_pattern", F.explode("literals").alias("literal"))
    wanted = cut(wanted.distinct().select("full_pattern", "literal", F.explode(_longest_grams(F.col("literal"))).alias("gram")))
    sizes = sorted(r.size for r in wanted.select(F.length("gram").alias("size")).distinct().collect())
    key = F.translate("name", CASED, FOLDED)
    runs = F.flatten(F.array(*[_grams(key, size) for size in sizes])) if sizes else F.array().cast("array<string>")
    grams = names.select("name", F.explode(runs).alias("gram"))
    grams = grams.join(unsent(wanted.select("gram").distinct(), many), "gram", "left_semi")
    held = grams.groupBy("gram").agg(F.count("*").alias("held"))
    # a run that no name has: no match
    rare = unsent(wanted, many).join(held, "gram", "left").groupBy("full_pattern", "literal").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("r"))
    rare = rare.where("r.held > 0").select("full_pattern", F.col("r.gram").alias("gram")).distinct()
    met = grams.join(unsent(rare, many), "gram").where(F.expr("name RLIKE full_pattern")).select("full_pattern", "name").distinct()
    free = tried.where("literals IS NULL").select("full_pattern", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")).distinct()
    dealt = names.withColumn("lane", F.pmod(F.xxhash64("name"), F.lit(LANES)).cast("int"))
    found = met.unionByName(dealt.join(unsent(free, many), "lane").where(F.expr("name RLIKE full_pattern")).select("full_pattern", "name"))
    return found.join(unsent(patterns.select("term_id", "full_pattern"), many), "full_pattern").select("term_id", "name")


def named(definitions: DataFrame) -> DataFrame:
    """One row per definition and name."""
    return definitions.withColumn("name", F.explode("names"))


def hits(index: DataFrame, terms: DataFrame, gap: int = 0) -> DataFrame:
    """Merged ranges per term and file. ``index`` has ``name, file_id, ranges``."""
    found = matching_names(index.select("name").distinct(), prepared_terms(terms))
    rows = index.select("name", "file_id", "ranges").join(found, "name")
    flat = rows.select("term_id", "file_id", F.explode("ranges").alias("r")).select("term_id", "file_id", "r.start_line", "r.end_line")
    return union_ranges(flat, ["term_id", "file_id"], gap)


def only_names(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.explode("names").alias("name")).distinct()


def complete(names: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """Names that begin and end so, in any case; nothing for an empty prefix."""
    if not prefix:
        return names.where(F.lit(False)).select("name")
    name = F.lower("name")
    long_enough = F.length("name") >= len(prefix) + len(suffix)
    return names.where(name.startswith(prefix.lower()) & name.endswith(suffix.lower()) & long_enough).select("name").distinct()
