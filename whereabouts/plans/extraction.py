"""Corpus to definitions, calls and imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import definitions as D
from ..operators import fragments as FR
from ..operators.html import page_definitions
from ..rules.builtin import BUILTIN, RULES
from ..rules.model import Rule, RuleSet


CHARS = 1 << 21  # of raw contents in one task: rows, events and what lies around them take some 80 times as much while sorted


def ruled_languages(rules: list[Rule] = RULES) -> tuple[str, ...]:
    return (*sorted({x for r in rules for x in r.languages}), "HTML")


def rule_language(rules: RuleSet, language: Column) -> Column:
    """The language whose rules apply: its own, or its group's where it has none."""
    ruled = set(ruled_languages(rules.rules))
    served = sorted((x, group) for x, group in rules.groups.items() if x not in ruled and group in ruled)
    for name, group in served:
        language = F.when(language == name, group).otherwise(language)
    return language


def _for_languages(languages: tuple[str, ...] | None, rules: RuleSet) -> RuleSet:
    """Rules, contexts and settings of just these languages, so the plan stays small."""
    if languages is not None:
        ruled = set(ruled_languages(rules.rules))
        wanted = {x if x in ruled else rules.groups.get(x, x) for x in languages}
        keep = lambda row: row._replace(languages=tuple(x for x in row.languages if x in wanted))
        kept = lambda rows: [keep(r) for r in rows if wanted & set(r.languages)]
        lexis = {tuple(x for x in names if x in wanted): settings for names, settings in rules.lexis.items() if wanted & set(names)}
        rules = rules._replace(rules=kept(rules.rules), contexts=kept(rules.contexts), references=kept(rules.references), lexis=lexis)
    lacking = {x for r in rules.rules for x in r.languages} - {x for names in rules.lexis for x in names}
    if lacking:
        raise ValueError(f"rules without lexical settings: {', '.join(sorted(lacking))}")
    return rules


def _levels(files: DataFrame, languages: tuple[str, ...] | None, max_depth: int | None) -> int:
    """Levels of fragments: as given, none without containers, one in pages alone, else as deep as the corpus goes."""
    if languages is not None and not set(languages) & set(FR.CONTAINERS):
        return 0
    if languages is not None and "Markdown" not in languages:
        return 1
    return FR.depth_of(files) if max_depth is None else max_depth


def task_count(files: DataFrame) -> int:
    """Tasks of an extraction: by the characters of its contents, so that a task's share does not grow with the corpus.

    Never as many as ``spark.sql.shuffle.partitions``: a shuffle like the one that grouped the files is dropped, and the
    partitions of that one are coalesced by their compressed size, to a few for all cores.
    """
    spark = files.sparkSession
    chars = files.agg(F.sum(F.length("content").cast("long")).alias("n")).first()["n"] or 0
    count = max(-(-chars // CHARS), spark.sparkContext.defaultParallelism)
    return count + 1 if count == int(spark.conf.get("spark.sql.shuffle.partitions")) else count


def units_of(
    files: DataFrame,
    languages: tuple[str, ...] | None = None,
    max_depth: int | None = None,
    partitions: int | None = None,
    rules: RuleSet = BUILTIN,
) -> DataFrame:
    """Files and their fragments, placed by file: the one shuffle of an extraction.

    Raw contents move, before rows multiply; every window after this keeps the placement. The
    number of partitions is that of ``task_count`` unless given: it takes one more pass over the contents, and keeps
    what a task sorts in memory.
    """
    count = partitions or task_count(files)
    recipe = [F.col("recipe")] if "recipe" in files.columns else []
    placed = files.select("file_id", rule_language(rules, F.col("language")).alias("language"), *recipe, "content").repartition(count, "file_id")
    if languages is not None and not set(languages) & set(FR.CONTAINERS):
        none = F.lit(None).cast("string")
        units = placed.select(
            "file_id", F.lit("").alias("unit"), none.alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("line_no"),
            F.lit(0).alias("start_line"), "language", none.alias("hint"), *recipe, "content",
        )
    else:
        units = FR.with_fragments(placed, _levels(files, languages, max_depth), lambda x: rule_language(rules, x))
    return units


def extract(
    files: DataFrame,
    languages: tuple[str, ...] | None = None,
    rules: RuleSet | list[Rule] = BUILTIN,
    keep: Callable[[Column], Column] | None = None,
    fragment_pattern: str | None = None,
    max_depth: int | None = None,
    references: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Definitions of a corpus of ``file_id, language, content``.

    With ``references`` the result also has rows of kind ``call``, ``import`` and ``dotted``.

    ``languages`` names the languages that the corpus can hold, fragments included.
    Fragments are followed until none is left, unless ``max_depth`` says how many levels there are.
    ``fragment_pattern`` skips fragments in which the searched text does not occur.
    ``rules`` is a rule set, built in or compiled from rows, or a list of rules in place of the built-in ones. A language
    without rules goes by those of its group; ``language`` of a result is the one whose rules found it.
    """
    whole = rules if isinstance(rules, RuleSet) else BUILTIN._replace(rules=rules)
    kept = _for_languages(languages, whole)
    kept_rules = [*kept.rules, *kept.references] if references else kept.rules
    contexts, lexis = kept.contexts, kept.lexis
    max_depth = _levels(files, languages, max_depth)
    units = units_of(files, languages, max_depth, partitions, whole)
    if fragment_pattern is not None:
        units = units.where((F.col("depth") == 0) | F.col("content").rlike(fragment_pattern))
    shaped = units.select("file_id", "unit", "language", "start_line", "content")
    line_languages = [x for names in lexis for x in names]
    found = D.definitions(shaped.where(F.col("language").isin(*line_languages)), kept_rules, contexts, lexis, keep)
    if languages is None or "HTML" in languages:
        found = found.unionByName(page_definitions(shaped.where(F.col("language") == "HTML"), keep))
    if languages is None or set(languages) & set(FR.CONTAINERS):
        found = with_host_context(found, max_depth)
    return found.where(F.col("kind") != "fragment")


def with_host_context(found: DataFrame, max_depth: int) -> DataFrame:
    """Add the rows around a fragment to everything found inside it, outermost last."""
    opener = F.when(F.col("rule_id") == "html_fragment", F.get("names", F.lit(0))).otherwise(F.col("line_no").cast("string"))
    inside = F.concat(F.col("unit"), F.lit("/"), opener)
    depth = F.size(F.split("unit", "/")) - 1
    for level in range(1, max_depth + 1):
        hosts = (F.col("kind") == "fragment") & (depth == level - 1)
        here = F.when(hosts, inside).when(depth == level, F.col("unit")).otherwise(F.concat(F.lit("-"), F.col("unit")))
        shown = F.max(F.when(F.col("_hosts"), F.when(F.col("rule_id") == "md_front_matter", F.col("headers")).otherwise(F.col("ranges")))).over(Window.partitionBy("file_id", "_here"))
        found = (
            found.withColumns({"_hosts": hosts, "_here": here})
            .withColumn("_shown", shown)
            .withColumn(
                "ranges",
                F.when((depth == level) & F.col("_shown").isNotNull(), F.concat("ranges", "_shown")).otherwise(F.col("ranges")),
            )
            .drop("_hosts", "_here", "_shown")
        )
    return found
