"""Rule rows put to masked rows of text: what is defined where, and what to show with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sql import literal
from ..rules.model import Context, Lexis, Rule
from . import structure as S

def letters(pattern: str) -> str:
    """The pattern with ``\\w`` taking letters beyond ASCII, but none of the masking marks.

    Cheaper than the Unicode flag, which also makes blanks and digits slow to test.
    """
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\w":
            out.append(r"\w\u0080-\uDFFF" if inside else r"[\w\u0080-\uDFFF]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


ITEM = r"""\[\s*["']([^"']*)["']\s*\]$"""
PROPERTY = r"""^\s*(?:["']?[$\w]+["']?\s*:\s*)?([$\w]+)\s*(?:=.*)?$"""
BACKSLASHES = r"^\\+"
QUOTES = r"""^["']+|["']+$"""
SHELL_NAME = r"^\s*(?:function\s+)?([\w:.-]+)"


def _each(make: str) -> str:
    return f"flatten(transform(transform({{names}}, x -> trim(x)), x -> {make}))"


def _q(pattern: str) -> str:
    return literal(letters(pattern))


def _unless(chars: str, parts: str) -> str:
    """``parts`` of a text that holds one of the characters; any other is all there is to find."""
    return f"IF({' OR '.join(f'contains(x, {literal(c)})' for c in chars)}, {parts}, array(x))"


# How the text that a rule captures spreads into names.
EXPANSIONS: dict[str, str] = {
    "": "{names}",
    "list": _each(f"filter(transform(split(x, ','), p -> trim(p)), p -> p RLIKE {_q(r'^[$\w]+$')})"),
    "spaced": _each(f"split(x, {_q(r'\s+')})"),
    "params": _each(f"transform(split(x, ','), p -> regexp_extract(p, {_q(r'^\s*(?:\.\.\.)?([$\w]+)\s*(?:[?:=]|\z)')}, 1))"),
    "target": _each(
        _unless(",.([)]", f"concat(array(x), filter(transform(split(regexp_replace(x, {_q(r'^\(|\)$')}, ''), ','), p -> trim(p)), p -> p RLIKE {_q(r'^\w+$')}),"
        f" array(regexp_extract(x, {_q(r'^[^,]*\.(\w+)$')}, 1), regexp_extract(x, {_q(ITEM)}, 1)))")
    ),
    "member": _each(
        _unless(".>*", f"array(x, regexp_extract(x, {_q(r'(?:\.|->)(#?[$\w]+)$')}, 1),"
        f" regexp_extract(x, {_q(r'^(.*)\.prototype(?:\.[$\w]+)?$')}, 1), regexp_extract(x, {_q(r'^\*+\s*(\w+)$')}, 1))")
    ),
    "object_pattern": _each(f"transform(split(x, ','), p -> regexp_extract(p, {_q(PROPERTY)}, 1))"),
}

# Clean-up of captured names.
TRANSFORMS: dict[str, str] = {
    "tex_command": f"regexp_replace({{name}}, {literal(BACKSLASHES)}, '')",
    "yaml_quotes": f"regexp_replace({{name}}, {literal(QUOTES)}, '')",
    "shell_function": f"regexp_extract({{name}}, {literal(SHELL_NAME)}, 1)",
}

HELPERS = ("fragment", "call", "import", "dotted")  # rows that are no definitions themselves

BARE = r"\[[^\[\]]*\]|\{[^{}]*\}|(?<==\s?)[\w.]+\([^()]*\)"
# Whether ``BARE`` can match: a row that lacks one of these pairs is what it is without nested brackets.
MAY_BARE = " OR ".join(f"(contains(masked, '{a}') AND contains(masked, '{b}'))" for a, b in ("[]", "{}", "=)"))
UNPAIRED = r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}"


def _without(text: str, pattern: str, times: int) -> str:
    for _ in range(times):
        text = f"regexp_replace({text}, {literal(pattern)}, '')"
    return text


def rule_test(rule: Rule) -> str:
    """SQL for whether a rule applies to a row. Plain expressions only, so it is compiled code."""
    tests = []
    if rule.parent and not re.match(rule.parent, ""):
        tests.append("base > 0")
    if rule.start:
        tests.append("is_start")
    if rule.transform == "underlined":
        tests.append("underlined")
    if rule.transform == "first_row":
        tests.append("line_no = first_line")
    if rule.needs:
        tests.append("(" + " OR ".join(f"contains(masked, {literal(word)})" for word in rule.needs.split(" ")) + ")")
    if rule.gate:
        tests.append(f"masked RLIKE {_q(rule.gate)}")
    found = f"masked RLIKE {_q(rule.regex)}"
    tests.append(f"IF({MAY_BARE}, true, {found})" if rule.bare else found)
    return " AND ".join(tests) or "true"


WORD = re.compile(r"(?:(?:\\w|\[(?:\\w|A-Z|a-z|0-9|[A-Za-z0-9_$.:#-])+\])[+*]*)+")


UNREAD = re.compile(r"\\Q|\(\?[a-z]|^\^[?*+{]")  # quoting, flags, an anchor that may be missing


def _parts(pattern: str) -> tuple[list[str], bool]:
    """The texts of the capture groups of a pattern, and whether all of it stands behind ``^``, so that there is one match at most.

    A pattern that is not read as it stands has no groups and may match often.
    """
    if UNREAD.search(pattern):
        return [], False
    opened, groups, texts, alternatives, inside, at = [], [], {}, False, False, 0
    while at < len(pattern):
        one = pattern[at]
        if one == "\\":
            at += 1
        elif inside:
            if one == "[" or pattern.startswith("&&", at):
                return [], False
            inside = one != "]"
        elif one == "[":
            if re.match(r"\^?\]", pattern[at + 1 :]):
                return [], False
            inside = True
        elif one == "(":
            captures = not re.match(r"\?(?!<[A-Za-z])", pattern[at + 1 :])
            opened.append((at + 1, len(groups) if captures else None))
            groups += [None] if captures else []
        elif one == ")":
            start, group = opened.pop()
            if group is not None:
                texts[group] = pattern[start:at]
        elif one == "|" and not opened:
            alternatives = True
        at += 1
    return [texts[k] for k in range(len(groups))], pattern.startswith("^") and not alternatives


def rule_names(rule: Rule) -> str:
    """SQL for the names that a rule finds on a row that passes its test."""
    subject = _without("masked", BARE, 2) if rule.bare else "masked"
    names = EXPANSIONS[rule.expand].replace("{names}", f"regexp_extract_all({subject}, {_q(rule.regex)}, {rule.group})")
    name = TRANSFORMS.get(rule.transform, "{name}").replace("{name}", "x")
    # the covers are beyond ASCII
    names = f"transform({names}, x -> IF(length(x) = octet_length(x), trim({name}), translate(trim({name}), {literal(T.COVER)}, {literal(T.HIDDEN)})))"
    return f"array_distinct(filter({names}, x -> x <> ''))"


def quick_names(rule: Rule) -> str | None:
    """The same without functions over arrays that have a body of their own, which are never compiled; None where it takes one.

    Names that are words need no clean-up, and a pattern that matches once needs no list.
    """
    if rule.expand or rule.bare:
        return None
    groups, is_one = _parts(rule.regex)
    # \w takes no blank and none of the covers, see ``letters``
    if rule.transform not in TRANSFORMS and 0 < rule.group <= len(groups) and WORD.fullmatch(groups[rule.group - 1]):
        return f"array_distinct(array_remove(regexp_extract_all(masked, {_q(rule.regex)}, {rule.group}), ''))"
    if is_one:
        name = TRANSFORMS.get(rule.transform, "{name}").replace("{name}", f"regexp_extract(masked, {_q(rule.regex)}, {rule.group})")
        return f"array_remove(array(translate(trim({name}), {literal(T.COVER)}, {literal(T.HIDDEN)})), '')"
    return None


def rule_found(rule: Rule, index: int) -> str:
    """SQL for what a rule finds on a row that passes its test, an array of one or none; names of compiled code can be none, seldom."""
    quick = quick_names(rule)
    one = f"array(named_struct('rule', {index}, 'names', {quick or rule_names(rule)}))"
    return one if quick else f"filter({one}, d -> size(d.names) > 0)"


TESTS = 16  # rules tested per mask column, all languages together


def masks_of(rules: list[Rule]) -> tuple[list[str], int, dict[tuple[int, ...], str]]:
    """SQL for bit masks of the rules that a row passes, the rules in each, and a test of the language for each list of rules."""
    by_language: dict[str, list[int]] = {}
    for index, rule in enumerate(rules):
        for language in rule.languages:
            by_language.setdefault(language, []).append(index)
    grouped: dict[tuple[int, ...], list[str]] = {}
    for language, indexes in by_language.items():
        grouped.setdefault(tuple(indexes), []).append(language)
    bits = max(1, TESTS // max(1, len(grouped)))
    width = max([1, *[-(-len(indexes) // bits) for indexes in grouped]])
    among = {k: f"language IN ({', '.join(literal(x) for x in v)})" for k, v in grouped.items()}
    masks = []
    for part in range(width):
        cases = []
        for indexes in grouped:
            tests = [f"IF({rule_test(rules[i])}, {1 << at}, 0)" for at, i in enumerate(indexes[part * bits : (part + 1) * bits])]
            if tests:
                cases.append(f"WHEN NOT is_code THEN 0 WHEN {among[indexes]} THEN {' + '.join(tests)}")
        masks.append(f"CASE {' '.join(cases)} ELSE 0 END" if cases else "0")
    return masks, bits, among


def with_definitions(rows: DataFrame, rules: list[Rule], keep: Callable[[Column], Column] | None) -> DataFrame:
    """Add ``found``, all definitions of a row as ``array<struct<rule, names>>``, by language.

    The tests of all rules make bit masks first, in compiled code; only rows with a bit set go
    on to the array functions that cut out the names, for the rules of these bits alone: functions over an array of all rules would
    be interpreted for each rule. A mask is named twice in one projection, so Spark makes a method of
    its own for it, which with so few tests is short enough for the JVM to compile.
    """
    masks, bits, among = masks_of(rules)
    shape = "array<struct<rule:int,names:array<string>>>"
    cases = []
    for indexes in among:
        found = ", ".join(
            f"IF(_hit{at // bits} & {1 << at % bits} <> 0, {rule_found(rules[i], i)}, CAST(array() AS {shape}))"
            for at, i in enumerate(indexes)
        )
        cases.append(f"WHEN {among[indexes]} THEN concat({found})")
    found = F.expr(f"CASE WHEN _hits = 0 THEN CAST(array() AS {shape}) {' '.join(cases)} ELSE CAST(array() AS {shape}) END")
    if keep is not None:
        helpers = [i for i, rule in enumerate(rules) if rule.kind in HELPERS]
        found = F.filter(found, lambda d: d["rule"].isin(*helpers) | keep(d["names"]) if helpers else keep(d["names"]))
    named = [f"{mask} AS _hit{p}" for p, mask in enumerate(masks)]
    either = " | ".join(f"({mask})" for mask in (masks if len(masks) > 1 else masks * 2))
    tested = rows.selectExpr("*", *named, f"{either} AS _hits").withColumn("found", found).withColumn("has_defs", F.size("found") > 0)
    return tested.drop("_hits", *[f"_hit{p}" for p in range(len(masks))])


def _pick(rules: list[Rule], value: Callable[[Rule], str]) -> Column:
    return F.expr(f"element_at(array({', '.join(literal(value(r)) for r in rules)}), rule + 1)")


def definitions(
    units: DataFrame,
    rules: list[Rule],
    contexts: list[Context],
    lexis: dict[tuple[str, ...], Lexis],
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Definitions of all units, with the rows that belong to each.

    ``keep`` tests the names array of a definition. Rows that define nothing kept ask for no
    surroundings, so a look-up of few names does little more than read the rows.
    """
    rows = S.read_rows(S.masked_rows(units, lexis), lexis, contexts)
    rows = S.state_rows(rows, lexis)
    rows = with_definitions(rows, rules, keep)
    rest = _without("masked", UNPAIRED, 3)
    rest = f"IF(contains(masked, ')') OR contains(masked, ']') OR contains(masked, '}}'), {rest}, masked)"
    opener = f"concat(coalesce(nullif(regexp_extract({rest}, {literal(r'[(\[{]')}, 0), ''), '+'), masked)"
    rows = S.placed_rows(rows.withColumn("opener", F.expr(f"IF(depth_after > base, {opener}, NULL)")))
    own = ["language", "line_no", "found", "base", "attach_start", "marker_start"]
    placed = S.nest(rows, "line_no", S.nesting_events(), own)
    return _ranges(placed, rules)


def _ranges(placed: DataFrame, rules: list[Rule]) -> DataFrame:
    line = F.col("line_no")
    one = placed.select(
        "file_id", "unit", "language", "line_no", "base", "attach_start", "marker_start", "bracket_end", "block_end", "own_head", "around",
        F.explode("found").alias("_d"),
    ).select("*", "_d.rule", "_d.names").where(F.size("names") > 0)
    is_own_level = F.col("base") + S.BRACKETS
    parent = F.get(F.filter("around", lambda b: b["level"] == is_own_level - 1), F.lit(0))["opener"]
    one = one.withColumn("_parent", F.coalesce(parent, F.lit("")))
    parented = [(i, r.parent) for i, r in enumerate(rules) if r.parent]
    if parented:
        case = None
        for i, pattern in parented:
            value = F.col("_parent").rlike(letters(pattern))
            case = F.when(F.col("rule") == i, value) if case is None else case.when(F.col("rule") == i, value)
        one = one.where(case.otherwise(F.lit(True)))
    policies = {r.policy for r in rules}

    def innermost(test: Callable[[Column], Column]) -> Column:
        return F.array_max(F.transform(F.filter("around", test), lambda b: F.struct(b["start_line"].alias("s"), b["end_line"].alias("e"))))

    # only what some rule's policy goes by is looked for among what lies around
    looked = {
        "CLOSES": ("_closed", lambda: F.get(F.filter("around", lambda b: (b["level"] == is_own_level) & (b["end_line"] == line + 1)), F.lit(0))),
        "INSIDE": ("_inside", lambda: innermost(lambda b: b["show"].isNotNull() & (b["level"] != is_own_level))),
        "SECTION": ("_section", lambda: innermost(lambda b: b["level"] >= S.HEADINGS)),
    }
    one = one.withColumns(
        {
            "rule_id": _pick(rules, lambda r: r.rule_id),
            "kind": _pick(rules, lambda r: r.kind),
            "policy": _pick(rules, lambda r: r.policy),
            **{name: find() for kind, (name, find) in looked.items() if kind in policies},
        }
    )
    policy = F.col("policy")
    own_end = F.coalesce("bracket_end", "block_end")  # what a row opens is around what stands on it
    starts = {
        "CLOSES": lambda: F.col("_closed.start_line"),
        "INSIDE": lambda: F.when(own_end.isNotNull(), line).otherwise(F.col("_inside.s")),
        "SECTION": lambda: F.coalesce("_section.s", F.when(F.col("block_end").isNotNull(), line)),
    }
    ends = {
        "CLOSES": lambda: F.col("_closed.end_line"),
        "INSIDE": lambda: F.coalesce(own_end, "_inside.e"),
        "SECTION": lambda: F.coalesce("_section.e", "block_end"),
        "BLOCK": lambda: F.coalesce("block_end", "bracket_end", line + 1),
        "LOGICAL": lambda: F.coalesce("bracket_end", line + 1),
    }

    def by_policy(values: dict[str, Callable[[], Column]], default: Column) -> Column:
        value = F
        for kind, make in values.items():
            if kind in policies:
                value = value.when(policy == kind, make())
        return default if value is F else value.otherwise(default)

    one = one.withColumns({"start_line": by_policy(starts, line), "end_line": by_policy(ends, line + 1)}).where(F.col("start_line").isNotNull())

    def shown(b: Column) -> Column:
        return F.struct(
            b["start_line"].alias("start_line"), F.when(b["show"] == "WHOLE", b["end_line"]).otherwise(b["head_end"]).alias("end_line")
        )

    above = F.when(policy == "LINE", F.col("marker_start")).otherwise(F.col("attach_start"))
    above = F.when(policy.isin("LINE", "LOGICAL", "BLOCK"), above)
    attached = F.when(above.isNotNull(), F.array(F.struct(above.alias("start_line"), line.alias("end_line")))).otherwise(F.array())
    headers = F.transform(
        F.filter("around", lambda b: b["show"].isNotNull() & (b["level"] != is_own_level) & (b["start_line"] < line)), shown
    )
    own = F.array(F.struct("start_line", "end_line"))
    signature = F.when(
        (policy == "LINE") & (F.col("own_head") > line + 1),
        F.array(F.struct(line.alias("start_line"), F.col("own_head").alias("end_line"))),
    ).otherwise(F.array())
    return one.select(
        "file_id", "unit", "language", "line_no", "rule_id", "kind", "names", "start_line", "end_line",
        F.concat(own, attached, signature, headers).alias("ranges"),
        above.alias("attach_start"),
        headers.alias("headers"),
        F.transform("around", lambda b: b["start_line"]).alias("hosts"),
        F.col("_parent").alias("opener"),
    )
