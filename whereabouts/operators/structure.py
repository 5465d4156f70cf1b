"""From rows of text to statements and blocks, by windows.

Every step is partitioned by ``(file_id, unit)`` or by more columns than that, so all of it
runs behind the one shuffle of the files on ``file_id``. A unit is one file, or one fragment
of it; its rows come from one content cell, which bounds the window partition.

Blocks are not found by joining each row to each block. A row sends events to the nesting
levels that it opens, closes or lies in, and inside one level the next close and the last
open are single window look-ups. The cost is rows times nesting depth, also in a huge file.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sql import literal
from ..rules.model import Context, Lexis

KEYS = ["file_id", "unit"]
# Levels: indents below the first number, brackets from there on, headings of rank 1..6 above the second. A content cell
# has less than 2**31 characters, of which a tab counts for eight columns, so no kind reaches the next one's numbers.
BRACKETS = 1 << 40
HEADINGS = 1 << 41
RANKS = 6
LAST_END = r"\\end\s*\{document\}"


def per_language(lexis: dict[tuple[str, ...], Lexis], make: Callable[[Lexis], str | None], default: str) -> str:
    """SQL for a CASE over the language column, from the settings of each language group."""
    cases = []
    for languages, settings in lexis.items():
        value = make(settings)
        if value is not None:
            cases.append(f"WHEN language IN ({', '.join(literal(x) for x in languages)}) THEN {value}")
    return f"CASE {' '.join(cases)} ELSE {default} END" if cases else default


def masked_rows(units: DataFrame, lexis: dict[tuple[str, ...], Lexis]) -> DataFrame:
    """One row per line of each unit: its number in the file, and its masked text."""
    masked = F.expr(per_language(lexis, lambda x: T.mask_sql("content", x.token, x.comment, x.shows_first), "content"))
    both = F.arrays_zip(T.split_lines(F.col("content")).alias("text"), T.split_lines(F.col("_masked")).alias("masked"))
    carried = [F.col(c) for c in units.columns if c not in ("content", "start_line")]
    rows = units.where(F.length("content") > 0).withColumn("_masked", masked).select(*carried, "start_line", F.posexplode(both).alias("_pos", "_row"))
    text = F.col("_row.text")
    return rows.select(
        *carried,
        (F.col("start_line") + F.col("_pos")).cast("int").alias("line_no"),
        F.col("_row.masked").alias("masked"),
        F.when(~_is_blank(text), _indent(text)).alias("text_indent"),
    )


def _is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\r\f\x0b")) == ""


def _indent(text: Column) -> Column:
    """Columns before the first character; a tab counts as eight."""
    size = F.octet_length(text) - F.octet_length(F.ltrim(text, F.lit(" \t")))
    return F.when(F.contains(text, F.lit("\t")), size + 7 * T.count_chars(F.left(text, size), "\t")).otherwise(size)


PLAIN_OPENERS = r"[(\[{]"
PLAIN_CLOSERS = r"[)\]}]"
LITERALS = r"""(["'])[^"']*\1"""


def _bits(*flags: str) -> Column:
    """Flags of a row in one number: what is carried through a window so takes a word, not a struct."""
    return sum((F.col(flag).cast("int") * (1 << at) for at, flag in enumerate(flags[1:], 1)), F.col(flags[0]).cast("int"))


def _bit(bits: str, at: int) -> Column:
    return F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(F.lit(1 << at)) > 0


def _any(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def _count(chars: str) -> str:
    """SQL for how many of the characters a row holds, by byte searches: most rows hold none, and few of those that do more than one kind."""
    left = "octet_length(masked) - octet_length(replace(masked, {0}, ''))"
    counts = [(left if len(c.encode()) == 1 else f"CAST(({left}) / {len(c.encode())} AS INT)").format(literal(c)) for c in chars]
    return " + ".join(f"IF(contains(masked, {literal(c)}), {count}, 0)" for c, count in zip(chars, counts))


def _matches(pattern: str) -> str:
    return f"masked RLIKE {literal(pattern)}"


BEFORE_END = r"\s*$"
CLASS = r"\[[^\[\]\\^&-]+\]"
ENDS = re.compile(r"(?:\(\?<[=!][^()]*\))?(?:\\b)?((?:\\\W|[^\W_]|[=&<>~,;:{}])+)(\??)")


def last_chars(pattern: str) -> str | None:
    """With which characters all that ``pattern`` matches can end, blanks at the row's end aside; None where that is not seen.

    Read are a class, or texts as alternatives, before blanks and the end.
    """
    if not pattern.endswith(BEFORE_END):
        return None
    body = pattern[: -len(BEFORE_END)]
    if re.fullmatch(CLASS, body):
        return body[1:-1]
    if re.fullmatch(r"\(\?:.*\)", body):
        body = body[3:-1]
    chars = set()
    for one in re.split(r"(?<!\\)\|", body):
        simple = re.fullmatch(CLASS, one)
        read = None if simple else ENDS.fullmatch(one)
        if simple:
            chars.update(one[1:-1])
        elif read:
            units = re.findall(r"\\.|.", read[1])
            if read[2] and len(units) == 1:
                return None
            chars.update(x[-1] for x in units[-2 if read[2] else -1 :])
        else:
            return None
    return "".join(sorted(chars))


def _matches_end(pattern: str) -> str:
    """``_matches`` for a pattern at the row's end: a row whose last character says no is spared the search from every character on.

    That holds where the last character is a visible one of ASCII, so that there are neither blanks nor row ends after what is matched.
    """
    chars = last_chars(pattern)
    if chars is None:
        return _matches(pattern)
    may = f"last_char IN ({', '.join(literal(c) for c in chars)})"
    sure = pattern.startswith("[")  # a class, of one character
    return f"IF(last_char BETWEEN '!' AND '~', {may if sure else f'{may} AND {_matches(pattern)}'}, {_matches(pattern)})"


def read_rows(rows: DataFrame, lexis: dict[tuple[str, ...], Lexis], contexts: list[Context]) -> DataFrame:
    """What one row says by itself."""

    def counted(kind: str, plain: str, cover: str) -> Callable[[Lexis], str | None]:
        def make(x: Lexis) -> str | None:
            pattern = getattr(x, kind)
            # words open and close blocks here; those in literals, which keep their letters, do not
            text = f"regexp_replace(masked, {literal(LITERALS)}, '')" if '"' in x.token else "masked"
            return None if pattern == plain else f"regexp_count({text}, {literal(pattern)}) + {_count(cover)}"

        return make

    def leading(x: Lexis) -> str:
        one = f"{x.closers}|{T.TEXT_CLOSE}"
        return f"regexp_count(regexp_extract(masked, {literal(rf'^(?:\s*+(?:{one}))++')}, 0), {literal(one)})"

    def rank(x: Lexis) -> str | None:
        cases = [f"WHEN {_matches(pattern)} THEN {k}" for k, pattern in enumerate(x.level, 1)]
        return f"CASE {' '.join(cases)} END" if cases else None

    def flag(kind: str, put: str = "{}") -> str:
        return per_language(lexis, lambda x: _matches_end(put.format(getattr(x, kind))) if getattr(x, kind) else None, "false")

    shown = [
        f"WHEN language IN ({', '.join(literal(x) for x in c.languages)})" + (f" AND {_matches(c.regex)}" if c.regex else "") + f" THEN '{c.show}'"
        for c in contexts
    ]
    kept = ["file_id", "unit", "language", "line_no", "masked", "is_code"]
    read = rows.withColumns({"is_code": ~_is_blank(F.col("masked")), "last_char": F.right("masked", F.lit(1))})
    opens = f"IF(is_code, {per_language(lexis, counted('openers', PLAIN_OPENERS, T.TEXT_OPEN), _count('([{' + T.TEXT_OPEN))}, 0)"
    closes = f"IF(is_code, {per_language(lexis, counted('closers', PLAIN_CLOSERS, T.TEXT_CLOSE), _count(')]}' + T.TEXT_CLOSE))}, 0)"
    lead_close = f"IF({closes} > 0, {per_language(lexis, leading, '0')}, 0)"
    is_soft = f"is_code AND NOT ({_matches_end(r'[;{},:]\s*$')})"
    goes_on = f"is_code AND ({flag('continues')})"
    is_head = f"is_code AND ({flag('head')})"
    mode = per_language(lexis, lambda x: literal(x.blocks), literal("bracket"))
    # Only a row that can open a block is asked what it shows: one more bracket than it closes, a head or a row in heading mode.
    # What that goes by is written twice in one projection, so Spark makes methods of it, short enough for the JVM to compile.
    opens_some = f"is_code AND ({opens} - {closes} + {lead_close} + IF(({goes_on}) OR ({is_soft}), 1, 0) > 0 OR ({is_head}) OR {mode} = 'heading')"
    return read.selectExpr(
        *kept,
        "text_indent IS NOT NULL AND NOT is_code AS is_note",
        f"{mode} AS mode",
        f"{per_language(lexis, lambda x: 'true' if x.attaches else None, 'false')} AS attaches",
        f"IF(is_code AND language = 'YAML', length(regexp_extract(masked, {literal(r'^\s*+(?:-\s++)*+')}, 0)), coalesce(text_indent, 0)) AS indent",
        f"{opens} AS opens",
        f"{closes} AS closes",
        f"{is_soft} AS is_soft",
        f"language = 'Markdown' AND {_matches(r'^ {0,3}(?:=+|-+)[ \t]*$')} AS underlines",
        f"language = 'Markdown' AND {_matches(r'^---\s*$')} AS is_matter",
        f"is_code AND ({flag('attach')}) AS is_marker",
        f"{goes_on} AS goes_on",
        f"is_code AND ({flag('continued', r'^\s*{}')}) AS picks_up",
        f"{is_head} AS is_head",
        f"{per_language(lexis, rank, 'CAST(NULL AS INT)')} AS rank",
        f"{f'CASE WHEN NOT ({opens_some}) THEN NULL ' + ' '.join(shown) + ' END' if shown else 'CAST(NULL AS STRING)'} AS show",
        f"{lead_close} AS lead_close",
    )


def state_rows(rows: DataFrame, lexis: dict[tuple[str, ...], Lexis] | None = None) -> DataFrame:
    """Bracket depth, statements, and the run of comments and decorators above each row.

    All windows have one partitioning and one order, so they run after one sort; what does not
    depend on an earlier window shares its pass. ``lexis`` tells what the languages at hand can have: without blocks by indent
    a statement's start asks for no depth and there are no indents to look up, without rows that are attached by a pattern runs are of
    comments alone, so there are fewer passes.
    """
    over = Window.partitionBy(*KEYS).orderBy("line_no")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spec = "OVER (PARTITION BY file_id, unit ORDER BY line_no)"
    indented = lexis is None or any(x.blocks == "indent" for x in lexis.values())
    marked = lexis is None or any(x.attach for x in lexis.values())
    line, code, start, indents = F.col("line_no"), F.col("is_code"), F.col("is_start"), F.col("mode") == "indent"
    filled = code | F.col("is_note")

    def last(value: Column, frame) -> Column:
        return F.last(value, ignorenulls=True).over(frame)

    def first_of_run(joins: Column) -> Column:
        return F.when(F.col("is_attach") & ~joins, line)

    # a row that goes on in the next one counts as an open bracket
    early = not marked and not indented
    if not marked:
        rows = rows.withColumn("is_attach", F.col("attaches") & F.col("is_note"))
    rows = rows.withColumns(
        {
            "_next": F.expr(f"lead(IF(is_code, picks_up, NULL)) IGNORE NULLS {spec}"),
            "_before": last(F.when(code, _bits("goes_on", "is_soft")), before),
            "_open": F.coalesce(F.sum(F.col("opens") - F.col("closes")).over(before), F.lit(0)).cast("int"),
            "underlined": F.coalesce(F.lead("underlines").over(over), F.lit(False)),
            "prev_code": last(F.when(code, line), before),
            "prev_marker": last(F.when(F.col("is_marker"), line), before),
            "last_code": F.max(F.when(code, line)).over(whole),
            "last_line": F.max("line_no").over(whole),
            "first_line": F.min("line_no").over(whole),
            "_matter": F.min(F.when(F.col("is_matter"), line)).over(whole),
            **({"_prev_attach": F.coalesce(last(F.when(filled, F.col("is_attach")), before), F.lit(False))} if early else {}),
        }
    )
    went_on, was_soft, picked_up = _bit("_before", 0), _bit("_before", 1), F.when(code, F.col("picks_up")).otherwise(_any("_next"))
    rows = rows.withColumns(
        {
            "_virtual": (code & (F.col("goes_on") | (_any("_next") & F.col("is_soft")))).cast("int"),
            # whether the code row before goes on in the next one: that is this row, or the next code row
            "_entered": (went_on | (picked_up & was_soft)).cast("int"),
        }
    )
    # what a row opens so, the next code row closes; so of all rows before only the last code row counts
    begins = code & (F.col("_entered") == 0)
    carried = F.when(code, F.col("_entered")).otherwise(0)
    rows = rows.withColumns({"depth_before": F.col("_open") + F.col("_entered"), "_delta": F.col("opens") - F.col("closes") + F.col("_virtual") - carried})
    rows = rows.withColumns(
        {
            "depth_after": (F.col("depth_before") + F.col("_delta")).cast("int"),
            "base": (F.col("depth_before") - F.col("lead_close")).cast("int"),
            "dip_to": (F.col("depth_before") + F.col("_delta") - F.col("_virtual")).cast("int"),  # depth before the next row picks up
            "is_start": F.when(indents, code & (F.col("depth_before") <= 0)).otherwise(begins) if indented else begins,
            "after_matter": (F.col("_matter") == F.col("first_line")) & (F.col("prev_code") == F.col("first_line")),
        }
    )
    # rows inside a statement's brackets lie where the statement does
    rows = rows.withColumn("_inside", ~start & (F.col("depth_before") > 0))
    opens_shown = F.col("show").isNotNull() & (F.col("depth_after") > F.col("base"))
    none, number, flag = F.array().cast("array<int>"), F.lit(None).cast("int"), F.lit(None).cast("boolean")
    if early:
        rows = rows.withColumn("_run_first", first_of_run(F.col("_prev_attach")))
    rows = rows.withColumns(
        {
            "stmt_indent": last(F.when(start, F.col("indent")), upto) if indented else number,
            "prev_indent": last(F.when(start, F.col("indent")), before) if indented else number,
            "_marked": last(F.when(start, F.col("is_marker")), upto) if marked else flag,
            "_prev_marked": last(F.when(start, F.col("is_marker")), before) if marked else flag,
            **({"_above": last(F.col("_run_first"), before)} if early else {"_filled": last(F.when(filled, _bits("_inside", "is_note", "is_code", "attaches")), before)}),
            "_filled_at": last(F.when(filled, F.col("indent")), before) if indented else number,
            "logical_end": F.coalesce(F.expr(f"lead(IF(is_start, prev_code, NULL)) IGNORE NULLS {spec}"), F.col("last_code")) + 1,
            "levels": F.collect_set(F.when(indents & F.col("is_head") & start, F.col("indent"))).over(whole) if indented else none,
            "shown_levels": F.collect_set(F.when(opens_shown, F.col("base") + BRACKETS)).over(whole),
        }
    )
    if early:
        joins = F.col("_prev_attach")
    else:
        # the last statement that starts before a row is the one that the filled row before it starts or lies in
        joins = _bit("_filled", 3) & (_bit("_filled", 1) | (_bit("_filled", 2) & _any("_prev_marked")))
        if indented:
            at = F.when(F.col("_inside"), F.col("stmt_indent")).otherwise(F.col("indent"))
            joins = joins & (~indents | (at == F.when(_bit("_filled", 0), F.col("prev_indent")).otherwise(F.col("_filled_at"))))
        if marked:
            rows = rows.withColumn("is_attach", F.col("attaches") & (F.col("is_note") | (code & _any("_marked"))))
        rows = rows.withColumn("_joins", joins)
        joins = F.col("_joins")
        rows = rows.withColumn("_run_first", first_of_run(joins))
        rows = rows.withColumns({"_run_start": last(F.col("_run_first"), upto), "_above": last(F.col("_run_first"), before)})
    rows = rows.withColumn("attach_start", F.when(joins, F.col("_above")))
    if marked:
        opening = F.col("is_marker") & start & (F.col("prev_marker").isNull() | (F.col("prev_marker") < F.col("_run_start")))
        rows = rows.withColumn("_marker_start", last(F.when(opening, line), before))
        rows = rows.withColumn("marker_start", F.greatest("attach_start", F.when(F.col("attach_start").isNotNull(), F.col("_marker_start"))))
    else:
        rows = rows.withColumn("marker_start", F.col("attach_start"))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


CLOSE, PROBE, OPEN, OWN = 0, 1, 2, 3  # order of events of one row inside one level


def event(test: str, levels: str, order: int, close_end: str = "NULL", dip_end: str = "NULL", low: str = "NULL", high: str = "NULL") -> str:
    """SQL for what a row that passes the test sends to each of the levels, of those from ``low`` to ``high`` where these are given."""
    return (
        f"IF({test}, named_struct('levels', CAST({levels} AS array<bigint>), 'low', CAST({low} AS BIGINT), 'high', CAST({high} AS BIGINT), 'ord', {order},"
        f" 'close_end', CAST({close_end} AS INT), 'dip_end', CAST({dip_end} AS INT)), NULL)"
    )


def _span(low: str, high: str) -> str:
    return f"IF(({high}) >= ({low}), sequence({low}, {high}), NULL)"


def nesting_events() -> str:
    """SQL for the events that a row sends; ``has_defs`` rows also ask what lies around them.

    Sets of levels are narrowed after they are spread: no function over an array, which is never compiled, has a part in it.
    """
    low = f"greatest(depth_after, 0) + {BRACKETS}"
    dips = f"greatest(base, 0) + {BRACKETS}"
    closed_headings = "IF(language = 'Markdown', line_no, prev_code + 1)"
    parts = [
        # indents: a statement closes all blocks that are as deep or deeper
        event("is_indent AND prev_indent IS NOT NULL", "levels", CLOSE, "prev_code + 1", low="indent", high="prev_indent"),
        event("is_indent AND is_head", "array(indent)", OPEN),
        # brackets
        event("is_code AND depth_after < depth_before", _span(low, f"depth_before + {BRACKETS - 1}"), CLOSE, "line_no + 1", "line_no + 1"),
        event("is_code AND lead_close > 0", _span(dips, f"least(depth_after, depth_before) + {BRACKETS - 1}"), CLOSE, "NULL", "line_no + 1"),
        event("is_code AND dip_to < depth_before", _span(f"greatest(dip_to, 0) + {BRACKETS}", f"least(depth_after, depth_before) + {BRACKETS - 1}"), CLOSE, "NULL", "line_no + 1"),
        event("opens_bracket", f"array(base + {BRACKETS})", OPEN),
        # headings: one closes all of its rank and below, and the rows before the first one
        event("is_heading OR ends_headings", f"array({HEADINGS})", CLOSE, closed_headings),
        event("is_heading OR ends_headings", f"sequence({HEADINGS} + coalesce(rank, 1), {HEADINGS + RANKS})", CLOSE, closed_headings),
        event("is_heading OR is_first_text", f"array({HEADINGS} + IF(is_heading, rank, 0))", OPEN),
        # what lies around: indents, brackets of shown constructs, the bracket right outside and the one closed, headings
        event("has_defs AND stmt_indent IS NOT NULL", "levels", PROBE, high="stmt_indent - 1"),
        event("has_defs", "shown_levels", PROBE, low=f"{BRACKETS}", high=f"base + {BRACKETS - 2}"),
        event("has_defs AND base > 0", f"array(base + {BRACKETS - 1})", PROBE),
        event("has_defs AND lead_close > 0 AND base >= 0", f"array(base + {BRACKETS})", PROBE),
        event("has_defs AND mode = 'heading'", f"sequence({HEADINGS}, {HEADINGS} + coalesce(rank - 1, {RANKS}))", PROBE),
        event("has_defs", "array(-1)", OWN),
    ]
    asks = (
        "has_defs OR (is_code AND (depth_after <> depth_before OR base <> depth_before OR dip_to < depth_before OR mode = 'heading' OR"
        " (is_indent AND (is_head OR indent < prev_indent OR array_contains(levels, indent)))))"
    )
    return f"IF({asks}, array({', '.join(parts)}), NULL)"


def placed_rows(rows: DataFrame) -> DataFrame:
    """Code rows with what their events go by, and what ``nest`` has to know of block openers."""
    rows = rows.withColumns(
        {
            "is_indent": F.expr("mode = 'indent' AND is_start"),
            "is_heading": F.expr("mode = 'heading' AND is_code AND rank IS NOT NULL"),
            "ends_headings": F.expr(f"mode = 'heading' AND language = 'TeX' AND masked RLIKE {literal(LAST_END)}"),
            "is_first_text": F.expr(
                "mode = 'heading' AND is_code AND rank IS NULL AND NOT is_matter AND (prev_code IS NULL OR after_matter)"
            ),
            "opens_bracket": F.expr("is_code AND depth_after > base AND base >= 0"),
            "goes_on_from": F.expr(f"is_code AND depth_after > base AND lead_close > 0 AND masked RLIKE {literal(r'^\s*\)')}"),
        }
    )
    return rows.withColumns(
        {
            "eof_end": F.expr("IF(language = 'Markdown', last_line, last_code) + 1"),
            "head_end": F.expr(
                """CASE WHEN is_heading OR show = 'ROW' THEN line_no + 1
                WHEN mode = 'indent' THEN logical_end
                WHEN NOT left(opener, 1) IN ('(', '[') THEN line_no + 1 END"""
            ),
            "shown": F.expr("CASE WHEN is_heading THEN 'ROW' WHEN mode <> 'indent' OR is_start THEN show END"),
        }
    )


def nest(rows: DataFrame, place: str, events: str, own: list[str]) -> DataFrame:
    """Answer the events: per asking row its own block ends and the blocks around it.

    Block ends come from the next close, blocks around from the last open, each inside one
    level. A row that closes a parenthesis and opens a body goes on with the header that the parenthesis is part of, so the
    body's block starts where that one did. The ``own`` columns come back with the answer. ``events`` is an array of what ``event``
    gives, written inside the generator: a filter on a column of them would be pushed down, and compute them twice.
    """
    carried = ", ".join(f"'{c}', {c}" for c in own)
    resumes = "goes_on_from" if "goes_on_from" in rows.columns else "false AS goes_on_from"
    flat = rows.selectExpr(*KEYS, f"{place} AS place", "has_defs", *own, "eof_end", "head_end", "shown", "opener", resumes, f"inline({events})")
    flat = flat.selectExpr("*", "explode(levels) AS level").where("(low IS NULL OR level >= low) AND (high IS NULL OR level <= high)")
    flat = flat.selectExpr(
        *KEYS, "place", "has_defs", "level", "ord", "close_end", "dip_end", "eof_end", "head_end", "shown", "goes_on_from",
        f"IF(ord = {OPEN}, opener, NULL) AS opener", f"IF(ord = {OWN}, named_struct({carried}), NULL) AS own",
    )
    spec = "OVER (PARTITION BY file_id, unit, level ORDER BY place, ord)"
    ended = flat.selectExpr(
        "*",
        f"coalesce(lead(close_end) IGNORE NULLS {spec}, eof_end) AS end_line",
        f"coalesce(head_end, lead(dip_end) IGNORE NULLS {spec}, eof_end) AS shown_end",
        f"IF(ord = {OPEN} AND goes_on_from, last(IF(ord = {OPEN} AND NOT goes_on_from, named_struct('place', place, 'shown', shown), NULL))"
        f" IGNORE NULLS {spec[:-1]} ROWS UNBOUNDED PRECEDING), NULL) AS from_",
    )
    opened = (
        f"IF(ord = {OPEN}, named_struct('level', level, 'start_line', IF(from_.shown IS NULL, place, from_.place), 'end_line', end_line,"
        " 'head_end', CASE WHEN from_.shown IS NULL THEN shown_end WHEN from_.shown = 'ROW' THEN from_.place + 1 ELSE place + 1 END,"
        " 'show', coalesce(from_.shown, shown), 'opener', opener), NULL)"
    )
    around = ended.selectExpr("*", f"last({opened}) IGNORE NULLS {spec[:-1]} ROWS UNBOUNDED PRECEDING) AS around_it")
    bracket = f"ord = {OPEN} AND level BETWEEN {BRACKETS} AND {HEADINGS - 1}"
    # rows of one place are gathered behind one sort; an aggregation with lists would sort them twice, and write the lists out between
    at = Window.partitionBy(*KEYS, "place").orderBy(F.desc("ord"))
    all_of = at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = around.selectExpr(
        *KEYS, "place", "ord", "own",
        f"IF({bracket}, end_line, NULL) AS _bracket_end",
        f"IF(ord = {OPEN} AND NOT level BETWEEN {BRACKETS} AND {HEADINGS - 1}, end_line, NULL) AS _block_end",
        f"IF({bracket} AND shown = 'HEADER', shown_end, NULL) AS _own_head",
        f"IF(ord = {PROBE} AND around_it.end_line > place, around_it, NULL) AS _around",
        f"has_defs AND ord > {CLOSE} AS _asks",
    ).where("_asks")
    # a place that several rows share answers once
    gathered = asked.withColumns(
        {
            "_nth": F.row_number().over(at),
            "bracket_end": F.max("_bracket_end").over(all_of),
            "block_end": F.max("_block_end").over(all_of),
            "own_head": F.max("_own_head").over(all_of),
            "around": F.collect_list("_around").over(all_of),
        }
    )
    return gathered.where("_nth = 1").selectExpr(*KEYS, "place", "own.*", "bracket_end", "block_end", "own_head", "around")
