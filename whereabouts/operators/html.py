"""Pages: headings, ``id`` and ``name`` values, and the elements around them.

A page becomes one row per tag or text piece. Tags send the same level events as code rows, so
elements are paired and looked up by the same windows, also when a page is one single row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .structure import BRACKETS, CLOSE, KEYS, OPEN, OWN, PROBE, event, nest

PIECE = r"<!--(?s:.*?)-->|(?i:<(script|style)\b)[^>]*>(?s:.*?)(?i:</\1\s*>)|</?[A-Za-z][^>]*>|[^<]+|<"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
ENTITY = r"&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+)|[A-Za-z][A-Za-z0-9]*);?"  # ends a text, as a tag does
ATTRIBUTE = r"""(?<=\s)(?:id|name)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def pieces(units: DataFrame) -> DataFrame:
    """Tags and texts in order, with their rows, names and nesting depth."""
    carried = [c for c in units.columns if c not in ("content", "start_line")]
    flat = units.select(
        *carried, "start_line", F.posexplode(F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))).alias("pos", "piece")
    )
    piece = F.col("piece")
    over = Window.partitionBy(*KEYS).orderBy("pos")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumns(
        {
            "tag": F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][\w:-]*)", 1)),
            "_lf": T.count_chars(piece, "\n"),
        }
    )
    closed = piece.startswith("</")
    is_tag = F.col("tag") != ""
    whole = F.col("tag").isin("script", "style") & ~closed
    alone = F.col("tag").isin(*VOID) | piece.endswith("/>")
    flat = flat.withColumn(
        "kind",
        F.when(~is_tag, F.when(piece.startswith("<!"), "note").otherwise("text"))
        .when(whole, "whole").when(closed, "close").when(alone, "void").otherwise("open"),
    )
    # Tags of one name pair like brackets: a close takes the nearest open one before it. What stays without a
    # partner, an open tag that nothing closes or a close tag too many, is left out by itself.
    side = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    per_tag = Window.partitionBy(*KEYS, "tag").orderBy("pos")
    upto = per_tag.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*KEYS, "tag").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)  # in one pass, from the end
    flat = flat.withColumn("_run", F.sum(side).over(upto))
    flat = flat.withColumn("_floor", F.least(F.lit(0), F.min("_run").over(upto)))
    flat = flat.withColumns({"_open": F.col("_run") - F.col("_floor"), "_fell": F.col("_floor") < F.coalesce(F.lag("_floor").over(per_tag), F.lit(0))})
    flat = flat.withColumn(
        "paired",
        F.when(F.col("kind") == "open", F.coalesce(F.min("_open").over(after) < F.col("_open"), F.lit(False)))
        .when(F.col("kind") == "close", ~F.col("_fell")).otherwise(True),
    )
    step = F.when(~F.col("paired"), 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    flat = flat.withColumn("_step", step)
    return flat.withColumns(
        {
            "first_row": (F.col("start_line") + F.coalesce(F.sum("_lf").over(before), F.lit(0))).cast("int"),
            "depth": F.coalesce(F.sum("_step").over(before), F.lit(0)).cast("int"),
        }
    ).withColumn("last_row", (F.col("first_row") + F.col("_lf")).cast("int"))


def _head_rows(piece: Column) -> Column:
    return T.count_chars(F.regexp_extract(piece, r"^<[^>]*>", 0), "\n")


def page_definitions(units: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Definitions of HTML units, in the shape that ``definitions`` gives."""
    rows = pieces(units)
    piece, kind, depth = F.col("piece"), F.col("kind"), F.col("depth")
    texts = F.filter(F.transform(F.split(piece, ENTITY), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")
    head = F.regexp_extract(piece, r"^<[^>]*>", 0)
    values = F.flatten(F.array(*[F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(g)) for g in (1, 2, 3)]))
    names = F.when(kind == "text", texts).when(
        kind.isin("open", "void", "whole") & head.rlike(r"\b(?:id|name)\b"), F.array_distinct(F.filter(values, lambda x: x != ""))
    )
    names = F.coalesce(names, F.array().cast("array<string>"))
    rows = rows.withColumn("names", names)
    wanted = F.size("names") > 0
    if keep is not None:
        wanted = wanted & keep(F.col("names"))
    is_fragment = kind == "whole"
    rows = rows.withColumns(
        {
            "has_defs": wanted | is_fragment,
            "ordinal": F.sum(is_fragment.cast("int")).over(
                Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
            ),
        }
    )
    parts = [
        event("kind = 'close' AND paired AND depth > 0", f"array(depth + {BRACKETS - 1})", CLOSE, "pos + 1", "last_row + 1"),
        event("kind = 'open' AND paired", f"array(depth + {BRACKETS})", OPEN),
        event("has_defs AND depth > 0", f"sequence({BRACKETS}, depth + {BRACKETS - 1})", PROBE),
        event("has_defs", "array(-1)", OWN),
    ]
    events = f"array({', '.join(parts)})"
    rows = rows.selectExpr(
        *KEYS, "pos", "has_defs", "kind", "paired", "depth", "language", "names", "first_row", "last_row", "ordinal",
        "IF(kind = 'whole', piece, NULL) AS piece", "2147483647 AS eof_end", "CAST(NULL AS INT) AS head_end", "'HEADER' AS shown",
        "concat_ws('\t', CAST(first_row AS string), CAST(last_row + 1 AS string), tag) AS opener",
    )
    placed = nest(rows, "pos", events, ["language", "names", "kind", "first_row", "last_row", "piece", "ordinal"])
    return _as_definitions(placed)


def _as_definitions(placed: DataFrame) -> DataFrame:
    """``nest`` went by position; an opener brings the rows of its tag, the shown end its last row."""
    kind = F.col("kind")
    part = lambda b, i: F.split_part(b["opener"], F.lit("\t"), F.lit(i))
    placed = placed.withColumn(
        "around",
        F.array_sort(
            F.transform(
                "around",
                lambda b: F.struct(
                    b["level"].alias("level"), part(b, 1).cast("int").alias("start_line"), b["head_end"].alias("end_line"),
                    part(b, 2).cast("int").alias("head_end"), part(b, 3).alias("tag"),
                ),
            )
        ),
    ).withColumn("_parent", F.try_element_at("around", F.lit(-1)))
    heading = (kind == "text") & F.col("_parent.tag").rlike("^h[1-6]$")
    start = F.when(kind == "text", F.col("_parent.start_line")).otherwise(F.col("first_row"))
    end = F.when(kind == "text", F.col("_parent.end_line")).otherwise(F.coalesce("own_head", F.col("last_row") + 1))
    around = F.when(kind == "text", F.slice("around", F.lit(1), F.greatest(F.size("around") - 1, F.lit(0)))).otherwise(F.col("around"))
    own = F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))
    headers = F.transform(around, lambda b: F.struct(b["start_line"].alias("start_line"), b["head_end"].alias("end_line")))
    # a script or style shows its own opening tag around what is inside
    tag_rows = F.struct(
        F.col("first_row").alias("start_line"), (F.col("first_row") + _head_rows(F.col("piece")) + 1).cast("int").alias("end_line")
    )
    fragment = F.when(kind == "whole", F.array(F.struct(F.lit("html_fragment").alias("rule_id"), F.lit("fragment").alias("kind"), F.array(F.col("ordinal").cast("string")).alias("names"), tag_rows.alias("own")))).otherwise(F.array())
    found = F.when(
        (F.size("names") > 0) & (heading | (kind != "text")),
        F.array(
            F.struct(
                F.when(kind == "text", "html_heading").otherwise("html_attribute").alias("rule_id"),
                F.when(kind == "text", "section").otherwise("anchor").alias("kind"),
                F.col("names").alias("names"),
                own.alias("own"),
            )
        ),
    ).otherwise(F.array())
    return placed.select(
        "file_id", "unit", "language", F.col("first_row").alias("line_no"), F.explode(F.concat(found, fragment)).alias("d"),
        headers.alias("headers"),
    ).select(
        "file_id", "unit", "language", "line_no", "d.rule_id", "d.kind", "d.names",
        F.col("d.own.start_line").alias("start_line"), F.col("d.own.end_line").alias("end_line"),
        F.concat(F.array("d.own"), "headers").alias("ranges"),
        F.lit(None).cast("int").alias("attach_start"), "headers",
        F.array().cast("array<int>").alias("hosts"), F.lit("").alias("opener"),
    )
