"""Notebooks as Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(variant: str, path: str) -> str:
    """SQL: a text that is a string, or a list of rows whose ends are dropped."""
    rows = f"transform(try_variant_get({variant}, '{path}', 'array<string>'), x -> regexp_replace(x, '[\\\\r\\\\n]+\\\\z', ''))"
    plain = f"variant_get({variant}, '{path}', 'string')"
    is_list = f"startswith(schema_of_variant(try_variant_get({variant}, '{path}', 'variant')), 'ARRAY')"
    return f"IF({is_list}, array_join({rows}, '\\n'), {plain})"


def _fence(tag: str, text: str) -> str:
    return f"concat('```', {tag}, '\\n', {text}, '\\n```\\n\\n')"


def as_markdown(files: DataFrame) -> DataFrame:
    """Derived Markdown files of all notebooks; a broken one comes back with its status.

    Cells and outputs are taken by per-row expressions inside one notebook, so no shuffle is
    needed to put them in order.
    """
    books = files.where("language = 'Jupyter Notebook' AND status = 'ok'")
    output = (
        "concat("
        + f"coalesce({_fence(chr(39) * 2, _text('o', '$.text'))}, ''), "
        + f"coalesce({_fence(chr(39) + 'py' + chr(39), _text('o', '$.traceback'))}, ''), "
        + f"coalesce({_fence(chr(39) * 2, _text('o', chr(36) + '.data[' + chr(92) * 2 + chr(39) + 'text/plain' + chr(92) * 2 + chr(39) + ']').replace(chr(92) * 2 + chr(39), chr(34)))}, ''))"
    )
    source = _text("c", "$.source")
    kind = "variant_get(c, '$.cell_type', 'string')"
    cell = f"concat(IF({kind} = 'markdown', concat({source}, '\\n\\n'), {_fence('_lang', source)}), coalesce(array_join(transform(try_variant_get(c, '$.outputs', 'array<variant>'), o -> {output}), ''), ''))"
    parsed = (
        books.withColumn("_v", F.expr("try_parse_json(content)"))
        .withColumn("_lang", F.expr("try_variant_get(_v, '$.metadata.language_info.name', 'string')"))
        .withColumn("_cells", F.expr("try_variant_get(_v, '$.cells', 'array<variant>')"))
    )
    bad = (
        "_lang IS NULL OR _cells IS NULL OR "
        "NOT forall(_cells, c -> coalesce(try_variant_get(c, '$.cell_type', 'string') IN ('markdown', 'code'), false)"
        " AND try_variant_get(c, '$.source', 'variant') IS NOT NULL)"
    )
    done = parsed.withColumn("status", F.expr(f"IF({bad}, 'bad_notebook', 'ok')"))
    text = F.expr(f"IF(status = 'ok', array_join(transform(_cells, c -> {cell}), ''), NULL)")
    others = [c for c in files.columns if c not in ("content", "status", "language", "file_id", "path", "recipe")]
    return done.select(
        F.concat("file_id", F.lit("#markdown")).alias("file_id"),
        F.lit(None).cast("string").alias("path"),
        F.array_append("recipe", F.lit("<to markdown>")).alias("recipe"),
        F.lit("Markdown").alias("language"),
        "status",
        *others,
        text.alias("content"),
    )


def with_derived(files: DataFrame) -> DataFrame:
    """Files, with each notebook in place of itself as the Markdown made from it."""
    kept = files.where("NOT (language <=> 'Jupyter Notebook' AND status = 'ok')")
    return kept.unionByName(as_markdown(files))
