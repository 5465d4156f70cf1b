"""The rows to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranges import fill_gaps


def excerpts(files: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered rows of the merged ranges: ``keys, range_no, line_no`` (from 1) ``, text``.

    All ranges of a file go to it as one row, so a text moves once, whatever the number of terms that
    hit it, and only texts with hits are split.
    """
    merged = fill_gaps(found, keys)
    order = Window.partitionBy(*keys).orderBy("start_line")
    numbered = merged.withColumn("range_no", F.row_number().over(order))
    asked = F.collect_list(F.struct(*[k for k in keys if k != "file_id"], "range_no", "start_line", "end_line"))
    per_file = numbered.groupBy("file_id").agg(asked.alias("_ranges"))
    rows = files.select("file_id", "content").join(per_file, "file_id")
    rows = rows.select("file_id", T.split_lines(F.col("content")).alias("_rows"), "_ranges")
    part = lambda r: F.slice("_rows", r["start_line"] + 1, r["end_line"] - r["start_line"])
    cut = rows.select("file_id", F.explode(F.transform("_ranges", lambda r: F.struct(r.alias("r"), part(r).alias("part")))).alias("_c"))
    return cut.select("file_id", "_c.r.*", F.posexplode("_c.part").alias("_i", "text")).select(
        *keys, "range_no", (F.col("start_line") + F.col("_i") + 1).alias("line_no"), "text"
    )


def formatted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their number right-aligned to the widest one shown of the file."""
    width = F.length(F.max("line_no").over(Window.partitionBy(*keys)).cast("string"))
    number = F.col("line_no").cast("string")
    padded = F.concat(F.repeat(F.lit(" "), width - F.length(number)), number)
    return rows.withColumn("shown", F.concat(F.lit(" "), padded, F.lit(" | "), F.col("text")))
