"""Orders over whole tables, and the order in which to read files by what was imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows with their number in an order over the whole table, from 0.

    The table is sorted by range and written once; what is added up over all of it is one count per partition of the sort.
    """
    at = "_at"
    placed = cut(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # as many rows as the sort has partitions
    return rows.withColumn(name, F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", at)


def _suffixes(parts: Column, most: Column) -> Column:
    """The last part, the last two, ...: each as one text, last part first."""
    ends = F.slice(F.reverse(parts), F.lit(1), most)
    return F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.array_join(F.slice(ends, F.lit(1), i), "/"))


def reading_keys(paths: DataFrame, origins: DataFrame, mode: str = "exact") -> DataFrame:
    """``path, key`` of the paths that end like some origin: a greater key is to be read earlier.

    What counts is the number of equal last parts, with the origin seen last first, then the one before it, and so on. All endings of
    the origins make a tree. Where two paths part in it, all origins outside both branches agree with both alike, and in the two branches
    the origin seen last decides. So a path's key is, ending by ending, the number of the last origin that has that ending; no
    path meets an origin, and a key is as long as the path is deep.
    """
    seen = origins.where("language = 'Python'").groupBy("origin").agg(F.min(F.col("seq").cast("bigint")).alias("seq"))
    parts = F.split(F.replace("origin", F.lit("/"), F.lit("\u0001")), r"\.")  # a part of a path holds no slash
    ends = seen.select("seq", F.explode(_suffixes(parts, F.size(parts))).alias("ending"))
    nodes = ends.groupBy("ending").agg(F.max("seq").alias("seq"))
    above = nodes.select("ending", F.explode(F.sequence(F.lit(1), F.size(F.split("ending", "/")))).alias("depth"))
    above = above.withColumn("up", F.expr("substring_index(ending, '/', depth)"))
    keys = above.join(nodes.withColumnsRenamed({"ending": "up", "seq": "last"}), "up").groupBy("ending").agg(F.array_sort(F.collect_list(F.struct("depth", "last"))).alias("k"))
    keys = keys.select("ending", F.col("k.last").alias("key"))
    deepest = F.coalesce(F.lit(keys.agg(F.max(F.size("key"))).first()[0]), F.lit(0))
    path = F.col("path") if mode == "exact" else F.regexp_replace("path", r"\.[^./]*$", "")
    own = F.filter(F.split(path, "/"), lambda p: p != "")
    asked = paths.where("path IS NOT NULL").select("path").distinct().where(F.size(own) > 0)
    met = asked.select("path", F.explode(_suffixes(own, F.least(F.size(own), F.greatest(deepest, F.lit(1))))).alias("ending")).join(keys, "ending")
    return met.groupBy("path").agg(F.max("key").alias("key"))  # the deepest ending met has the longest key, and that is the greatest


def reading_order(paths: DataFrame, origins: DataFrame, mode: str = "exact") -> DataFrame:
    """``paths`` with ``position``: those that end like an imported origin first, then in path order.

    ``origins`` has ``seq``, the order in which origins were seen, ``language`` and ``origin``; those of other languages than Python
    change nothing, and an origin seen again changes nothing. Input without a path comes before the paths that end like none.
    """
    keyed = paths.join(reading_keys(paths, origins, mode), "path", "left")
    key = F.coalesce("key", F.array().cast("array<bigint>"))
    return numbered(keyed, key.desc(), F.col("path").asc_nulls_first()).drop("key")
