"""The language of files by all the evidence there is, from a table of languages of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import language as L

BROADCAST_ROWS = 20_000  # keys; a larger table is joined by a shuffle of the files' keys
# Kinds of evidence in the order in which they narrow the candidates, and the columns of a language table they are looked up in.
KINDS = {"hint": "aliases", "filename": "filenames", "extension": "extensions", "interpreter": "interpreters"}


def keys_of(table: DataFrame) -> DataFrame:
    """``kind, key, candidates``: every key in lower case, with all the languages that claim it, in order.

    A hint may be a name, an alias or an extension; older short names of languages count as aliases.
    """
    name = F.lower("language")
    of = lambda kind, keys: table.select("language", F.lit(kind).alias("kind"), F.explode(keys).alias("key"))
    said = F.array_union(F.array(name), F.array_union("aliases", "extensions"))
    rows = of("hint", said)
    for kind, column in list(KINDS.items())[1:]:
        rows = rows.unionByName(of(kind, F.col(column)))
    legacy = table.sparkSession.createDataFrame([(v, "hint", k) for k, v in L.LEGACY.items()], "language string, kind string, key string")
    rows = rows.unionByName(legacy.join(table.select("language").distinct(), "language", "left_semi"))
    by_name = rows.where(F.lower("key") == name).select("kind", F.lower("key").alias("key"), F.col("language").alias("_own")).where("kind = 'hint'").distinct()
    found = rows.groupBy("kind", F.lower("key").alias("key")).agg(F.array_sort(F.collect_set("language")).alias("candidates"))
    # what is a language's own name means that language, whoever else claims it
    own = found.join(by_name, ["kind", "key"], "left")
    return own.select("kind", "key", F.when(F.col("_own").isNotNull(), F.array("_own")).otherwise(F.col("candidates")).alias("candidates"))


def _preferred(key: Column, candidates: Column) -> Column:
    found = F.lit(None).cast("string")
    for one, language in L.PREFERRED.items():
        found = F.when((key == one) & F.array_contains(candidates, language), language).otherwise(found)
    return found


def with_language(files: DataFrame, table: DataFrame, ruled: tuple[str, ...] | None = None) -> DataFrame:
    """``files`` with ``language, candidates, evidence, language_status``, from ``path``, ``hint`` (both may be null or missing) and
    the first row of ``content``.

    Each kind of evidence that is there narrows the candidates, never to none. One that is left is the language; of several the
    preferred owner of the extension or hint is. ``evidence`` keeps what each kind said, in order. The status is ``ok``, ``unknown_language``,
    ``ambiguous_language``, or ``unsupported_language`` for one not in ``ruled``.
    """
    none = F.lit(None).cast("string")
    path = F.col("path") if "path" in files.columns else none
    hint = F.col("hint") if "hint" in files.columns else none
    blank = lambda x: F.when(x != "", x)
    asked = {
        "hint": blank(F.lower(hint)),
        "filename": blank(F.lower(F.regexp_extract(path, r"([^/]+)$", 1))),
        "extension": blank(L.extension(path)),
        "interpreter": blank(F.lower(L.interpreter(F.col("content")))),
    }
    keys = keys_of(table)
    small = keys.count() <= BROADCAST_ROWS
    rows = files.withColumns({f"_{kind}": key for kind, key in asked.items()})
    for kind in KINDS:
        own = keys.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.col("candidates").alias(f"_{kind}_has"))
        rows = rows.join(F.broadcast(own) if small else own, f"_{kind}", "left")
    nothing = F.array().cast("array<string>")
    rows = rows.withColumn("candidates", nothing)
    said = []
    for kind in KINDS:
        has = F.coalesce(f"_{kind}_has", nothing)
        rows = rows.withColumn("candidates", F.when(F.size(has) > 0, L.narrow(F.col("candidates"), has)).otherwise(F.col("candidates")))
        said.append(F.when(F.size(has) > 0, F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("key"), has.alias("candidates"))))
    rows = rows.withColumn("evidence", F.array_compact(F.array(*said)))
    one = F.when(F.size("candidates") == 1, F.col("candidates")[0])
    rows = rows.withColumn("language", F.coalesce(one, _preferred(F.col("_hint"), F.col("candidates")), _preferred(F.col("_extension"), F.col("candidates"))))
    known = F.lit(True) if ruled is None else F.col("language").isin(*ruled)
    status = F.when(F.size("candidates") == 0, "unknown_language").when(F.col("language").isNull(), "ambiguous_language").when(~known, "unsupported_language")
    kept = [c for c in files.columns if c not in ("language", "candidates", "evidence", "language_status")]
    return rows.withColumn("language_status", status.otherwise("ok")).select(*kept, "language", "candidates", "evidence", "language_status")
