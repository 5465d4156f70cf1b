"""Queries on languages by evidence, reading order, recipes, numbered rows and broken notebooks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import derived_corpora as C
from derived_corpora import LEVELS, nested_sql, py_sql
from oracles import FILLED, HIT_ROWS, ISLANDS, MD_HEADS
from whereabouts.operators import language as L
from whereabouts.operators.detection import with_language
from whereabouts.operators.excerpt import excerpts, formatted
from whereabouts.operators.ordering import numbered
from whereabouts.operators.ordering import reading_order as in_reading_order
from whereabouts.operators.ranges import display_columns, union_ranges
from whereabouts.plans.extraction import extract, ruled_languages, units_of
from whereabouts.sources.notebooks import as_markdown

# ---- languages -------------------------------------------------------------------------------

ENDS = ["h", "ts", "m", "md", "java", "none", "zz9", "tcc"]
FIRSTS = ["", "#!/usr/bin/env python3", "#!/usr/bin/env -S deno run", "#!/bin/bash", "#!/usr/bin/tcc -run"]


def language_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under extensions that one, several or no languages claim, with and without a first row that names an interpreter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda values, key: F.get(F.array(*[F.lit(x) for x in values]), key.cast("int"))
    end, first = pick(ENDS, F.col("doc_id") % len(ENDS)), pick(FIRSTS, F.floor(F.col("doc_id") / len(ENDS)) % len(FIRSTS))
    name = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", F.when(end == "none", name).otherwise(F.concat(name, F.lit("."), F.upper(end))).alias("path"), F.concat(first, F.lit("\n"), "text").alias("content"))
    found = with_language(files, L.languages(spark), ruled_languages())
    return found.select(
        "doc_id", "language", F.array_join(F.array_sort("candidates"), ",").alias("candidates"), F.array_join(F.col("evidence.kind"), ",").alias("kinds"), F.col("language_status").alias("status")
    )


def language_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, aliases and extensions of languages in a table larger than the built-in one: brands of parts are languages here."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    brand = F.col("p_brand")
    empty = F.array().cast("array<string>")
    more = part.groupBy(brand.alias("language")).agg(
        F.lit(None).cast("string").alias("group_language"), F.transform(F.array_sort(F.collect_set("p_type")), F.upper).alias("aliases"),
        F.array(F.concat(F.lit("b"), F.lower(F.replace(brand, F.lit("Brand#"), F.lit("")))), F.lit("java")).alias("extensions"), empty.alias("filenames"), empty.alias("interpreters"),
    )
    table = L.languages(spark).unionByName(more)
    key = F.expr("element_at(array('JAVA', 'py', lower(p_type), lower(p_brand), concat('B', replace(p_brand, 'Brand#', '')), 'rb', 'no such'), CAST(p_partkey % 7 AS int) + 1)")
    found = with_language(part.select("p_partkey", key.alias("hint"), F.lit("").alias("content")), table, ruled_languages())
    return found.select("p_partkey", "hint", "language", F.size("candidates").cast("bigint").alias("n_candidates"), F.col("language_status").alias("status"))


# ---- orders ----------------------------------------------------------------------------------


def _helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(F.concat(F.lit("apps/app_"), F.col("c_custkey").cast("string"), F.lit("/nation_"), F.col("c_nationkey").cast("string"), F.lit("/utils.py")).alias("path"), "c_custkey", "c_nationkey")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of the Python corpus and one ``utils.py`` per customer, by imports of nations', brands' and customers' modules."""
    helpers = _helpers(spark, sf_dir)
    nations = helpers.groupBy("c_nationkey").agg(F.max("c_custkey").alias("c"))
    nation = F.col("c_nationkey").cast("string")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("b")).distinct()
    origins = nations.select(F.col("c_nationkey").alias("seq"), F.concat(F.lit("nation_"), nation, F.lit(".utils")).alias("origin"))
    origins = origins.unionByName(part.select((F.expr("CAST(substring(b, 7) AS int)") + 100).alias("seq"), F.concat(F.lit("src.parts."), "b").alias("origin")))
    origins = origins.unionByName(nations.where("c_nationkey > 9").select((F.col("c_nationkey") + 200).alias("seq"), F.concat(F.lit("apps.app_"), F.col("c").cast("string"), F.lit(".nation_"), nation, F.lit(".utils")).alias("origin")))
    origins = origins.unionByName(nations.select((F.col("c_nationkey") + 300).alias("seq"), F.concat(F.lit("units"), nation).alias("origin")))
    paths = C.py_files(spark, sf_dir).select(F.col("file_id").alias("path")).unionByName(helpers.select("path"))
    return in_reading_order(paths, origins.withColumn("language", F.lit("Python")), "strip_ext")


def files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_helpers(spark, sf_dir).select("path"), F.col("path"))


def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the Markdown corpus defines, sorted."""
    found = extract(C.md_files(spark, sf_dir).drop("doc_id"), ("Markdown",)).where("rule_id = 'md_section'")
    return numbered(found.select(F.explode("names").alias("name")).distinct(), F.col("name"))


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from whereabouts.functions import text as T

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    rows = docs.select("file_id", F.posexplode(T.split_lines(F.col("content"))).alias("start_line", "text")).where(F.col("text").rlike("qu|der|sh "))
    return docs, rows.select("file_id", "start_line", (F.col("start_line") + 1).alias("end_line"))


def ranges_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged ranges by document and start, with their first and last row as people count them."""
    _, found = _hits(spark, sf_dir)
    rows = display_columns(union_ranges(found, ["file_id"], 1)).select(F.col("file_id").alias("doc_id"), "start_line", F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"))
    return numbered(rows, F.col("doc_id"), F.col("start_line")).drop("start_line")


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows to show, each behind its number."""
    docs, found = _hits(spark, sf_dir)
    rows = formatted(excerpts(docs, found, ["file_id"]), ["file_id"])
    return rows.select(F.col("file_id").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), "shown")


# ---- fragments and notebooks -----------------------------------------------------------------


def fragment_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How to come by every fragment of documents within fences within fences."""
    units = units_of(C.nested_files(spark, sf_dir), ("Markdown", "Python"))
    return units.select(F.col("file_id").cast("bigint").alias("doc_id"), F.col("depth").cast("bigint").alias("depth"), F.array_join("recipe", " > ").alias("recipe"))


def notebook_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks with text in the data of their outputs, a third of them without a language and a third with a cell of another kind."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    data = F.transform("t", lambda x: F.struct(F.struct(F.array(F.concat(x["role"], F.lit("\n")), F.lit("end")).alias("text/plain"), F.lit("x").alias("image/png")).alias("data")))
    cell = F.struct(F.lit("code").alias("cell_type"), F.lit("run()").alias("source"), data.alias("outputs"))
    last = F.struct(F.when(F.col("conv_id") % 3 == 1, "raw").otherwise("markdown").alias("cell_type"), F.lit("done").alias("source"))
    meta = F.when(F.col("conv_id") % 3 == 2, F.lit("{}")).otherwise(F.lit('{"language_info": {"name": "python"}}'))
    book = F.concat(F.lit('{"cells": ['), F.to_json(cell), F.lit(", "), F.to_json(last), F.lit('], "metadata": '), meta, F.lit("}"))
    files = parts.select("conv_id", F.col("conv_id").cast("string").alias("file_id"), F.lit(None).cast("string").alias("path"), F.array().cast("array<string>").alias("recipe"), F.lit("Jupyter Notebook").alias("language"), F.lit("ok").alias("status"), book.alias("content"))
    return as_markdown(files).select("conv_id", "status", "content")


QUERIES = {
    f.__name__: f
    for f in (language_chain, language_table, reading_order, files_in_order, names_in_order, ranges_in_order, numbered_rows, fragment_recipe, notebook_status)
}

PATHS = "concat('apps/app_', c_custkey, '/nation_', c_nationkey, '/utils.py')"
ORACLES = {
    "language_chain": """WITH e(i, ext, claims) AS (VALUES (0, 'h', ['C', 'C++', 'Objective-C']), (1, 'ts', ['TypeScript', 'XML']), (2, 'm', ['MATLAB', 'Objective-C']),
            (3, 'md', ['GCC Machine Description', 'Markdown']), (4, 'java', ['Java']), (5, 'none', []), (6, 'zz9', []), (7, 'tcc', ['C++'])),
          s(j, runs) AS (VALUES (0, []), (1, ['Python']), (2, ['TypeScript']), (3, ['Shell']), (4, ['C'])),
          d AS (SELECT doc_id, ext, claims, runs, list_filter(runs, lambda x: list_contains(claims, x)) AS common FROM documents
            JOIN e ON i = doc_id % 8 JOIN s ON j = (doc_id // 8) % 5 WHERE text IS NOT NULL),
          c AS (SELECT doc_id, ext, CASE WHEN len(claims) = 0 THEN runs WHEN len(common) > 0 THEN common ELSE claims END AS c,
            concat_ws(',', CASE WHEN len(claims) > 0 THEN 'extension' END, CASE WHEN len(runs) > 0 THEN 'interpreter' END) AS kinds FROM d),
          l AS (SELECT *, CASE WHEN len(c) = 1 THEN c[1] WHEN ext = 'h' THEN 'C' WHEN ext = 'ts' THEN 'TypeScript' WHEN ext = 'md' THEN 'Markdown' END AS language FROM c)
          SELECT doc_id, language, array_to_string(c, ',') AS candidates, kinds, CASE WHEN len(c) = 0 THEN 'unknown_language' WHEN language IS NULL THEN 'ambiguous_language'
            WHEN language IN ('Java', 'XML', 'Objective-C', 'MATLAB') THEN 'unsupported_language' ELSE 'ok' END AS status FROM l""",
    "language_table": """WITH k AS (SELECT p_partkey, p_brand, p_type, [ 'JAVA', 'py', lower(p_type), lower(p_brand), concat('B', replace(p_brand, 'Brand#', '')), 'rb', 'no such'][p_partkey % 7 + 1] AS hint, p_partkey % 7 AS i FROM part),
          n AS (SELECT lower(p_type) AS t, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part GROUP BY 1)
          SELECT p_partkey, hint, CASE i WHEN 0 THEN 'Java' WHEN 1 THEN 'Python' WHEN 2 THEN (CASE WHEN n.n = 1 THEN n.b END) WHEN 3 THEN p_brand WHEN 4 THEN p_brand WHEN 5 THEN 'Ruby' END AS language,
            CASE i WHEN 2 THEN n.n WHEN 6 THEN 0 ELSE 1 END AS n_candidates,
            CASE i WHEN 1 THEN 'ok' WHEN 6 THEN 'unknown_language' WHEN 2 THEN (CASE WHEN n.n > 1 THEN 'ambiguous_language' ELSE 'unsupported_language' END) ELSE 'unsupported_language' END AS status
          FROM k JOIN n ON n.t = lower(p_type)""",
    "reading_order": f"""WITH py AS ({py_sql('duckdb')}), paths AS (SELECT path FROM py UNION ALL SELECT {PATHS} FROM customer),
          n AS (SELECT c_nationkey AS k, max(c_custkey) AS c FROM customer GROUP BY 1),
          o(seq, origin) AS (SELECT k, concat('nation_', k, '.utils') FROM n
            UNION ALL SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) + 100, concat('src.parts.', lower(replace(p_brand, '#', '_'))) FROM part
            UNION ALL SELECT k + 200, concat('apps.app_', c, '.nation_', k, '.utils') FROM n WHERE k > 9 UNION ALL SELECT k + 300, concat('units', k) FROM n),
          p AS (SELECT path, list_reverse(string_split(regexp_replace(path, '\\.py$', ''), '/')) AS a FROM paths),
          s AS (SELECT path, seq, a, list_reverse(string_split(origin, '.')) AS b FROM p CROSS JOIN o),
          v AS (SELECT path, list(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) ORDER BY seq DESC) AS v FROM s GROUP BY path)
          SELECT path, row_number() OVER (ORDER BY v DESC, path) - 1 AS position FROM v""",
    "files_in_order": f"SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM (SELECT {PATHS} AS path FROM customer)",
    "names_in_order": f"WITH {MD_HEADS} SELECT name, row_number() OVER (ORDER BY name) - 1 AS position FROM (SELECT DISTINCT name FROM h WHERE name <> '')",
    "ranges_in_order": f"""WITH {HIT_ROWS}, {FILLED}, i AS ({ISLANDS.format('f')})
          SELECT doc_id, start_line + 1 AS first_line, end_line AS last_line, row_number() OVER (ORDER BY doc_id, start_line) - 1 AS position FROM i""",
    "numbered_rows": f"""WITH {HIT_ROWS}, {FILLED}, w AS (SELECT doc_id, max(line_no) + 1 AS widest FROM f GROUP BY doc_id)
          SELECT f.doc_id, f.line_no + 1 AS line_no, concat(' ', lpad(CAST(f.line_no + 1 AS VARCHAR), CAST(length(CAST(widest AS VARCHAR)) AS INT), ' '), ' | ', l.text) AS shown
          FROM f JOIN w USING (doc_id) JOIN l ON l.doc_id = f.doc_id AND l.line_no = f.line_no""",
    "fragment_recipe": f"""WITH n AS ({nested_sql('duckdb')}), r AS (SELECT doc_id, len(string_split(content, chr(10))) - 1 - 2 * {LEVELS} - 4 AS r FROM n)
          SELECT doc_id, d AS depth, concat_ws(' > ', concat('cat ', doc_id), array_to_string(list_transform(range(1, d + 1), lambda x: concat('rows ', r + x, '-', r + 2 * {LEVELS} + 4 - x)), ' > ')) AS recipe
          FROM r CROSS JOIN (SELECT unnest(range(1, {LEVELS} + 2)) AS d) UNION ALL SELECT doc_id, 0, concat('cat ', doc_id) FROM r""",
    "notebook_status": """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'ok' ELSE 'bad_notebook' END AS status, CASE WHEN conv_id % 3 = 0 THEN
            concat('```python', chr(10), 'run()', chr(10), '```', chr(10), chr(10), string_agg(concat('```', chr(10), role, chr(10), 'end', chr(10), '```', chr(10), chr(10)), '' ORDER BY turn, role), 'done', chr(10), chr(10)) END AS content
          FROM conversations GROUP BY conv_id""",
}
