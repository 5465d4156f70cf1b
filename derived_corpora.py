"""Corpora of code, Markdown and notebooks, derived from the given tables.

The texts of ``PY`` and ``MD`` work in Spark and in DuckDB; only the spelling of the ordered
string aggregate differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N = "chr(10)"


def _agg(engine: str, value: str, by: str, order: str) -> str:
    if engine == "spark":
        return f"string_agg({value}, {by}) WITHIN GROUP (ORDER BY {order})"
    return f"string_agg({value}, {by} ORDER BY {order})"


def py_sql(engine: str) -> str:
    """``path, content``: one Python module per customer, per brand, and one for units."""
    s = lambda x: f"CAST({x} AS varchar)" if engine != "spark" else f"CAST({x} AS string)"
    return f"""
    SELECT concat('src/nation_', {s('c_nationkey')}, '/customer_', {s('c_custkey')}, '.py') AS path,
      concat('from src.parts import brands as brand_mod', {N}, {N}, '# ', c_mktsegment, {N},
        'class Customer_', {s('c_custkey')}, ':', {N}, '    segment = "', c_mktsegment, '"', {N}, {N},
        coalesce({_agg(engine, 'm', f'concat({N}, {N})', 'o_orderkey')}, ''), {N}) AS content
    FROM customer LEFT JOIN (
      SELECT o_custkey, o_orderkey, concat('    # order ', {s('o_orderkey')}, {N}, '    @audited', {N},
        '    def order_', {s('o_orderkey')}, '(self, qty=1):', {N}, coalesce(body, '        pass')) AS m
      FROM orders LEFT JOIN (
        SELECT l_orderkey, {_agg(engine, f"concat('        part_', {s('l_partkey')}, '(qty)')", N, 'l_partkey')} AS body
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x
        GROUP BY l_orderkey) b ON l_orderkey = o_orderkey) meth ON o_custkey = c_custkey
    GROUP BY c_custkey, c_nationkey, c_mktsegment
    UNION ALL
    SELECT concat('src/parts/', lower(replace(p_brand, '#', '_')), '.py') AS path,
      {_agg(engine, f"concat('def part_', {s('p_partkey')}, '(n):', {N}, '    return unit_', {s('p_size')}, '(n)', {N})", N, 'p_partkey')} AS content
    FROM part GROUP BY p_brand
    UNION ALL
    SELECT 'src/parts/units.py' AS path,
      {_agg(engine, f"concat('def unit_', {s('p_size')}, '(n):', {N}, '    return n * ', {s('p_size')}, {N})", N, 'p_size')} AS content
    FROM (SELECT DISTINCT p_size FROM part) u"""


def md_sql(engine: str) -> str:
    """``path, doc_id, content``: one Markdown file per document, with front matter and a fence."""
    s = lambda x: f"CAST({x} AS varchar)" if engine != "spark" else f"CAST({x} AS string)"
    return f"""
    SELECT concat('docs/', source, '/doc_', {s('doc_id')}, '.md') AS path, doc_id,
      concat('---', {N}, 'source: ', source, {N}, '"lang": ', lang, {N}, '---', {N}, {N},
        '# Document ', {s('doc_id')}, {N}, {N}, '## Text', {N}, {N}, text, {N}, {N},
        '## Code', {N}, {N}, '```python', {N}, 'def doc_', {s('doc_id')}, '():', {N}, '    return ', {s('n_chars')}, {N}, '```', {N}) AS content
    FROM documents"""


LEVELS = 8  # of Markdown within Markdown


def nested_sql(engine: str) -> str:
    """``doc_id, content``: each text, then Markdown fences inside each other with a function in the innermost."""
    doc = "CAST(doc_id AS varchar)" if engine != "spark" else "CAST(doc_id AS string)"
    ticks = ["`" * (3 + LEVELS - k) for k in range(LEVELS)]
    opened = ", ".join(f"'{t}md', {N}" for t in ticks)
    closed = ", ".join(f"'{t}', {N}" for t in reversed(ticks))
    return f"""
    SELECT doc_id, concat(text, {N}, {opened}, '```python', {N}, 'def deep_', {doc}, '():', {N}, '    pass', {N}, '```', {N}, {closed}) AS content
    FROM documents WHERE text IS NOT NULL"""


def unclosed_sql(engine: str) -> str:
    """``page_id, content``: each page behind headings of which one is never closed, and before a close tag too many."""
    page = "CAST(page_id AS varchar)" if engine != "spark" else "CAST(page_id AS string)"
    return f"""
    SELECT page_id, concat('<h2>Lost ', {page}, '<p><h2>Kept ', {page}, '</h2><div>', html, '</div></h3><h2>Also ', {page}, '</h2>') AS content
    FROM pages WHERE html IS NOT NULL"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def py_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "orders", "lineitem", "part")
    return spark.sql(py_sql("spark")).select(F.col("path").alias("file_id"), F.lit("Python").alias("language"), "content")


def md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents")
    return spark.sql(md_sql("spark")).select(F.col("path").alias("file_id"), "doc_id", F.lit("Markdown").alias("language"), "content")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").cast("string").alias("file_id"), F.lit("HTML").alias("language"), F.col("html").alias("content"))


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "documents")
    return spark.sql(nested_sql("spark")).select(F.col("doc_id").cast("string").alias("file_id"), F.lit("Markdown").alias("language"), "content")


def unclosed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "pages")
    return spark.sql(unclosed_sql("spark")).select(F.col("page_id").cast("string").alias("file_id"), F.lit("HTML").alias("language"), "content")


def notebook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notebook per conversation: code cells for the assistant, Markdown cells for others."""
    tables(spark, sf_dir, "conversations")
    return spark.sql(
        r"""
        SELECT concat('nb/conv_', CAST(conv_id AS string), '.ipynb') AS file_id, conv_id,
          concat('{"cells": [', array_join(transform(array_sort(collect_list(struct(turn, cell))), x -> x.cell), ', '),
            '], "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}') AS content
        FROM (
          SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN
              to_json(named_struct('cell_type', 'code', 'source',
                transform(split(text, '\n', -1), (x, i) -> IF(i < size(split(text, '\n', -1)) - 1, concat(x, '\n'), x)),
                'outputs', array(named_struct('output_type', 'stream', 'name', 'stdout', 'text', array(role)))))
            ELSE to_json(named_struct('cell_type', 'markdown', 'source', text)) END AS cell
          FROM conversations)
        GROUP BY conv_id"""
    ).withColumns({"language": F.lit("Jupyter Notebook"), "status": F.lit("ok"), "recipe": F.array(F.concat(F.lit("cat "), F.col("file_id"))), "path": F.col("file_id")})
