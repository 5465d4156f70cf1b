"""Queries over the given tables, and the SQL that each must agree with."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import derived_corpora as C  # noqa: E402
import derived_queries  # noqa: E402
import language_corpora  # noqa: E402
import rule_corpora  # noqa: E402
from whereabouts.functions import names as N  # noqa: E402
from whereabouts.functions import text as T  # noqa: E402
from whereabouts.operators import language as L  # noqa: E402
from whereabouts.operators import lookup as Q  # noqa: E402
from whereabouts.operators import recursion as RC  # noqa: E402
from whereabouts.operators import references as R  # noqa: E402
from whereabouts.operators import structure as S  # noqa: E402
from whereabouts.operators.excerpt import excerpts  # noqa: E402
from whereabouts.operators.ranges import last_range_end, union_ranges  # noqa: E402
from whereabouts.plans import extraction as E  # noqa: E402
from whereabouts.plans.index import lookup  # noqa: E402
from whereabouts.rules import layers  # noqa: E402
from whereabouts.session import cut  # noqa: E402
from whereabouts.sources.corpus import quarantine, status_of  # noqa: E402
from whereabouts.sources.notebooks import as_markdown  # noqa: E402

PY = ("Python",)
BLOCKS = "rule_id = 'py_block'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


# ---- text ------------------------------------------------------------------------------------


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


LICENSE = "[Ll]icense|[Cc]opyright"


def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.candidate_files(_doc_files(spark, sf_dir), LICENSE).select(F.col("file_id").alias("doc_id"))


def candidate_files_icase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.candidate_files(_doc_files(spark, sf_dir), "^(licen[cs]e|the)[^a-z]", ignore_case=True).select(F.col("file_id").alias("doc_id"))


def _matching_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_explode(spark, sf_dir).where(F.col("text").rlike("qu|der|sh "))
    return rows.select("doc_id", F.col("line_no").alias("start_line"), (F.col("line_no") + 1).alias("end_line"))


def range_union_gap0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_ranges(_matching_rows(spark, sf_dir), ["doc_id"], 0)


def range_union_gap1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_ranges(_matching_rows(spark, sf_dir), ["doc_id"], 1)


def range_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _matching_rows(spark, sf_dir).withColumn("end_line", F.col("end_line") + F.col("start_line") % 3)
    return last_range_end(wide, ["doc_id"])


def excerpt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matching_rows(spark, sf_dir).withColumnsRenamed({"doc_id": "file_id"}).withColumns(
        {"start_line": F.col("start_line").cast("int"), "end_line": F.col("end_line").cast("int")}
    )
    rows = excerpts(_doc_files(spark, sf_dir), found, ["file_id"])
    return rows.select(F.col("file_id").alias("doc_id"), F.col("range_no").cast("bigint").alias("range_no"), F.col("line_no").cast("bigint").alias("line_no"), "text")


# ---- names -----------------------------------------------------------------------------------


def _styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in three styles, from the words of part names and types."""
    words = _read(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("w")).distinct()
    spelled = F.array(F.replace("w", F.lit(" "), F.lit("_")), F.replace("w", F.lit(" "), F.lit("-")), F.replace(F.initcap("w"), F.lit(" "), F.lit("")))
    return words.select("w", F.explode(spelled).alias("name"))


def case_style_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = _styles(spark, sf_dir)
    terms = styles.select(F.col("name").alias("term_id"), F.col("name").alias("pattern"), F.lit(True).alias("ignore_case"), F.lit(True).alias("case_style"))
    return Q.matching_names(styles.select("name").distinct(), Q.prepared_terms(terms)).select(F.col("term_id").alias("term"), "name")


def case_style_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "part").select(F.col("p_name").alias("pattern")).distinct()
    terms = texts.select(F.col("pattern").alias("term_id"), "pattern", F.lit(True).alias("ignore_case"), F.lit(True).alias("case_style"))
    return Q.prepared_terms(terms).select(F.col("term_id").alias("term"), "status", F.col("bad_at").cast("bigint").alias("bad_at"))


def _py(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return E.extract(C.py_files(spark, sf_dir), PY, **more)


def only_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.only_names(_py(spark, sf_dir))


def complete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.complete(Q.only_names(_py(spark, sf_dir)), "CUSTOMER_1")


# ---- languages -------------------------------------------------------------------------------


def language_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _read(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    paths = paths.unionByName(C.py_files(spark, sf_dir).select(F.col("file_id").alias("path")))
    return paths.groupBy(F.coalesce(L.language_of_path(F.col("path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("n_files"))


def language_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    pick = lambda bits: F.filter(
        F.array(*[F.when((bits.bitwiseAND(F.lit(1 << i))) > 0, F.lit(x)) for i, x in enumerate(["C", "C++", "Objective-C"])]), lambda x: x.isNotNull()
    )
    narrowed = L.narrow(pick(F.col("p_size") % 8), pick((F.col("p_partkey") % 8).cast("int")))
    return part.select("p_partkey", F.array_join(narrowed, ",").alias("candidates"))


# Hints to look up, in any case.
HINTS = {"PY": None, "js": "JavaScript", "TS": "TypeScript", "CPlusPlus": "C++", "golang": "Go", "rust": "Rust", "md": "Markdown", "Bash": "Shell"}


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.array(*[F.lit(h) for h in HINTS])
    hint = F.concat(F.get(hints, (F.col("p_size") % len(HINTS)).cast("int")), F.when(F.col("p_size") > 40, "?").otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", hint.alias("hint")).withColumn("language", L.canonical(F.col("hint")))


def skip_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document under an extension that goes by its source, and of every page."""
    docs = _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.expr("element_at(array('.md', '.xyz', '.json', '.tex'), CAST(substring(source, 4) AS int) % 4 + 1)")).alias("path"),
        F.col("text").alias("content"),
    )
    pages = _read(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"), F.col("html").alias("content"))
    files = docs.unionByName(pages).withColumn("language", L.language_of_path(F.col("path")))
    known = F.col("language").isin(*E.ruled_languages(), "Jupyter Notebook")
    status = status_of(F.lit(None).cast("string"), F.col("language"), known, F.length("content"))
    return quarantine(files.withColumn("status", status))


# ---- pages, Markdown, notebooks --------------------------------------------------------------


def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.extract(C.page_files(spark, sf_dir), ("HTML",))
    return found.where("rule_id = 'html_heading'").select(F.col("file_id").cast("bigint").alias("page_id"), F.explode("names").alias("name"))


def html_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = E.units_of(C.page_files(spark, sf_dir), ("HTML",))
    return units.where("depth = 1").select(F.col("file_id").cast("bigint").alias("page_id"), "language", "content")


def fragment_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.extract(C.page_files(spark, sf_dir), ("HTML", "JavaScript"), keep=Q.name_test("t"), fragment_pattern="t")
    return found.where("rule_id = 'js_variable'").select(F.col("file_id").cast("bigint").alias("page_id"), F.explode("names").alias("name"))


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file_id"), F.lit("YAML").alias("language"), F.col("props").alias("content"))
    return E.extract(files, ("YAML",)).select(F.col("file_id").cast("bigint").alias("event_id"), F.explode("names").alias("name"))


def _md(spark: SparkSession, sf_dir: str, *languages: str) -> DataFrame:
    return E.extract(C.md_files(spark, sf_dir).drop("doc_id"), ("Markdown", *languages))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _md(spark, sf_dir).where("rule_id = 'md_section'").select(
        "file_id", F.explode("names").alias("name"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line")
    )


def front_matter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _md(spark, sf_dir, "YAML").where("language = 'YAML'").select("file_id", F.explode("names").alias("name"), F.col("line_no").cast("bigint").alias("line_no"))


def fenced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = E.units_of(C.md_files(spark, sf_dir), ("Markdown",)).where("depth = 1 AND language = 'Python'")
    return units.select("file_id", "hint", "language", F.col("start_line").cast("bigint").alias("start_line"), "content")


def fence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function inside a fence with all rows shown for it: its own, the fence, both headings."""
    found = _md(spark, sf_dir, "Python").where(BLOCKS)
    shown = union_ranges(found.select("file_id", F.explode("names").alias("name"), F.explode("ranges").alias("r")).select("file_id", "name", "r.*"), ["file_id", "name"])
    return shown.select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def nested_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that lie nine fences deep."""
    found = E.extract(C.nested_files(spark, sf_dir), ("Markdown", "Python")).where(BLOCKS)
    return found.select(F.col("file_id").cast("bigint").alias("doc_id"), F.explode("names").alias("name"), F.col("start_line").cast("bigint").alias("start_line"))


def unclosed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.extract(C.unclosed_files(spark, sf_dir), ("HTML",)).where("rule_id = 'html_heading'")
    return found.select(F.col("file_id").cast("bigint").alias("page_id"), F.explode("names").alias("name"))


def notebook_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_markdown(C.notebook_files(spark, sf_dir)).select("conv_id", "status", "content")


# ---- structure and definitions of code -------------------------------------------------------


def indent_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _py(spark, sf_dir).where(BLOCKS).select(
        "file_id", F.get("names", F.lit(0)).alias("name"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line")
    )


def logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, contexts, lexis, *_ = E._for_languages(PY, E.BUILTIN)
    units = E.units_of(C.py_files(spark, sf_dir), PY).select("file_id", "unit", "language", "start_line", "content")
    rows = S.state_rows(S.read_rows(S.masked_rows(units, lexis), lexis, contexts))
    return rows.groupBy("file_id").agg(F.sum(F.col("is_start").cast("bigint")).alias("n_statements"), F.max("depth_after").cast("bigint").alias("open_at_end"))


def bracketed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that go over several rows, brackets within brackets, and how deep they go."""
    _, contexts, lexis, *_ = E._for_languages(PY, E.BUILTIN)
    units = E.units_of(language_corpora.files(spark, sf_dir, "rows_python"), PY).select("file_id", "unit", "language", "start_line", "content")
    rows = S.state_rows(S.read_rows(S.masked_rows(units, lexis), lexis, contexts))
    return rows.groupBy("file_id").agg(
        F.sum(F.col("is_start").cast("bigint")).alias("n_statements"), F.max("depth_after").cast("bigint").alias("deepest"), F.max_by("depth_after", "line_no").cast("bigint").alias("open_at_end")
    )


def definition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _py(spark, sf_dir).select(F.explode("names").alias("name"), "file_id", "kind").groupBy("name", "file_id", "kind").agg(F.count("*").alias("n_definitions"))


def lookup_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "Customer_[0-9]*7"
    files = Q.candidate_files(C.py_files(spark, sf_dir), pattern)
    found = E.extract(files, PY, keep=Q.name_test(pattern))
    flat = found.select("file_id", F.explode("ranges").alias("r")).select("file_id", "r.start_line", "r.end_line")
    merged = union_ranges(flat, ["file_id"])
    return merged.select("file_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain term per part, one in another style per size, and two patterns."""
    part = _read(spark, sf_dir, "part")
    plain = part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("pattern"), F.lit(False).alias("ignore_case"), F.lit(False).alias("case_style"))
    styled = part.select(F.concat(F.lit("UNIT-"), F.col("p_size").cast("string")).alias("pattern"), F.lit(False).alias("ignore_case"), F.lit(True).alias("case_style")).distinct()
    tried = part.select(F.explode(F.array(F.lit("brand_m.d"), F.lit("segm[a-z]+"))).alias("pattern"), F.lit(True).alias("ignore_case"), F.lit(False).alias("case_style")).distinct()
    return plain.unionByName(styled).unionByName(tried).withColumn("term_id", F.col("pattern"))


def lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup(C.py_files(spark, sf_dir), _terms(spark, sf_dir), PY)
    return found.select("term_id", "file_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def attached_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _py(spark, sf_dir).where(f"({BLOCKS} OR kind = 'parameter') AND attach_start IS NOT NULL").select(
        "file_id", "kind", F.explode("names").alias("name"), F.col("attach_start").cast("bigint").alias("attach_start"), F.col("line_no").cast("bigint").alias("line_no")
    )


def ancestor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _py(spark, sf_dir).where(BLOCKS).select("file_id", F.explode("names").alias("name"), F.explode("headers").alias("h")).select(
        "file_id", "name", F.col("h.start_line").cast("bigint").alias("header_start"), F.col("h.end_line").cast("bigint").alias("header_end")
    )


# ---- references ------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = R.calls_by_definition(_py(spark, sf_dir, references=True))
    return calls.select(F.explode("names").alias("caller"), "callee").distinct()


def calls_by_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def single_callee_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("term_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"))
    chains = RC.single_callee_chains(_edges(spark, sf_dir), starts)
    return chains.select("term_id", F.col("step").cast("bigint").alias("step"), "name")


def recursive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by name; orders with their one part as a pattern, in any case too; customers in another style. Each goes on
    with what it alone calls."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    single = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("k")).agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q")).where("p = q")
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    kinds = [
        (orders, "o:", "concat('order_', k)", False, False),
        (single, "p:", "concat('order_', k, '|part_', CAST(p AS string))", False, False),
        (single, "i:", "concat('(ORDER_', k, '|Part_', CAST(p AS string), ')')", True, False),
        (customers, "c:", "concat('CUSTOMER-', k)", False, True),
    ]
    asked = lambda rows, mark, pattern, case, style: rows.select(
        F.concat(F.lit(mark), "k").alias("term_id"), F.expr(pattern).alias("pattern"), F.lit(case).alias("ignore_case"), F.lit(style).alias("case_style")
    )
    terms = asked(*kinds[0])
    for kind in kinds[1:]:
        terms = terms.unionByName(asked(*kind))
    is_defined = ~F.col("kind").isin("call", "import", "dotted")
    files = cut(C.py_files(spark, sf_dir))  # made once, for the count of its characters and for the extraction
    rows = E.extract(files, PY, references=True).withColumns({"ranges": F.when(is_defined, F.col("ranges")), "hosts": F.when(F.col("kind") == "call", F.col("hosts"))})
    # calls meet definitions where the files lie, so only what is asked for is written, and none of it moves again
    found = cut(rows.drop("language", "attach_start", "headers", "opener"), placed=True)
    index = Q.named(found.where(is_defined)).select("name", "file_id", "ranges")
    hits = RC.recursive_lookup(index, RC.call_edges(R.calls_by_definition(found)), terms)
    return hits.select("term_id", F.col("round").cast("bigint").alias("round"), "file_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def pattern_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of its own per part and per order, and some that do not compile or have no literal, against all names."""
    part, orders = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    terms = part.select(F.concat(F.lit("pa?r[st]{1}_0*"), F.col("p_partkey").cast("string"), F.lit("|unit_(?:x|"), F.col("p_size").cast("string"), F.lit(")")).alias("pattern"), F.lit(False).alias("ignore_case"))
    terms = terms.unionByName(orders.select(F.concat(F.lit("ORDER_"), key, F.lit("[05]?")).alias("pattern"), F.lit(True).alias("ignore_case")))
    terms = terms.unionByName(part.select(F.concat(F.lit("ba["), F.col("p_size").cast("string")).alias("pattern"), F.lit(False).alias("ignore_case")).distinct())
    terms = terms.unionByName(part.select(F.concat(F.lit(".*_"), (F.col("p_size") % 10).cast("string"), F.lit("9")).alias("pattern"), F.lit(False).alias("ignore_case")).distinct())
    ready = Q.prepared_terms(terms.withColumn("case_style", F.lit(False)).withColumn("term_id", F.col("pattern")))
    names = part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"))
    names = names.unionByName(part.select(F.concat(F.lit("unit_"), F.col("p_size").cast("string")).alias("name"))).unionByName(orders.select(F.concat(F.lit("order_"), key).alias("name")))
    found = Q.matching_names(names.distinct(), ready).select("term_id", "name", F.lit("ok").alias("status"))
    return found.unionByName(ready.where("status <> 'ok'").select("term_id", F.lit(None).cast("string").alias("name"), "status"))


def import_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.imports(_py(spark, sf_dir, references=True)).groupBy("language", "origin", "name").agg(F.count("*").alias("n_files"))


def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from imports of several names, over several rows, and the parts of dotted names."""
    block = "from lib_{k}.sub import one_{k} as uno_{k}, two_{k}|from deep_{k} import (|    three_{k},|    four_{k} as vier_{k},|)|call(pkg_{k}.mod.fn)"
    found = E.extract(language_corpora.corpus(spark, sf_dir, "Python", block), PY, references=True)
    return R.imports(found).select("language", "origin", "name").distinct()


def import_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = C.py_files(spark, sf_dir).select(F.col("file_id").alias("path"))
    part = _read(spark, sf_dir, "part")
    origins = part.select(F.lit("Python").alias("language"), F.concat(F.lit("other.parts."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("origin")).distinct()
    return R.import_scores(origins, paths, "strip_ext").select("origin", "path", F.col("score").cast("bigint").alias("score"))


# ---- rule layers -----------------------------------------------------------------------------


def rule_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    builtin = part.groupBy(F.col("p_brand").alias("language"), F.col("p_type").alias("field")).agg(F.max("p_name").alias("value"))
    said = F.when(F.col("p_size") > 45, F.col("p_name"))  # fields that the user leaves unset are null
    user = part.groupBy(F.col("p_brand").alias("language"), F.col("p_type").alias("field")).agg(F.min(said).alias("value"))
    return layers.override(builtin, user)


def rule_extends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations extend their region; regions extend each other in a ring, a base that is not there, or nothing."""
    C.tables(spark, sf_dir, "customer", "nation", "region")
    fields = spark.sql(
        """SELECT n_name AS language, c_mktsegment AS field, max(c_name) AS value,
             IF(n_nationkey % 2 = 0, 'append', 'replace') AS mode
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey, c_mktsegment
           UNION ALL
           SELECT r_name, c_mktsegment, min(c_name), 'replace'
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment"""
    )
    extends = spark.sql(
        """SELECT n_name AS language, r_name AS extends FROM nation JOIN region ON n_regionkey = r_regionkey
           UNION ALL
           SELECT a.r_name, CASE a.r_regionkey WHEN 2 THEN 'NOWHERE' ELSE b.r_name END FROM region a JOIN region b
           ON b.r_regionkey = 1 - a.r_regionkey OR (a.r_regionkey = 2 AND b.r_regionkey = 2)"""
    )
    return layers.extend(fields, extends)


def entry(spark: SparkSession) -> DataFrame:
    """Class and function names looked up in the derived Python corpus: merged ranges."""
    return lookup_batch(spark, "/root/testdata/sf0.001")


QUERIES = [
    lines_explode, candidate_files, candidate_files_icase, range_union_gap0, range_union_gap1, range_end, excerpt_lines,
    case_style_terms, case_style_rejects, only_names, complete_prefix, language_by_extension, language_candidates, alias_lookup,
    skip_status, html_headings, html_fragments, fragment_definitions, json_keys, markdown_sections, front_matter_keys,
    fenced_blocks, fence_context, nested_fragments, unclosed_headings, notebook_markdown, indent_blocks, logical_lines, bracketed_statements, definition_index, lookup_term, lookup_batch,
    attached_context, ancestor_headers, calls_by_definition, single_callee_chain, recursive_lookup, pattern_batch, import_pairs, import_names, import_ranking, rule_override,
    rule_extends,
]


try:  # the operators for training-data corpora and their pipeline, where they are installed
    from whereabouts.llm.queries import ORACLES as LLM_ORACLES
    from whereabouts.llm.queries import QUERIES as LLM_QUERIES
except ImportError:
    LLM_ORACLES, LLM_QUERIES = {}, {}
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {q.__name__: q for q in QUERIES} | language_corpora.QUERIES | rule_corpora.QUERIES | derived_queries.QUERIES | LLM_QUERIES
    return own | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def oracle_sql() -> dict[str, str]:
    from oracles import ORACLES

    return dict(ORACLES) | language_corpora.ORACLES | rule_corpora.ORACLES | derived_queries.ORACLES | LLM_ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {})
