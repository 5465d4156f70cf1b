"""Small operators against plain models."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from whereabouts.functions import names as N
from whereabouts.functions import text as T
from whereabouts.operators import language as L
from whereabouts.operators import lookup as Q
from whereabouts.operators import recursion as RC
from whereabouts.operators import references as R
from whereabouts.operators.excerpt import excerpts, formatted
from whereabouts.operators.ranges import union_ranges
from whereabouts.plans.extraction import extract
from whereabouts.plans.index import lookup_word, read_index, save_index
from whereabouts.rules import layers
from whereabouts.rules.builtin import LEXIS, RULES
from whereabouts.sources.corpus import duplicate_keys, quarantine, read_tree, source_files
from whereabouts.sources.notebooks import as_markdown, with_derived

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=30), st.integers(0, 2))
def test_union_covers_rows(spark, starts, gap):
    ranges = [(a, a + n) for a, n in starts]
    df = spark.createDataFrame([("f", a, b) for a, b in ranges], "file_id string, start_line int, end_line int")
    got = sorted((r.start_line, r.end_line) for r in union_ranges(df, ["file_id"], gap).collect())
    rows = {x for a, b in ranges for x in range(a, b)}
    covered = {x for a, b in got for x in range(a, b)}
    assert rows <= covered
    if gap == 0:
        assert rows == covered
    assert all(b[0] - a[1] > gap for a, b in zip(got, got[1:]))


@FEW
@given(st.lists(st.text(alphabet="ab_\"'#(){}[]\\ \tx=", max_size=12), min_size=1, max_size=8))
def test_mask_keeps_shape(spark, lines):
    lexis = next(v for k, v in LEXIS.items() if "Python" in k)
    content = "\n".join(lines)
    df = spark.createDataFrame([(content,)], "content string")
    masked = df.select(F.expr(T.mask_sql("content", lexis.token, lexis.comment))).first()[0]
    assert [len(x) for x in masked.split("\n")] == [len(x) for x in lines]
    back = spark.createDataFrame([(masked,)], "m string").select(T.unmask(F.col("m"))).first()[0]
    assert all(a == b or a in " " + T.TEXT_OPEN + T.TEXT_CLOSE for a, b in zip(back, content))


def test_mask_hides_brackets_in_literals(spark):
    lexis = next(v for k, v in LEXIS.items() if "Python" in k)
    df = spark.createDataFrame([("x = '(' # {\ny = \"\"\"a\n(b\"\"\"",)], "content string")
    masked = df.select(F.expr(T.mask_sql("content", lexis.token, lexis.comment))).first()[0]
    assert not re.search(r"[(){}\[\]]", masked)


@pytest.mark.parametrize("text,rows", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n\n", ["a", "b", ""]), ("\n", [""])])
def test_split_lines(spark, text, rows):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.split_lines(F.col("t"))).first()[0] == rows


@FEW
@given(st.lists(st.text(alphabet="abcdefg", min_size=2, max_size=5), min_size=1, max_size=4))
def test_case_styles_match_each_other(spark, words):
    styles = ["_".join(words), "-".join(words), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:])]
    df = spark.createDataFrame([(s,) for s in styles], "name string")
    terms = df.selectExpr("name AS term_id", "name AS pattern", "true AS ignore_case", "true AS case_style")
    got = {(r.term_id, r.name) for r in Q.matching_names(df.distinct(), Q.prepared_terms(terms.distinct())).collect()}
    assert got == {(a, b) for a in styles for b in styles}


def test_case_style_keeps_word_ends_and_rejects(spark):
    names = spark.createDataFrame([("f_oo",), ("FOO",), ("_foo_",)], "name string")
    terms = spark.createDataFrame([(1, "foo", False, True), (2, "é.x", False, True)], "term_id int, pattern string, ignore_case boolean, case_style boolean")
    ready = Q.prepared_terms(terms)
    assert {(r.term_id, r.name) for r in Q.matching_names(names, ready).collect()} == {(1, "FOO"), (1, "_foo_")}
    assert ready.where("term_id = 2").first().bad_at == 2


def test_more_patterns_than_one_plan_holds(spark):
    names = spark.createDataFrame([(f"n{i}x",) for i in range(300)], "name string")
    terms = spark.createDataFrame([(i, f"n{i}.", False, False) for i in range(300)], "term_id int, pattern string, ignore_case boolean, case_style boolean")
    got = {(r.term_id, r.name) for r in Q.matching_names(names, Q.prepared_terms(terms)).collect()}
    assert got == {(i, n) for i in range(300) for n in (f"n{j}x" for j in range(300)) if re.fullmatch(f"n{i}.", n)}


def test_names_end_before_a_line_feed(spark):
    df = spark.createDataFrame([("a",), ("a\n",)], "name string")
    assert [r.name for r in df.where(df.name.rlike(r"^(a)\z")).collect()] == ["a"]
    assert df.select(N.whole_pattern(F.lit("a")).alias("p")).first().p == r"^(a)\z"


def test_candidates_are_per_row(spark):
    files = spark.createDataFrame([("1", "ab\ncd"), ("2", "xab")], "file_id string, content string")
    ids = lambda p: sorted(r.file_id for r in Q.candidate_files(files, p).collect())
    assert ids("^ab") == ["1"]
    assert ids(r"b\sc") == []
    assert ids("ab") == ["1", "2"]
    assert ids("b$") == ["1", "2"]


def test_language(spark):
    rows = [("a/b.PY", "Python"), ("x.md", "Markdown"), ("n.ipynb", "Jupyter Notebook"), ("SConstruct", "Python"), ("z.qq", None), ("t.h", "C")]
    df = spark.createDataFrame(rows, "path string, want string").withColumn("got", L.language_of_path(F.col("path")))
    assert df.where("NOT got <=> want").count() == 0
    text = spark.createDataFrame([("#!/usr/bin/env python3\n", "Python"), ("#!/bin/sh", "Shell"), ("x", None)], "t string, want string")
    assert text.where(~L.language_of_shebang(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    table = L.aliases(L.languages(spark)).where("alias = 'md'").orderBy("language").collect()
    assert [(r.language, r.preferred) for r in table] == [("GCC Machine Description", False), ("Markdown", True)]


def test_source_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "b.py").write_bytes(b"\x00\x01")
    (tmp_path / "c.py").write_bytes(b"\xff\xfe")
    (tmp_path / "e.zz").write_bytes(b"hi")
    files = source_files(read_tree(spark, str(tmp_path)), ruled=("Python",))
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.collect()}
    assert got == {"a.py": "ok", "c.py": "unreadable", "e.zz": "unknown_language"}
    assert {r.status: r.n_files for r in quarantine(files).collect()}["ok"] == 1


def test_copies_fold_and_texts_without_path(spark):
    table = spark.createDataFrame([("a.py", "x"), ("a.py", "x"), ("a.py", "y")], "path string, content string")
    assert source_files(table, unique=False).count() == 2
    assert duplicate_keys(source_files(table)).first().n_rows == 3
    loose = spark.createDataFrame([("#!/bin/sh\nx=1",), ("",)], "content string")
    got = sorted((r.language or "", r.status) for r in source_files(loose, path=None).collect())
    assert got == [("", "empty_input"), ("Shell", "ok")]


NOTEBOOK = (
    '{"cells": [{"cell_type": "markdown", "source": ["# T\\n", "text"]}, {"cell_type": "markdown", "source": "[1, 2]"},'
    ' {"cell_type": "code", "source": "def f():\\n    pass", "outputs": [{"output_type": "stream", "text": ["a\\n", "b"]},'
    ' {"output_type": "error", "traceback": ["t1", "t2"]}, {"output_type": "display_data", "data": {"text/plain": ["p"], "image/png": "x"}}]}],'
    ' "metadata": {"language_info": {"name": "python"}}}'
)


def test_notebooks(spark):
    bad = [("b.ipynb", "{oops"), ("c.ipynb", '{"cells": [{"cell_type": "raw", "source": ""}], "metadata": {"language_info": {"name": "python"}}}'), ("d.ipynb", '{"cells": [], "metadata": {}}')]
    table = spark.createDataFrame([("a.ipynb", NOTEBOOK), *bad, ("e.py", "x=1")], "path string, content string")
    files = source_files(table)
    got = {r.file_id: r for r in as_markdown(files).collect()}
    assert {k: r.status for k, r in got.items() if r.status != "ok"} == {k + "#markdown": "bad_notebook" for k, _ in bad}
    good = got["a.ipynb#markdown"]
    assert good.content == "# T\ntext\n\n[1, 2]\n\n```python\ndef f():\n    pass\n```\n\n```\na\nb\n```\n\n```py\nt1\nt2\n```\n\n```\np\n```\n\n"
    assert good.recipe == ["cat a.ipynb", "<to markdown>"] and good.path is None
    found = extract(with_derived(files).where("status = 'ok'"), ("Markdown", "Python"))
    names = {n for r in found.collect() for n in r.names}
    assert {"T", "f", "x"} <= names


@FEW
@given(st.lists(st.text(alphabet="ab c", max_size=5), min_size=1, max_size=4))
def test_list_and_string_source_agree(spark, rows):
    import json

    book = lambda s: json.dumps({"cells": [{"cell_type": "code", "source": s}], "metadata": {"language_info": {"name": "x"}}})
    table = spark.createDataFrame([("a.ipynb", book([r + "\n" for r in rows])), ("b.ipynb", book("\n".join(rows)))], "path string, content string")
    one, two = [r.content for r in as_markdown(source_files(table)).orderBy("file_id").collect()]
    assert one == two


CALLS = """def fetch(url):
    return retry(url)


def retry(url):
    if url.broken:
        return retry(url.mirror)


class Client:
    def get(self, url):
        return self.cache.fetch(url) or retry(url)


from a.b import (
    one as two,
    three,
)
x = p.q.r
"""


def test_references(spark):
    files = spark.createDataFrame([("m.py", "Python", CALLS)], "file_id string, language string, content string")
    found = extract(files, ("Python",), references=True).cache()
    calls = {(r.names[0], r.callee) for r in R.calls_by_definition(found).collect()}
    assert calls == {
        ("fetch", "retry"), ("retry", "retry"), ("get", "fetch"), ("get", "retry"), ("Client", "fetch"), ("Client", "retry"),
    }
    pairs = {(r.origin, r.name) for r in R.imports(found).collect()}
    assert {("a.b", "one as two"), ("a.b", "three"), ("p", "q"), ("p.q", "r")} <= pairs
    edges = spark.createDataFrame(list(calls), "caller string, callee string")
    starts = spark.createDataFrame([(1, "fetch"), (2, "get"), (3, "none")], "term_id int, name string")
    got = sorted((r.term_id, r.step, r.name) for r in RC.single_callee_chains(edges, starts).collect())
    assert got == [(1, 0, "fetch"), (1, 1, "retry"), (2, 0, "get"), (3, 0, "none")]


def test_chain_counts_only_names_not_visited(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "d")], "caller string, callee string")
    starts = spark.createDataFrame([(1, "a")], "term_id int, name string")
    assert [r.name for r in RC.single_callee_chains(edges, starts).orderBy("step").collect()] == ["a", "b", "c", "d"]


def test_import_scores(spark):
    origins = spark.createDataFrame([("Python", "a.b.c"), ("Cython", "a.b.c")], "language string, origin string")
    paths = spark.createDataFrame([("x/a/b/c.py",), ("x/b/c",), ("x/d.py",)], "path string")
    exact = {(r.path, r.score) for r in R.import_scores(origins, paths).collect()}
    assert exact == {("x/b/c", 2)}
    loose = R.import_scores(origins, paths, "strip_ext")
    assert {(r.path, r.score) for r in loose.collect()} == {("x/b/c", 2), ("x/a/b/c.py", 3)}


def test_excerpts(spark):
    files = spark.createDataFrame([("f", "\n".join(f"r{i}" for i in range(12)))], "file_id string, content string")
    found = spark.createDataFrame([("f", 0, 2), ("f", 3, 4), ("f", 9, 11)], "file_id string, start_line int, end_line int")
    rows = formatted(excerpts(files, found, ["file_id"]), ["file_id"]).orderBy("line_no").collect()
    assert [(r.range_no, r.line_no) for r in rows] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 10), (2, 11)]
    assert rows[0].shown == "  1 | r0" and rows[-1].shown == " 11 | r10"


def test_one_look_up_at_a_time_equals_the_batch(spark, tmp_path):
    files = spark.createDataFrame([("m.py", "Python", CALLS), ("n.py", "Python", "retry = 1\n")], "file_id string, language string, content string")
    save_index(extract(files, ("Python",)), str(tmp_path / "index"))
    index = read_index(spark, str(tmp_path / "index"))
    words = ["fetch", "retry", "url", "absent"]
    terms = spark.createDataFrame([(w, w, False, False) for w in words], "term_id string, pattern string, ignore_case boolean, case_style boolean")
    batch = {tuple(r) for r in Q.hits(index, terms).select("term_id", "file_id", "start_line", "end_line").collect()}
    single = {(w, *r) for w in words for r in union_ranges(lookup_word(index, w), ["file_id"]).select("file_id", "start_line", "end_line").collect()}
    assert batch == single and batch


def test_complete(spark):
    names = spark.createDataFrame([("Alpha",), ("alpine",), ("beta",)], "name string")
    got = lambda *a: sorted(r.name for r in Q.complete(names, *a).collect())
    assert got("AL") == ["Alpha", "alpine"] and got("al", "NE") == ["alpine"] and got("") == []


def test_rules_load_and_hold(spark):
    rows = layers.rule_rows(spark)
    assert layers.problems(rows).count() == 0
    assert layers.duplicates(rows).count() == 0
    assert {r.language for r in rows.select("language").distinct().collect()} >= {"Python", "Cython", "JavaScript", "TypeScript", "TSX", "C", "GLSL", "C++", "Go", "Rust", "Lua", "Shell", "CSS", "Markdown", "TeX", "YAML"}


def test_user_rule_adds_definitions(spark):
    extra = RULES[0]._replace(languages=("Lua",), rule_id="lua_todo", kind="note", regex=r"^task\s+(\w+)", policy="LINE", start=False, needs="")
    rules = layers.compiled(layers.rule_rows(spark, [extra]))
    files = spark.createDataFrame([("a.lua", "Lua", "task clean\n")], "file_id string, language string, content string")
    assert [r.names for r in extract(files, ("Lua",), rules=rules).collect()] == [["clean"]]


def test_extends(spark):
    fields = spark.createDataFrame(
        [("base", "q", "B", "replace"), ("kid", "q", "K", "append"), ("hard", "q", "H", "replace"), ("a", "q", "x", "append"), ("b", "q", "y", "append"), ("lost", "q", "z", "append")],
        "language string, field string, value string, mode string",
    )
    extends = spark.createDataFrame([("kid", "base"), ("hard", "base"), ("a", "b"), ("b", "a"), ("lost", "nowhere")], "language string, extends string")
    got = {r.language: (r.value, r.status) for r in layers.extend(fields, extends).collect()}
    assert got == {"base": ("B", "ok"), "kid": ("BK", "ok"), "hard": ("H", "ok"), "a": (None, "cycle"), "b": (None, "cycle"), "lost": (None, "unknown_base")}


def test_huge_nesting_and_unbalanced_rows(spark):
    text = "x = (\n" * 50 + "def late():\n    pass\n"
    files = spark.createDataFrame([("deep.py", "Python", text), ("open.c", "C", "}\n}\nint a;\n{{{\nint b;\n")], "file_id string, language string, content string")
    names = {n for r in extract(files, ("Python", "C")).collect() for n in r.names}
    assert {"a", "b", "x"} <= names


def test_excerpts_of_many_terms_split_a_file_once(spark):
    files = spark.createDataFrame([("f", "a\nb\nc\nd\n"), ("g", "never hit\n")], "file_id string, content string")
    found = spark.createDataFrame([(1, "f", 0, 1), (1, "f", 3, 4), (2, "f", 1, 3)], "term_id int, file_id string, start_line int, end_line int")
    rows = excerpts(files, found, ["term_id", "file_id"]).orderBy("term_id", "line_no").collect()
    assert [(r.term_id, r.file_id, r.range_no, r.line_no, r.text) for r in rows] == [
        (1, "f", 1, 1, "a"), (1, "f", 2, 4, "d"), (2, "f", 1, 2, "b"), (2, "f", 1, 3, "c"),
    ]
