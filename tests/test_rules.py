"""Rule sets from rows: layers, extension, checks; levels without bounds."""

import json

import pytest
from pyspark.sql import functions as F

import rule_corpora as C
from whereabouts.operators.lookup import named
from whereabouts.plans.extraction import extract
from whereabouts.rules import layers
from whereabouts.rules.builtin import BUILTIN


def item(rule_id, regex="(x)", **more):
    return {"rule_id": rule_id, "kind": "block", "regex": regex, **more}


def user(spark, rows, bases=()):
    return C.rule_tables(spark, C.settings(*rows), [(1, "u", *b) for b in bases])


def test_built_in_rows_compile_to_the_built_in_rules(spark):
    found = layers.compiled_settings(*user(spark, [("u", "Nothing", "blocks", "replace", "bracket")]))
    flat = lambda rows: sorted((x, *r[1:]) for r in rows for x in r.languages)
    own = lambda rows: [r for r in flat(rows) if r[0] not in ("Cython", "TSX", "GLSL")]
    assert own(found.rules) == own(BUILTIN.rules) and own(found.contexts) == own(BUILTIN.contexts) and own(found.references) == own(BUILTIN.references)
    # built-in languages with a base state all that they use, so extension adds nothing
    assert flat(found.rules) == flat(BUILTIN.rules)
    each = lambda lexis: {x: s for names, s in lexis.items() for x in names}
    assert {k: v for k, v in each(found.lexis).items()} == each(BUILTIN.lexis)


def test_layers(spark):
    rows = [
        ("u", "Go", "definitions", "replace", item("first")), ("u", "Go", "definitions", "replace", item("second")),
        ("u", "Child", "definitions", "append", item("own")), ("u", "Child", "contexts", "replace", {"regex": "a", "show": "ROW"}), ("u", "Child", "comment", "append", "|b"),
        ("u", "Grandchild", "attach", "append", "c"), ("u", "Bare", "definitions", "replace", item("bare")),
    ]
    settings, bases = user(spark, rows[:-1], [("Child", "Go"), ("Grandchild", "Child"), ("Go", "Nowhere")])
    found = layers.compiled_settings(settings, bases)
    ids = lambda x: [r.rule_id for r in found.rules if x in r.languages]
    assert ids("Go") == ["first", "second"] and ids("Child") == ids("Grandchild") == ["first", "second", "own"]
    lexis = {x: s for names, s in found.lexis.items() for x in names}
    assert lexis["Child"].comment == lexis["Go"].comment + "|b" and lexis["Grandchild"].attach == (lexis["Go"].attach or "") + "c"
    assert [c.regex for c in found.contexts if "Grandchild" in c.languages] == ["a"]
    with pytest.raises(ValueError, match="Bare"):
        layers.compiled_settings(*user(spark, rows))
    with pytest.raises(ValueError, match="New"):
        extract(spark.createDataFrame([("f", "New", "x")], "file_id string, language string, content string"), None, BUILTIN._replace(rules=[BUILTIN.rules[0]._replace(languages=("New",))]))


def test_status(spark):
    rows = [
        ("u", "A", "definitions", "append", item("a", "(")), ("u", "B", "definitions", "append", item("b", policy="SOME")), ("u", "C", "contexts", "append", {"regex": "x", "show": "SIDE"}),
        ("u", "D", "blocks", "replace", "round"), ("u", "E", "colour", "replace", "red"), ("u", "F", "definitions", "append", item("f", "")), ("u", "G", "token", "append", "[x"),
        ("u", "H", "definitions", "append", item("h", gate="*")), ("u", "I", "definitions", "append", item("i", expand="wide")), ("u", "J", "definitions", "append", {"regex": "(x)"}), ("u", "K", "definitions", "replace", item("k")),
    ]
    status = layers.rule_status(*user(spark, rows, [(x, "Python") for x in "ABCDEFGHIJ"]))
    got = {r.language: (r.status, r.detail) for r in status.collect()}
    assert {x: got[x] for x in "ABCDEFGHIJK"} == {
        "A": ("bad_rule", "a: bad_pattern"), "B": ("bad_rule", "b: unknown_policy"), "C": ("bad_rule", "contexts: unknown_show"), "D": ("bad_rule", "blocks: unknown_value"),
        "E": ("bad_rule", "colour: unknown_field"), "F": ("bad_rule", "f: no_pattern"), "G": ("bad_rule", "token: bad_pattern"), "H": ("bad_rule", "h: bad_pattern"),
        "I": ("bad_rule", "i: unknown_expansion"), "J": ("bad_rule", "definitions: no_id_or_kind"), "K": ("no_lexis", ""),
    }
    assert all(s == ("ok", "") for x, s in got.items() if len(x) > 1)


def test_extension_is_one_plan(spark):
    """Chains of any length, cycles and missing bases, without a loop in the driver."""
    n = 40
    bases = spark.createDataFrame([(f"l{i}", f"l{i + 1}") for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "y"), ("w", "none")], "language string, extends string")
    known = spark.createDataFrame([(f"l{i}",) for i in range(n + 1)] + [(x,) for x in "xyzw"], "language string")
    got = layers.extension_chains(bases, known)
    assert "UnionLoop" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert {r.ancestor: r.depth for r in rows if r.language == "l0"} == {f"l{i}": i for i in range(n + 1)}
    assert {r.language: r.status for r in rows if r.status != "ok"} == {"x": "cycle", "y": "cycle", "z": "cycle", "w": "unknown_base"}


def test_group_serves_fragments_too(spark):
    text = "# T\n\n```sage\ndef f(a):\n    pass\n```\n"
    files = spark.createDataFrame([("m", "Markdown", text), ("s", "Sage", "def g():\n    pass\n")], "file_id string, language string, content string")
    rules = BUILTIN._replace(groups={"Sage": "Python", "Shell": "Python"})
    found = {(r.name, r.language) for r in named(extract(files, ("Markdown", "Python", "Sage"), rules)).collect()}
    assert ("f", "Python") in found and ("g", "Python") in found and ("T", "Markdown") in found


def rows_of(spark, language, content):
    files = spark.createDataFrame([("f", language, content)], "file_id string, language string, content string")
    return {(r.name, tuple(tuple(x) for x in r.ranges)) for r in named(extract(files, (language,))).collect()}


def test_levels_have_no_bounds(spark):
    """A wide indent and a deep bracket see what a narrow and a shallow one see."""
    python = "class A:\n{0}def f(self):\n{0}{0}def g(a):\n{0}{0}{0}x = 1\n"
    assert rows_of(spark, "Python", python.format(" " * 1200)) == rows_of(spark, "Python", python.format("    "))
    assert rows_of(spark, "Python", python.format("\t" * 400)) == rows_of(spark, "Python", python.format("    "))
    nested = lambda n: "(\n" * n + "function f(a) {\n  let b = 1;\n}\n" + ")\n" * n
    moved = lambda rows, by: {(n, tuple((a - by, b - by) for a, b in r)) for n, r in rows}
    assert moved(rows_of(spark, "JavaScript", nested(3000)), 3000) == moved(rows_of(spark, "JavaScript", nested(3)), 3)


def test_words_in_literals_close_nothing(spark):
    code = 'function run()\n  say("the end", \'do\')\n  local a = "end"\nend\nlocal b = 1\n'
    assert {r[0]: r[1] for r in rows_of(spark, "Lua", code)}["run"] == ((0, 4),)


def test_settings_are_rows(spark):
    rows = layers.settings_of(spark, BUILTIN)
    one = rows.where("language = 'Go' AND field = 'definitions'").orderBy("seq").first()
    assert json.loads(one["item"])["rule_id"] == "go_type" and rows.where(F.col("item").isNull()).count() == 0
