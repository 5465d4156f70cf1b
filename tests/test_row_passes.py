"""Fewer passes over rows, and names cut out by compiled code, with the same rows."""

from pyspark.sql import functions as F

from whereabouts.operators import definitions as D
from whereabouts.operators import structure as S
from whereabouts.plans import extraction as E
from whereabouts.rules.builtin import RULES

TEXTS = {
    "TSX": "// a\nlet x =\n  1\n\n  + 2;\n// b\nf(a,\n  // c\n  b)\n  .then(y =>\n\n  z);\nlet q = 1",
    "C": "int f(int a,\n  // b\n  int c)\n\n{\n  x = 1 +\n  // d\n    2;\n}\n// e\ntemplate <class T>\n// f\nint g;",
    "Python": "# a\n@b(1,\n  2)\n# c\n@d\ndef f(a,\n# e\n      b):\n    # g\n    x = 1 + \\\n        2\n\n    def h(): pass\n# i\ny = [\n1]",
    "YAML": "# a\na:\n  # b\n  - b: {c: 1,\n    d: 2}\n# e\ne: 1",
}


def _units(spark, language, content):
    rules = E._for_languages((language,), E.BUILTIN)
    units = spark.createDataFrame([("f", "", language, 0, content)], "file_id string, unit string, language string, start_line int, content string")
    return S.read_rows(S.masked_rows(units, rules.lexis), rules.lexis, rules.contexts), rules


def test_windows(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for language, windows in (("TSX", 5), ("C", 7), ("TeX", 5), ("Python", 7)):
            files = spark.createDataFrame([("f", language, "x = 1\n")], "file_id string, language string, content string")
            plan = E.extract(files, (language,))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Window [") <= windows, language
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _model(rows, indented):
    """Depth, statements and runs of attached rows, row by row."""
    code = [r for r in rows if r["is_code"]]
    follows = {r["line_no"]: n for r, n in zip(code, [*code[1:], None])}
    depth, carried, start, marked, stmt, before = 0, False, False, False, None, None
    run, said = None, []
    for r in rows:
        n = follows.get(r["line_no"])
        virtual = r["is_code"] and (r["goes_on"] or bool(n and n["picks_up"] and r["is_soft"]))
        base, start = depth - r["lead_close"], r["is_code"] and (depth <= 0 if indented else not carried)
        if start:
            marked, stmt = r["is_marker"], r["indent"]
        attach = r["attaches"] and (r["is_note"] or (r["is_code"] and marked))
        at = stmt if not start and depth > 0 else r["indent"]
        joins = bool(before and before[0] and (not indented or at == before[1]))
        above = run if joins else None
        if attach and not joins:
            run = r["line_no"]
        after = depth + r["opens"] - r["closes"] + virtual - (carried if r["is_code"] else 0)
        said.append((r["line_no"], depth, after, base, start, above))
        depth = after
        if r["is_code"]:
            carried = virtual
        if r["is_code"] or r["is_note"]:
            before = (attach, at)
    return said


def test_state_rows_go_by_a_plain_model(spark):
    inside, joined = 0, 0
    for language, content in TEXTS.items():
        read, rules = _units(spark, language, content)
        rows = sorted(read.collect(), key=lambda r: r["line_no"])
        want = _model(rows, language in ("Python", "YAML"))
        for lexis in (rules.lexis, None):
            got = S.state_rows(read, lexis).select("line_no", "depth_before", "depth_after", "base", "is_start", "attach_start").collect()
            assert sorted(map(tuple, got)) == want, language
        inside, joined = inside + sum(x[1] > 0 for x in want), joined + sum(x[5] is not None for x in want)
    assert inside > 10 and joined > 3, (inside, joined)


ROWS = [
    "", "x", "import a as b, c as d as b", "def f(a, b):", "class A: pass", "  async def é(x)", '"a b": 1,', " 'x' : 2", "type X[T] = int", "a: b", "  name;", "int x = 1, y;", "#define A(b) b", "typedef int t;",
    "struct S {", "enum E {", "} last;", "let a = 1, b = 2", "function f(a) {", "abstract area(): number;", "  ...rest,", 'ab: 1', '"ab": 1', "DEF X = 1", "cdef int x, y", "cpdef real mix(real left, int at):",
    "property w:", "for i from 0", "a = b = c", "key_1 = 2", "pub fn go() -> u32 {", "::again::", "greet() {", "\\section{Part}", ".card, #main {", "use a as b;", "macro_rules! m {",
]


def test_quick_names_are_the_names(spark):
    """What compiled code cuts out is what the general expression does."""
    rows = spark.createDataFrame([(x,) for x in ROWS], "masked string")
    quick = {r.rule_id: r for r in RULES if D.quick_names(r)}
    assert len(quick) > 40
    met = 0
    for some in [list(quick.values())[k : k + 12] for k in range(0, len(quick), 12)]:
        both = [F.expr(e).alias(f"{kind}{i}") for i, r in enumerate(some) for kind, e in (("quick", D.quick_names(r)), ("all", D.rule_names(r)))]
        for row in rows.select("masked", *both).collect():
            for i, r in enumerate(some):
                assert row[f"quick{i}"] == row[f"all{i}"], (r.rule_id, row["masked"])
                met += bool(row[f"all{i}"])
    assert met > 40


def test_patterns_read_for_quick_names():
    one = RULES[0]._replace(expand="", bare=False, transform="", group=1)
    quick = lambda regex: D.quick_names(one._replace(regex=regex))
    assert "extract_all" in quick(r"\bas\s+(\w+)") and "extract_all" not in quick(r"^\s*\"([^\"]*)\"") and "extract_all" in quick(r"[\[(]([\w$]++)")
    for regex in (r"x|([^a]*)", r"^a|^([^a]*)", r"(?i)(\w+)", r"^?([^a])", r"[a[(](\w+)", r"[]a](\w+)", r"(?<n>[^a])(\w+)", r"[a&&b](\w+)"):
        assert quick(regex) is None, regex
