"""What a row costs: what is compiled, and what is spared rows that can't answer."""

from whereabouts.functions import text as T
from whereabouts.operators import definitions as D
from whereabouts.operators import structure as S
from whereabouts.operators.ranges import union_ranges
from whereabouts.plans import extraction as E
from whereabouts.rules.builtin import LEXIS, RULES

ODD = ["", " ", "x = 1;", "x =", "x == ", "x = ", "a;\r", "b &&  ", "c =>", "c >=", "d |", "e ||\t", "f é", "g = é", "h,\u0085", "i ? ", "word", "band", "x and", "y or ", "z..", "\\", "\\ ", "k {", "l+", "m.", "n;\x0b", "&", "="]


def test_last_character_spares_no_match(spark):
    rows = spark.createDataFrame([(x, x[-1:]) for x in ODD], "masked string, last_char string")
    patterns = {x.continues for x in LEXIS.values() if x.continues} | {x.attach for x in LEXIS.values() if x.attach} | {r"[;{},:]\s*$", r"(?:ab?|c)\s*$", r"(?:\w+)\s*$", r"(?:a|[+.])\s*$"}
    for pattern in patterns:
        found = rows.selectExpr("masked", f"{S._matches_end(pattern)} AS quick", f"{S._matches(pattern)} AS whole").where("quick <> whole").collect()
        assert found == [], pattern
    assert S.last_chars(r"(?:ab?|c)\s*$") is None or set("abc") <= set(S.last_chars(r"(?:ab?|c)\s*$"))
    assert S.last_chars(r"(?:\w+)\s*$") is None


def test_events_are_compiled(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for language in ("Python", "TSX", "TeX"):
            files = spark.createDataFrame([("f", language, "x = 1\n")], "file_id string, language string, content string")
            plan = E.extract(files, (language,))._jdf.queryExecution().executedPlan().toString()
            lines = [line.strip(" :+-") for line in plan.splitlines() if "Generate inline(" in line]
            assert lines and all(line.startswith("*(") for line in lines), lines
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_bare_rules_are_tested(spark):
    """A rule on the row without its brackets asks the pattern first where the row has none."""
    rule = next(r for r in RULES if r.rule_id == "js_param")
    rows = ["limit = 5;", "function f(a, b) {", "x = function (a = [1], b) {", "function f(a = g(1), b)", "call(a)"]
    tested = spark.createDataFrame([(x,) for x in rows], "masked string").selectExpr("masked", f"{D.rule_test(rule)} AS test", f"size({D.rule_names(rule)}) > 0 AS named").collect()
    assert not tested[0]["test"] and not tested[4]["test"]
    assert [r["named"] for r in tested] == [False, True, True, True, False]
    assert all(r["test"] for r in tested if r["named"])


def test_masks_stay_short(spark):
    """Each mask has few rules, whatever their number, and all that pass are found."""
    rules = [r for r in RULES if "Python" in r.languages]
    assert len(rules) > 16
    rows = spark.createDataFrame([("a = 1", "Python", True, 0, True, False, 0, 0)], "masked string, language string, is_code boolean, base int, is_start boolean, underlined boolean, line_no int, first_line int")
    tested = D.with_definitions(rows, rules * 2, None)
    found = tested.first()["found"]
    assert [d["names"] for d in found] == [["a"], ["a"]]
    assert max(plan.count("RLIKE") for plan in D.masks_of(rules * 2)[0]) <= 2 * D.TESTS


def _plan(spark, files, languages):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return E.extract(files, languages)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_passes_over_rows(spark):
    """Rows are passed over as often as the languages at hand ask for, and what lies around them is gathered by one sort."""
    for language, sorts, windows in (("TSX", 3, 6), ("C", 3, 8), ("TeX", 3, 6), ("Python", 3, 9)):
        files = spark.createDataFrame([("f", language, "x = 1\n")], "file_id string, language string, content string")
        plan = _plan(spark, files, (language,))
        assert plan.count("ObjectHashAggregate") == 0, language
        assert (plan.count("Sort ["), plan.count("Window [")) <= (sorts, windows), language


def test_passes_change_no_rows(spark):
    """What is left out for the languages at hand is what they don't have."""
    text = {
        "TSX": "// a\n\n// b\nfunction f(a,\n  b) {\n  // c\n  let x =\n    1;\n  /* d */\n}\n// e",
        "C": "// a\ntemplate <class T>\n// b\nint f(int a,\n  int b)\n{\n  // c\n  x = 1;\n}\n// d\n\ntemplate <class U>\nint g;",
        "TeX": "% a\n\\section{b}\n% c\ntext \\label{d}\n\\begin{e}\n% f\n\\end{e}\n",
        "Python": "# a\n@b\ndef f(a,\n      b):\n    # c\n    x = 1\n    def g(): pass\n\n# d\ny = 2",
        "YAML": "# a\na:\n  # b\n  - b: {c: 1,\n    d: 2}\ne: 1",
    }
    for language, content in text.items():
        rules = E._for_languages((language,), E.BUILTIN)
        units = spark.createDataFrame([("f", "", language, 0, content)], "file_id string, unit string, language string, start_line int, content string")
        read = S.read_rows(S.masked_rows(units, rules.lexis), rules.lexis, rules.contexts)
        asked = ["line_no", "depth_before", "depth_after", "base", "dip_to", "is_start", "attach_start", "marker_start", "shown_levels", "prev_code", "last_line", "after_matter", "underlined"]
        if language in ("Python", "YAML"):
            asked += ["stmt_indent", "prev_indent", "levels", "logical_end"]
        short, long = (sorted(x.select(*asked).collect(), key=lambda r: r["line_no"]) for x in (S.state_rows(read, rules.lexis), S.state_rows(read)))
        assert short == long and len(short) > 3, language


def test_brackets_are_counted_by_bytes(spark):
    chars = "([{" + T.TEXT_OPEN
    rows = ["", "a", "([{", "f(a)[b]{", "é(ü)", T.TEXT_OPEN, f"({T.TEXT_OPEN}é{T.TEXT_OPEN}(", "x" * 50 + "{", None]
    counted = spark.createDataFrame([(x,) for x in rows], "masked string").selectExpr("masked", f"{S._count(chars)} AS n").collect()
    assert [r["n"] for r in counted[:-1]] == [sum(c in chars for c in x) for x in rows[:-1]]
    assert "translate" not in S._count(chars)


def test_plain_names_are_not_taken_apart(spark):
    """A text without the characters that an expansion goes by is one name, as the whole expansion has it."""
    texts = ["a", "a.b", "(a, b)", "a b", "*a", "this->b", "a.prototype.c", "x['k']", "a[0]", "(a", "a)", " a ", "", "é", "#a", "a\u00a0b", "a>b"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    for expand, chars in (("target", ",.([)]"), ("member", ".>*")):
        short = D.EXPANSIONS[expand].replace("{names}", "array(x)")
        guard = " OR ".join(f"contains(x, '{c}')" for c in chars)
        assert guard in short
        long = short.replace(guard, "true")
        distinct = "array_distinct(filter(transform({}, y -> trim(y)), y -> y <> ''))"
        assert rows.where(f"{distinct.format(short)} <> {distinct.format(long)}").collect() == [], expand


def test_placed_ranges(spark):
    ranges = [("f", "a", 0, 1), ("f", "a", 0, 5), ("f", "a", 2, 3), ("f", "a", 5, 6), ("f", "a", 8, 9), ("f", "b", 8, 9), ("f", "b", 8, 9), (None, "b", 1, 2), (None, "b", 4, 9), (None, "b", 5, 6), ("g", None, 3, 4)]
    df = spark.createDataFrame(ranges, "file_id string, name string, start_line int, end_line int").repartition(2, "file_id")
    for gap in (0, 1, 2):
        got, want = (sorted(map(str, union_ranges(df, ["file_id", "name"], gap, placed).collect())) for placed in (True, False))
        assert got == want
    assert "HashAggregate" not in union_ranges(df, ["file_id", "name"], placed=True)._jdf.queryExecution().executedPlan().toString()
