"""Batches of patterns and recursive look-ups against plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from whereabouts.operators import lookup as Q
from whereabouts.operators import recursion as RC

NAMES = [
    "order_1", "order_12", "Order_1", "ORDER_X", "orders", "order", "or", "a", "", "part_9", "pärt_9", "PÄRT_9", "ſize", "size", "SIZE", "Key", "key", "ıd_x", "id_x", "İd_x", "x.y.z", "a|b",
    "aab", "aaab", "abab", "foo(bar)", "foo[1]", "foo\\d", "tail\n", "Straße", "STRASSE", "οδος", "ΟΔΟΣ", "日本語名", "a{2}b", "under_score_name", "camelCaseName",
]
PATTERNS = [
    "order_[0-9]+", "order_1?2", "ord(er|ers)", "(order|part)_9", "part_.|order_12", "a+b", "aa?ab", "(?:ab){2}", "(ab)*", ".*", "", "x\\.y\\.z", "a\\|b", "foo\\(bar\\)", "foo\\[1]", "foo\\\\d", "\\Qfoo[1]\\E",
    "[a-z]+_[a-z]+_name", "[^a]rder", "[\\]a]b", "[a[b]]aab", "under_(score|case)_(name)+", "\\w+CaseName", "\\bkey\\b", "(?i)order_x", "p.rt_9", "日本.名", "order_(1|(2|3))?", "(?<n>key)", "\\x6bey", "key{1}", "siz{0,1}e",
    "straße", "οδο.", "ba[r", "(un", "x{", "*a", "order_1|", "|order_12", "order_1++", "under.*?name", "und\\S+name", "id_x", "size|none", "order_\\d+$", "^order$", "tail", "a{2}b", "a\\{2}b", "o.d.r", "ord(?=ers)ers",
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def test_pattern_batch(spark, names):
    """The index leads to what each pattern matches on its own."""
    rows = [(f"{i}{p}", p, bool(i), False) for p in PATTERNS for i in (0, 1)]
    ready = Q.prepared_terms(spark.createDataFrame(rows, "term_id string, pattern string, ignore_case boolean, case_style boolean"))
    got = {(r.term_id, r.name) for r in Q.matching_names(names, ready).collect()}
    bad = {r.asked for r in ready.where("status = 'bad_pattern'").collect()}
    assert bad == {"ba[r", "(un", "x{", "*a"}
    want = set()
    for term, pattern, case, _ in rows:
        if pattern in bad or re.fullmatch(r"[A-Za-z0-9_-]+", pattern):
            continue
        tried = names.where(F.col("name").rlike(("(?iu)" if case else "") + "^(" + pattern + r")\z")).collect()
        want |= {(term, r.name) for r in tried}
    words = {t for t, p, *_ in rows if re.fullmatch(r"[A-Za-z0-9_-]+", p)}
    assert {x for x in got if x[0] not in words} == want and len(want) > 60


def test_required_literals(spark):
    rows = [("order_[0-9]+", ["order_"]), ("a(bc|de)fgh|ijk.lmno", ["fgh", "lmno"]), ("ab.*", None), ("(abc)+", None), ("abc?def", ["def"]), ("\\Qabc\\E", None), ("[abc]xyz", ["xyz"]), ("ABC_d", ["abc_d"])]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string").withColumn("got", Q.required_literals(F.col("p"), F.lit(False)))
    assert {r.p: r.got for r in df.collect()} == dict(rows)


def test_many_patterns(spark):
    """Thousands of patterns of their own are no part of the plan."""
    terms = spark.range(3000).selectExpr("id AS term_id", "concat('name_', id, '(_x)?') AS pattern", "false AS ignore_case", "false AS case_style")
    many = spark.range(4000).selectExpr("concat('name_', id, IF(id % 2 = 0, '_x', '')) AS name")
    found = Q.matching_names(many, Q.prepared_terms(terms))
    assert found.count() == 3000 and "name_17" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_null_terms(spark, names):
    rows = [(1, None, False, False), (2, "order_1", None, None), (3, None, True, True), (4, "order_.", None, False)]
    ready = Q.prepared_terms(spark.createDataFrame(rows, "term_id int, pattern string, ignore_case boolean, case_style boolean"))
    assert {r.term_id: r.status for r in ready.collect()} == {1: "no_pattern", 2: "ok", 3: "no_pattern", 4: "ok"}
    assert sorted((r.term_id, r.name) for r in Q.matching_names(names, ready).collect()) == [(2, "order_1"), (4, "order_1")]


def walked(edges, terms):
    """Rounds of each (id, pattern, ignore_case): lists of names."""
    called = {}
    for a, b in edges:
        called.setdefault(a, set()).add(b)
    out = []
    for term, pattern, case in terms:
        tests = [re.compile(f"(?:{pattern})\\Z", re.I if case else 0)]
        now, number = [a for a in {x for e in edges for x in e} if tests[0].match(a)], 1
        while now:
            out += [(term, number, n) for n in now]
            left = {c for n in now for c in called.get(n, ()) if not any(t.match(c) for t in tests)}
            now, number = (list(left), number + 1) if len(left) == 1 else ([], 0)
            tests += [re.compile(re.escape(n) + "\\Z") for n in now]
    return sorted(out)


def test_recursive_lookup(spark, monkeypatch):
    """Against a walk in memory, callers of many names among them."""
    monkeypatch.setattr(RC, "HELD", 3)
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(120)] + ["N5", "N6"]
    edges = {(a, rng.choice(nodes)) for a in nodes for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 2]))}
    edges |= {("n3", f"n{i}") for i in range(20, 60)} | {("n4", f"n{i}") for i in range(10, 20)} | {("n4", "n7")}
    edges |= {("hub", f"leaf{i}") for i in range(10)} | {("hub", "n7")}
    terms = [(n, n, False) for n in nodes] + [("r1", "leaf[0-9]|hub", False), ("r0", "hub", False), ("r2", "n[2-5][0-9]|n3", False), ("r3", "n5|n6", True), ("r4", ".*", False), ("r5", "none", False)]
    terms += [(f"x{i}", f"n{i}|n{i + 1}", bool(i % 2)) for i in range(100)]
    table = spark.createDataFrame([(t, p, c, False) for t, p, c in terms], "term_id string, pattern string, ignore_case boolean, case_style boolean")
    index = spark.createDataFrame([(n, n) for n in sorted({x for e in edges for x in e})], "name string, file_id string").withColumn("ranges", F.expr("array(struct(1 AS start_line, 2 AS end_line))"))
    calls = spark.createDataFrame([([a], b) for a, b in edges], "names array<string>, callee string")
    got = RC.recursive_lookup(index, RC.call_edges(calls), table).collect()
    want = walked(edges, terms)
    assert sorted((r.term_id, r.round, r.file_id) for r in got) == want
    assert max(r[1] for r in want) > 4 and {r[1] for r in want if r[0] == "r1"} >= {1, 2}


def test_scope_of_rounds(spark):
    """With in-memory input, round one sees it alone, and goes on from its calls."""
    index = spark.createDataFrame([("go", None, True), ("go", "other", False), ("help", "lib", False)], "name string, file_id string, first boolean")
    index = index.withColumn("ranges", F.expr("array(struct(1 AS start_line, 2 AS end_line))"))
    calls = spark.createDataFrame([(["go"], "help", None), (["go"], "stop", "other")], "names array<string>, callee string, file_id string")
    term = spark.createDataFrame([(1, "go", False, False)], "term_id int, pattern string, ignore_case boolean, case_style boolean")
    scoped = RC.recursive_lookup(index, RC.call_edges(calls, F.col("file_id").isNull()), term).collect()
    assert sorted((r.round, r.file_id or "") for r in scoped) == [(1, ""), (2, "lib")]
    everything = RC.recursive_lookup(index.drop("first"), RC.call_edges(calls), term).collect()
    assert sorted((r.round, r.file_id or "") for r in everything) == [(1, ""), (1, "other")]


def test_literals_of_whole_groups(spark):
    """A group that is all of an alternative is looked into, so its pattern is not tried on every name."""
    rows = [("(ORDER_1|Part_2)", ["order_1", "part_2"]), ("(?:abc|(def|ghi))", ["abc", "def", "ghi"]), ("xyz|((abc))", ["xyz", "abc"]), ("(abc|de)", None), ("(abc|)", None), ("((abc))?", None), ("(abc)def", ["def"])]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string").withColumn("got", Q.required_literals(F.col("p"), F.lit(True)))
    assert {r.p: r.got for r in df.collect()} == dict(rows)


def test_long_literals_lead_to_few_names(spark):
    """A literal goes by the longest run that names are indexed by, so few names are tried for each of many patterns."""
    ids = spark.range(1000, 4000)
    names = ids.selectExpr("concat('order_', id) AS name")
    terms = ids.selectExpr("id AS term_id", "concat('(ORDER_', id, '|part_', id, ')[05]?') AS pattern", "true AS ignore_case", "false AS case_style")
    assert Q.matching_names(names, Q.prepared_terms(terms)).count() == 3000
    longest = ids.limit(1).select(Q._longest_grams(F.lit("order_1234")).alias("g")).first()["g"]
    assert longest == ["order_12", "rder_123", "der_1234"]


def test_many_terms_are_not_broadcast(spark):
    """A large table of terms is shuffled; none of it goes through the driver."""
    many = spark.range(Q.FEW + 1).selectExpr("id AS term_id", "concat('name_', id) AS pattern", "false AS ignore_case", "false AS case_style")
    names = spark.range(50).selectExpr("concat('name_', id) AS name")
    found = Q.matching_names(names, Q.prepared_terms(many))
    assert found.count() == 50 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
