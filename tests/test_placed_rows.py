"""Rows that were cut stay where they lie."""

from pyspark.sql import functions as F

from whereabouts.operators import recursion as RC
from whereabouts.operators import references as R
from whereabouts.plans import extraction as E
from whereabouts.session import cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_meet_definitions_without_a_shuffle(spark):
    files = spark.createDataFrame([(f"f{i}", "Python", f"class A_{i}:\n    def b_{i}(self):\n        c_{i}(d)\n        e(1)\n") for i in range(9)], "file_id string, language string, content string")
    rows = E.extract(files, ("Python",), references=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    placed, moved = cut(rows, placed=True), cut(rows)
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    assert "Exchange" not in _plan(R.calls_by_definition(placed))
    both = [sorted(map(str, R.calls_by_definition(x).collect())) for x in (rows, placed, moved)]
    assert both[0] == both[1] == both[2] and len(both[0]) == 36, len(both[0])


def test_callers_are_not_moved_by_a_round(spark):
    edges = spark.range(40).selectExpr("concat('a', id) AS caller", "concat('a', id + 1) AS callee").unionByName(spark.range(7).selectExpr("'x' AS caller", "concat('y', id) AS callee"))
    nodes = cut(RC.callers(edges), placed=True)
    front = spark.range(9).selectExpr("concat('a', id) AS name")
    plan = _plan(front.join(nodes.hint("merge"), front["name"] == nodes["caller"]))
    assert plan.count("Exchange") == 1, plan
    starts = spark.range(3).selectExpr("id AS term_id", "concat('a', id + 36) AS name").unionByName(spark.createDataFrame([(9, "x")], "term_id bigint, name string"))
    chains = {(r["term_id"], r["step"], r["name"]) for r in RC.single_callee_chains(edges, starts).collect()}
    assert chains == {(t, s, f"a{36 + t + s}") for t in range(3) for s in range(5 - t)} | {(9, 0, "x")}


def test_a_failing_cut_leaves_the_session_as_it_was(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        cut(spark.range(1).select(F.raise_error(F.lit("no"))), placed=True)
        raise RuntimeError("did not fail")
    except RuntimeError:
        raise
    except Exception:
        assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
