"""Every rule of every language finds something in a registered query, and blocks keep their rows."""

import pytest
from pyspark.sql import functions as F

import language_corpora as LC
from whereabouts.operators.lookup import named
from whereabouts.operators.ranges import union_ranges
from whereabouts.plans.extraction import extract
from whereabouts.rules.builtin import RULES


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for query, (language, block, _) in LC.BLOCKS.items():
        text = block.replace("|", "\n").replace("~", "\\").replace("{k}", "65").replace("{p}", "5-LOW").replace("{s}", "O")
        rows.append((query, language, text))
    return extract(spark.createDataFrame(rows, "file_id string, language string, content string"), max_depth=1).cache()


def test_every_rule_fires(found):
    fired = {(r.language, r.rule_id) for r in found.select("language", "rule_id").distinct().collect()}
    assert {(x, r.rule_id) for r in RULES for x in r.languages if r.kind != "fragment"} - fired == set()


def test_blocks_hold_the_expected_names_alone(found):
    flat = named(found).select("file_id", "name", F.explode("ranges").alias("r")).select("file_id", "name", "r.*")
    got: dict = {}
    for r in union_ranges(flat, ["file_id", "name"]).collect():
        got.setdefault((r.file_id, r.name), []).append((r.start_line + 1, r.end_line))
    want = {(q, n.replace("{k}", "65")): sorted(rows) for q, (_, _, names) in LC.BLOCKS.items() for n, rows in names.items()}
    keyed = {k: sorted(v) for k, v in got.items() if k in want or k[1].endswith("_65")}
    assert keyed == want


def test_body_after_a_header_of_several_rows(spark):
    """It belongs to the header that its parenthesis closes, not to an older one of the same depth."""
    code = "function a() {\n  let b = 1;\n}\ncall(\n  1\n) {\n  let c = 1;\n}\nconst d = (\n  e,\n) => {\n  let f = 1;\n};\n"
    files = spark.createDataFrame([("f", "JavaScript", code)], "file_id string, language string, content string")
    rows = {(r.name, tuple(sorted(tuple(x) for x in r.ranges))) for r in named(extract(files, ("JavaScript",))).collect()}
    assert ("c", ((6, 7),)) in rows and ("b", ((0, 1), (1, 2))) in rows and ("f", ((8, 11), (11, 12))) in rows
