"""Rows shown for names of all languages, in one extraction."""

import pytest
from pyspark.sql import functions as F

from golden import CASES
from whereabouts.operators import lookup as Q
from whereabouts.operators.ranges import union_ranges
from whereabouts.plans.extraction import extract


@pytest.fixture(scope="module")
def shown(spark):
    rows = [(language, language, source) for language, (source, _) in CASES.items()]
    files = spark.createDataFrame(rows, "file_id string, language string, content string")
    index = Q.named(extract(files))
    flat = index.select("file_id", "name", F.explode("ranges").alias("r")).select("file_id", "name", "r.*")
    out = {}
    for r in union_ranges(flat, ["file_id", "name"]).collect():
        out.setdefault((r.file_id, r.name), []).append((r.start_line + 1, r.end_line))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("language,name", [(x, n) for x, (_, names) in CASES.items() for n in names])
def test_rows(shown, language, name):
    assert shown.get((language, name), []) == CASES[language][1][name]
