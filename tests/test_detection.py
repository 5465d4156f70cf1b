"""Languages by evidence, orders over whole tables, recipes."""

import json
import random

from pyspark.sql import functions as F

from whereabouts.operators import language as L
from whereabouts.operators.detection import keys_of, with_language
from whereabouts.operators.fragments import with_fragments
from whereabouts.operators.ordering import numbered, reading_order
from whereabouts.plans.extraction import extract
from whereabouts.sources.corpus import source_files


def by_hand(paths, origins, strip):
    """The reading order by one stable sort per origin."""
    def score(origin, path):
        parts = [p for p in (path.rsplit(".", 1)[0] if strip and "." in path.rsplit("/", 1)[-1] else path).split("/") if p]
        n = 0
        for a, b in zip(reversed(origin.split(".")), reversed(parts)):
            if a != b:
                break
            n += 1
        return n

    now = sorted(paths, key=lambda p: (p is not None, p or ""))
    for seen, (language, origin) in enumerate(origins):
        if (language, origin) not in origins[:seen]:
            now = sorted(now, key=lambda p: 0 if p is None or language != "Python" else -score(origin, p))
    return now


def test_reading_order(spark):
    rng = random.Random(7)
    part = lambda: rng.choice(["a", "b", "c", "utils"])
    for strip in (False, True):
        paths = sorted({"/".join(part() for _ in range(rng.randint(1, 4))) + (".py" if strip else "") for _ in range(80)}) + [None]
        origins = [(rng.choice(["Python", "Python", "Python", "Go"]), ".".join(part() for _ in range(rng.randint(1, 4)))) for _ in range(25)]
        table = spark.createDataFrame([(i, *o) for i, o in enumerate(origins)], "seq int, language string, origin string")
        got = reading_order(spark.createDataFrame([(p,) for p in paths], "path string"), table, "strip_ext" if strip else "exact").orderBy("position").collect()
        assert [r.path for r in got] == by_hand(paths, origins, strip) and [r.position for r in got] == list(range(len(paths)))


def test_reading_order_of_many_equal_names(spark):
    """Ten thousand files of one name: rows stay as many as endings, no list grows with them."""
    paths = spark.range(10_000).selectExpr("concat('pkg_', id, '/sub_', id % 10, '/utils.py') AS path")
    origins = spark.createDataFrame([(0, "Python", "pkg_77.sub_7.utils"), (1, "Python", "sub_3.utils"), (2, "Python", "utils"), (3, "Go", "pkg_1.sub_1.utils")], "seq int, language string, origin string")
    first = reading_order(paths, origins, "strip_ext").orderBy("position").limit(1002).collect()
    assert all("/sub_3/" in r.path for r in first[:1000]) and first[1000].path == "pkg_77/sub_7/utils.py" and first[1001].path == "pkg_1007/sub_7/utils.py"
    none = origins.where("seq > 2")
    assert reading_order(paths, none).where("position = 0").first().path == "pkg_0/sub_0/utils.py"


def test_numbered(spark):
    rows = spark.createDataFrame([(i % 7, None if i % 5 == 0 else i) for i in range(500)], "a int, b int").repartition(5)
    got = numbered(rows, F.col("a"), F.col("b").desc()).orderBy("position").collect()
    assert [r.position for r in got] == list(range(500)) and [r.a for r in got] == sorted(i % 7 for i in range(500))
    assert numbered(rows.limit(0), F.col("a")).count() == 0


def test_evidence(spark):
    rows = [
        ("a/x.java", None, "", "Java", "unsupported_language"), ("x.h", None, "#!/usr/bin/tcc -run\n", "C", "ok"), ("x.h", None, "", "C", "ok"), ("x.m", None, "", None, "ambiguous_language"),
        (None, None, "#!/usr/bin/env python3.11\n", "Python", "ok"), (None, "JS", "", "JavaScript", "ok"), (None, "go", "#!/bin/sh", "Go", "ok"), ("q.zz", None, "x", None, "unknown_language"), (None, None, "", None, "unknown_language"),
        ("SConstruct", None, "", "Python", "ok"), ("run", None, "#!/bin/bash", "Shell", "ok"), ("x.sage", None, "", "Sage", "ok"),
    ]
    files = spark.createDataFrame(rows, "path string, hint string, content string, want string, status string").withColumn("language", F.lit("old"))
    got = with_language(files, L.languages(spark), ("Python", "C", "JavaScript", "Go", "Shell", "Sage"))
    assert got.where("NOT (language <=> want) OR language_status <> status").collect() == []
    h = got.where("path = 'x.h' AND content <> ''").first()
    assert [(e.kind, e.key, len(e.candidates)) for e in h.evidence] == [("extension", "h", 3), ("interpreter", "tcc", 1)] and h.candidates == ["C"]


def test_language_table_from_storage(spark, tmp_path):
    row = {"language": "Zed", "group_language": "Python", "aliases": ["z"], "extensions": ["zed"], "filenames": [], "interpreters": ["zed"]}
    (tmp_path / "more.json").write_text(json.dumps(row))
    table = L.languages(spark).unionByName(L.read_languages(spark, str(tmp_path)))
    files = source_files(spark.createDataFrame([("a.zed", "x"), ("b.m", "y"), ("c.qq", "z"), ("d.java", "z"), ("e.py", "")], "path string, content string"), ruled=("Zed", "Python"), languages=table)
    assert {r.path: r.status for r in files.collect()} == {"a.zed": "ok", "b.m": "ambiguous_language", "c.qq": "unknown_language", "d.java": "unsupported_language", "e.py": "empty_input"}
    assert {r.key for r in keys_of(table).where("kind = 'hint' AND array_contains(candidates, 'Zed')").collect()} == {"zed", "z"}
    plain = source_files(spark.createDataFrame([("d.java", "z")], "path string, content string"), ruled=("Python",)).first()
    assert plain.status == "unsupported_language"


def test_recipes(spark):
    text = "# T\n~~~~md\n# U\n```python\nx = 1\n```\n~~~~\n"
    files = source_files(spark.createDataFrame([("a.md", text)], "path string, content string"))
    got = {r.depth: r.recipe for r in with_fragments(files.select("file_id", "language", "recipe", "content")).collect()}
    assert got == {0: ["cat a.md"], 1: ["cat a.md", "rows 2-6"], 2: ["cat a.md", "rows 2-6", "rows 4-5"]}
    assert extract(files, ("Markdown", "Python")).count() == 3
