"""Marks that stand in two rows or more are kept by joins that can't make rows."""

from pyspark.sql import functions as F

from whereabouts.llm import line_dedup as LD


def test_standing_twice_only_filters(spark, monkeypatch):
    monkeypatch.setattr(LD, "LEAST_HEAVY", 3)
    monkeypatch.setattr(LD, "HEAVY", 1 << 40)
    rows = [(n, 0, 7) for n in range(50)] + [(n, 1, 100 + n // 2) for n in range(50)] + [(n, 2, 1000 + n) for n in range(50)]
    marks = spark.createDataFrame(rows, "n long, i int, mark long")
    kept = LD.standing_twice(marks, len(rows))
    assert sorted(map(tuple, kept.select("n", "i", "mark").collect())) == sorted(r for r in rows if r[1] < 2)
    assert set(kept.columns) == {"n", "i", "mark"}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join LeftOuter" not in plan and plan.count("Join Left") == 3
    assert kept.groupBy("mark").agg(F.count("*").alias("held")).where("held < 2").count() == 0
