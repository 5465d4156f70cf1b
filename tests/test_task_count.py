"""Tasks of an extraction go by the volume of its contents."""

from pyspark.sql import functions as F

from whereabouts.plans import extraction as E


def _files(spark, rows):
    """Files that a shuffle on their id has put together, as corpora are."""
    parts = spark.range(rows).selectExpr("CAST(id % 200 AS string) AS file_id", "'Python' AS language", "concat('def f_', id, '():\n    pass\n') AS part")
    return parts.groupBy("file_id", "language").agg(F.array_join(F.sort_array(F.collect_list("part")), "").alias("content"))


def test_task_count_grows_with_contents(spark, monkeypatch):
    monkeypatch.setattr(E, "CHARS", 1000)
    few, many = E.task_count(_files(spark, 1000)), E.task_count(_files(spark, 4000))
    assert few >= 20 and many >= 3.9 * few
    assert E.task_count(spark.createDataFrame([], "file_id string, language string, content string")) > 0


def test_units_stay_in_their_tasks(spark, monkeypatch):
    """The shuffle on file_id is kept beside the one that grouped the files, so its partitions are not coalesced."""
    files = _files(spark, 1000)
    assert E.task_count(files) != int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(E, "CHARS", 1000)
    assert E.units_of(files, ("Python",)).rdd.getNumPartitions() == E.task_count(files)
    assert E.extract(files, ("Python",)).select(F.explode("names")).distinct().count() == 1000
