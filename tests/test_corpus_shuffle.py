"""What a language corpus moves."""

import language_corpora as LC


def test_corpus_moves_rows_not_code(spark, tmp_path):
    """Equal keys, null keys and null values too; code is made behind the shuffle."""
    orders = [(1, "2-HIGH", "O"), (1, "1-URGENT", "F"), (70, None, "O"), (None, "3-LOW", "P"), (2, "3-LOW", "F")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = LC.corpus(spark, str(tmp_path), "Python", "{s}{k}|# {p}")
    assert {r["file_id"]: r["content"] for r in made.collect()} == {"0": "F1\n# 1-URGENT\nO1\n# 2-HIGH\nF2\n# 3-LOW", "1": "", None: ""}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = LC.corpus(spark, str(tmp_path), "Python", "{k}|{p}")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Exchange") == 1 and "replace(" not in plan[plan.index("Exchange") :]
