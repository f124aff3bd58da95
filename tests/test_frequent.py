"""Frequent tokens of a row, without a shuffle of tokens."""

from pyspark.sql import functions as F

from gleaner.operators.frequent import frequent_tokens


def test_ties_order_and_plan(spark):
    rows = spark.createDataFrame([("a", 1, "z b b z c d e".split()), ("b", 1, []), ("c", 2, None), ("d", 3, ["x"])], "doc_id string, page_number int, ts array<string>")
    out = frequent_tokens(rows, ["doc_id", "page_number"], F.col("ts"), 4)
    assert sorted(map(tuple, out.collect())) == [("a", 1, ["z", "b", "c", "d"], "b"), ("d", 3, ["x"], "x")]


def test_phrases_of_pages_shuffle_no_tokens(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["tag15_distinctive_phrases"](spark, __spark_entry__.SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
