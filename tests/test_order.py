"""Places and running sums against plain loops."""

import random

from pyspark.sql import functions as F

from gleaner.operators import order


def test_places_and_sums_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(-5, 50)) for i in range(3000)]
    rows += [(-1, 1, 4)] * 40
    df = spark.createDataFrame(rows, "id long, k int, n int").repartition(7)
    out, total = order.in_order(df, [F.desc_nulls_last("k"), F.asc("id"), F.asc("n")], ["n"])
    assert total == len(rows)
    got = sorted(out.collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, len(rows) + 1))
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0], r[2]))
    before = 0
    for r, w in zip(got, want):
        assert (r.id, r.k, r.n, r.n_before) == (*w, before)
        before += w[2]


def test_no_rows_and_null_sums(spark):
    none = spark.createDataFrame([], "id long, n int")
    out, total = order.in_order(none, [F.asc("id")], ["n"])
    assert total == 0 and out.count() == 0 and out.columns == ["id", "n", "place", "n_before"]
    out, total = order.in_order(spark.createDataFrame([(1, None), (2, 3), (3, None)], "id long, n int"), [F.asc("id")], ["n"], "at")
    assert [(r["at"], r.n_before) for r in out.orderBy("id").collect()] == [(1, 0), (2, 0), (3, 3)]


def test_no_window_holds_the_whole_table(spark):
    out, _ = order.in_order(spark.range(1000).withColumn("n", F.lit(1)), [F.asc("id")], ["n"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
