"""Line dedup against a plain version, and what the runs hold."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import line_dedup

BLANK = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least_chars=20, least_docs=3):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                held[key_of(line)].add(i)
    gone = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in gone or (i is not None and gone[key_of(x)] == i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(9)
    pool = [f"this is line number {i} of all" for i in range(30)] + ["  THIS is Line number 3 of all\t", "short line", "", "Été Straße ÄÖÜ is a line İK", "ÉTÉ Straße ÄÖÜ is a line İK", "x" * 19, "y" * 20, "\x0b" + "y" * 20 + "\r", " " + "y" * 20]
    rows = [(i, "\n".join(rng.choices(pool if i % 3 else pool[:4], k=rng.choice([1, 2, 5])) + [f"only in {i} and nowhere else"] * (i % 2))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n" + pool[0] + "\n"), (104, "w" * 300_000), (105, "\n".join(["a line many times over here"] * 20_000))]
    rows += [rows[5]] * 4 + [(6, rows[7][1]), (None, pool[0] + "\n" + pool[1]), (None, pool[0] + "\n" + pool[1]), (None, "null only line, three times"), (None, "null only line, three times\nz"), (None, "null only line, three times")]
    rows += [(200, "in two ids and null rows"), (201, "in two ids and null rows"), (None, "in two ids and null rows"), (202, "one id and null rows alone"), (None, "one id and null rows alone"), (202, "repeated id, twice a line"), (202, "repeated id, twice a line"), (203, "repeated id, twice a line")]
    rng.shuffle(rows)
    return rows


def got(frame):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("parts, batches", [(1, 1), (9, 4), (7, 5)])
def test_lines_equal_a_plain_version(spark, parts, batches):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS id", "2 AS places_id", "3 AS h1", "4 AS pos", "5 AS top")
    out = line_dedup.drop_repeated_lines(df, n_batches=batches)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert got(out) == brute(rows)


def test_other_bounds_and_ids(spark):
    rows = made()
    df = spark.createDataFrame([(None if i is None else f"{i:04d}", t) for i, t in rows], "doc_id string, text string").repartition(6)
    want = [(None if i is None else f"{i:04d}", *rest) for i, *rest in brute(rows, 5, 2)]
    assert got(line_dedup.drop_repeated_lines(df, least_chars=5, least_docs=2)) == sorted(want, key=repr)


def test_empty_table_and_tables_left(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gleaner_runs")]


def test_runs_stay_few_and_leave_out_settled_hashes(spark, tmp_path):
    lines = lambda ids: spark.createDataFrame([(i, 7, 8) for i in ids], "id long, h1 long, h2 long")
    runs = line_dedup.SortedRuns(str(tmp_path), lines([1]), 3)
    sizes = []
    for ids in ([50, 40, 30], [20, 10], [60], [5], [6], [60, 60]):
        sizes.append(runs.unsettled(lines(ids).groupBy("h1", "h2").agg(F.max("id").alias("top"))).count())
        runs.add(lines(ids))
    assert sizes == [1, 0, 1, 0, 0, 0] and sorted(runs.levels) == [1, 2]
    assert [tuple(r) for r in runs.repeated().collect()] == [(7, 8, 60)]
    runs.close()


def test_runs_are_joined_without_a_shuffle(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.xxhash64("id").alias("h1"), (F.col("id") % 900).alias("h2"))
    runs = line_dedup.SortedRuns(str(tmp_path), rows, 3)
    for b in range(3):
        runs.add(rows.where(F.col("id") % 3 == b))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.repeated()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.close()
