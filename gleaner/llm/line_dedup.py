"""Repeated lines across documents, with DataFrame functions only: levelled sorted runs of line hashes.

Lines that are long enough go, as 128-bit hashes with the place they stand at, to a table in batches.  Each
batch is summed to one row a hash and merge-anti-joins the runs written so far: hashes that a run has settled
(enough rows, two documents, and an id at least as large as the batch's) need no further row and are left out.  The
rest is added as a run of its own.  Runs are bucketed and sorted by hash, so those joins move no row of a run; two
runs of a level are merged into one of the next, so there are few.

A run counts rows, not documents, so what it calls repeated is a superset: lines of the settled hashes are then
joined back, their documents counted exactly, and the places to drop gathered by document.  Only those rows of the
repeated lines travel there; Spark splits the join where one line is in a large share of all documents.

Null and empty texts are one empty line.  All rows with a null id count as one document, smaller than any id.  Repeated rows
count as one document and lose and keep the same lines.  An empty table gives no rows; further columns stay, whatever
their names.  Nothing here grows with a text but the arrays of its own lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, dropped, first_free, shared_dir

LEAST_CHARS, LEAST_DOCS, BATCHES = 20, 3, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def folded(text: Column) -> Column:
    """``text`` with A-Z in lower case; what is not ASCII stays."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_mark(text: Column) -> Column:
    """With the id, what tells a row's text from other texts of the same id."""
    return F.xxhash64(text)


def line_rows(docs: DataFrame, text_column: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(id, mark, pos, h1, h2)`` of every line whose key is long enough."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    arrays = docs.select(F.col("doc_id").alias("id"), row_mark(text).alias("mark"), F.split(folded(text), "\n", -1).alias("lines"))
    lines = arrays.select("id", "mark", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("id", "mark", "pos", F.trim("line", F.lit(BLANK)).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class SortedRuns:
    """Runs of ``(h1, h2, n, low, top, unnamed)``, at most one a level once a batch has been added.

    A run is a table bucketed and sorted by hash in the shared folder; the session's catalog knows it until it is merged
    or ``close`` is called.
    """

    def __init__(self, folder: str, docs: DataFrame, least: int):
        self.spark, self.folder, self.least = docs.sparkSession, folder, least
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.serial, self.levels = f"gleaner_runs_{uuid.uuid4().hex}", 0, {}

    def _written(self, rows: DataFrame) -> str:
        self.serial += 1
        name = f"{self.name}_{self.serial}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _gone(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        dropped(self.spark, f"{self.folder}/{name}")

    def settled(self, rows: DataFrame) -> DataFrame:
        two = (F.col("low") < F.col("top")) | (F.col("unnamed") & F.col("top").isNotNull())
        return rows.where((F.col("n") >= self.least) & two)

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch that some run does not make superfluous."""
        for name in self.levels.values():
            run = self.settled(self.spark.table(name)).select(*[F.col(k).alias(f"run_{k}") for k in KEY], F.col("top").alias("run_top"))
            same = [F.col(k) == F.col(f"run_{k}") for k in KEY]
            batch = batch.join(run.hint("merge"), [*same, F.col("run_top") >= F.coalesce("top", "run_top")], "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """A new batch of line rows: what the runs have not settled becomes a run, and full levels are merged."""
        batch = lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("top"), F.bool_or(F.col("id").isNull()).alias("unnamed"))
        new, level = self._written(self.unsettled(batch)), 0
        while level in self.levels:
            old = self.levels.pop(level)
            merged = self._written(self.merged(self.spark.table(old), self.spark.table(new)))
            self._gone(old)
            self._gone(new)
            new, level = merged, level + 1
        self.levels[level] = new

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, by a merge of both in the order they are stored in."""
        b = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
        both = a.join(b, [F.col(k) == F.col(f"b_{k}") for k in KEY], "full_outer")
        zero = F.lit(0)
        return both.select(
            *[F.coalesce(k, f"b_{k}").alias(k) for k in KEY],
            (F.coalesce("n", zero) + F.coalesce("b_n", zero)).alias("n"),
            F.least("low", "b_low").alias("low"),
            F.greatest("top", "b_top").alias("top"),
            (F.coalesce("unnamed", F.lit(False)) | F.coalesce("b_unnamed", F.lit(False))).alias("unnamed"),
        )

    def repeated(self) -> DataFrame:
        """``(h1, h2, top)`` of every settled hash of all runs together."""
        runs = [self.spark.table(self.levels[level]) for level in sorted(self.levels)]
        whole = runs[0]
        for run in runs[1:]:
            whole = self.merged(whole, run)
        return self.settled(whole).select(*KEY, "top")

    def close(self) -> None:
        for name in self.levels.values():
            self._gone(name)
        self.levels = {}


def dropped_places(docs: DataFrame, text_column: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, n_batches: int = BATCHES) -> DataFrame:
    """``(id, mark, places)``: the lines, from 0, that each document with any loses."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = line_rows(docs, text_column, least_chars)
    # a batch is a part of the input's partitions, so that each task writes to one
    path = f"{folder}/lines"
    rows.withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(n_batches))).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, batch int").parquet(path)
    runs = SortedRuns(folder, docs, least_docs)
    for b in range(n_batches):
        runs.add(lines.where(F.col("batch") == b))
    repeated = cut(runs.repeated(), folder, "repeated")
    runs.close()
    held = cut(lines.drop("batch").join(repeated, KEY), folder, "held")
    dropped(spark, path)
    counted = held.groupBy(*KEY).agg((F.countDistinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"))
    # a table of its own, as Spark splits a hot key in a join only where both sides come straight from a shuffle
    sure = cut(counted.where(F.col("docs") >= least_docs).select(*KEY), folder, "sure")
    lost = held.where(F.col("id").isNull() | (F.col("id") != F.col("top"))).join(sure, KEY)
    out = cut(lost.groupBy("id", "mark").agg(F.collect_set("pos").alias("places")), folder, "places")
    for name in ("repeated", "held", "sure"):
        dropped(spark, f"{folder}/{name}")
    return out


def drop_repeated_lines(docs: DataFrame, text_column: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **bounds: int) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_column``, and how many lines each had and lost."""
    places = dropped_places(docs, text_column, **bounds)
    own = {c: first_free(docs.columns, f"places_{c}") for c in places.columns}
    places = places.select(*[F.col(c).alias(name) for c, name in own.items()])
    text = F.coalesce(F.col(text_column), F.lit(""))
    joined = docs.join(places, F.col("doc_id").eqNullSafe(F.col(own["id"])) & (row_mark(text) == F.col(own["mark"])), "left")
    lines, gone = F.split(text, "\n", -1), F.col(own["places"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    others = [kept.alias(c) if c == text_column else F.col(c) for c in docs.columns]
    return joined.select(*others, F.size(lines).cast("bigint").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(n_dropped))
