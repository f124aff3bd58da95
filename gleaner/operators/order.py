"""Places and running sums over a whole ordered table, without a window that holds all of it.

The rows are dealt out by ranges of the order and sorted within them.  What a range holds is summed
once for each range; those sums, one row for each partition, are all that the driver sees.  Adding the
sums of the ranges before turns places and sums within a range into those of the table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.session import shared_folder

#: monotonically_increasing_id() has the partition above this bit and the row's number below it.
PART_BIT = 33


def in_order(rows: DataFrame, order: list[Column], sums: list[str] | None = None, place: str = "place") -> tuple[DataFrame, int]:
    """``rows`` with their place in ``order``, from 1, and the number of rows.

    For each integer column in ``sums`` there is ``<name>_before``: its sum over the rows that come earlier (null counts
    as 0).  ``order`` should settle ties; rows that it does not tell apart keep some order among themselves, without gaps.
    The ordered rows are written to the shared folder, as places hold for one way of dealing them out.
    """
    spark, sums = rows.sparkSession, sums or []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "in-order")
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", PART_BIT)).withColumn("_own", F.col("_at").bitwiseAND(F.lit((1 << PART_BIT) - 1)))
    held = stored.groupBy("_part").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum{i}") for i, c in enumerate(sums)]).orderBy("_part").collect()
    counted = ["_n", *[f"_sum{i}" for i in range(len(sums))]]
    before = [[0, *accumulate(r[c] for r in held)] for c in counted]
    schema = ", ".join(["_part bigint", *[f"{c} bigint" for c in counted]])
    starts = F.broadcast(spark.createDataFrame([(r["_part"], *[int(b[i]) for b in before]) for i, r in enumerate(held)], schema))
    earlier = Window.partitionBy("_part").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    inner = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums}
    placed = stored.withColumns(inner).join(starts, "_part") if sums else stored.join(starts, "_part")
    totals = [(F.col(f"{c}_before") + F.col(f"_sum{i}")).alias(f"{c}_before") for i, c in enumerate(sums)]
    return placed.select(*rows.columns, (F.col("_own") + F.col("_n") + 1).alias(place), *totals), before[0][-1]
