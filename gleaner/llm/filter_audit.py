"""What each of several filters removes, in every order in which they could be applied.

A row's mask has one bit for each filter that it fails.  Rows are summed by part and mask first, so what follows works on
at most ``2 ** filters`` cells a part, however many rows there are.  Each cell is then unpivoted against the steps of all
orders; a running bit-or window over a cell's earlier steps tells whether it was removed before; sums by step
on that condition give the counts, and a window over all orders of a filter gives its Shapley total.

The last filter, copies of a text of a smaller id, needs other rows.  Copies are summed by text hash, part and mask
in each task before they meet, so a text with any number of copies comes to a few rows.

Null text counts as empty; a null part as an empty string.  Rows with a null id are copies of nothing and have no
labels.  Repeated rows with the same id count each, and are no copies of one another.  Repeated labels count as one that is
1 if any is.  An empty table has no parts and gives no rows.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text) -> dict[str, F.Column]:
    """Failure of the filters that look at one text alone, by letter."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows by part and failed filters; ``E`` is the bit after those of ``text_filters``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filters = text_filters(text)
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    key = F.unhex(F.sha2(text, 256))
    # a null id gets a key of its own that spreads its rows; no label is taken for it
    kind = docs.schema["doc_id"].dataType.simpleString()
    at = F.coalesce("doc_id", F.xxhash64(text).try_cast(kind))
    rows = docs.select(at.alias("at"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("lang", F.lit("")).alias("part"), key.alias("key"), bits.cast("int").alias("own"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("at")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    flag = lambda c: F.when(F.col("named"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    rows = rows.join(known, "at", "left").select("at", "named", "part", "key", "own", flag("good"), flag("toxic"))
    # one row an id and text, then one a text, part, mask and labels: n rows, of which n_first have the least id
    copies = ["key", "part", "own", "good", "toxic"]
    ids = rows.groupBy("at", "named", *copies).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("named"), F.struct("at", "n")))
    texts = ids.groupBy(*copies).agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("named"), F.col("n")).otherwise(0)).alias("n_null"), first.alias("first"))
    least = F.min("first.at").over(Window.partitionBy("key"))
    stays = F.col("n_null") + F.when(F.col("first.at") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("own").alias("mask"), F.col("stays").alias("n")), F.struct((F.col("own") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    cells = texts.withColumn("least", least).withColumn("stays", F.coalesce(stays, F.col("n_null"))).select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """``(part, filter_order, step, counts...)`` for every order of the filters; bit ``i`` of a mask is ``letters[i]``."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("step", "letter"))
    bit = F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")
    steps = steps.withColumn("step", F.col("step") + 1).withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("gone", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)) != 0)
    here, again = (F.col("fails") != 0) & ~F.col("gone"), (F.col("fails") != 0) & F.col("gone")
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0))
    made = (total((F.col("fails") == 0) & ~F.col("gone")), total(here), total(again), total(F.col("mask") == F.col("bit")), total(here, "good"), total(here, "toxic"))
    out = steps.groupBy("part", "filter_order", "step", "letter").agg(*[m.alias(name) for m, name in zip(made, COUNTS)])
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters ``A`` to ``E`` over ``docs`` (doc_id, text, lang) in all 120 orders."""
    return interactions(masked_cells(docs, labels), "ABCDE")
