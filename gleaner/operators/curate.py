"""A training set of a given size from ranked snippets: topic quotas first, then turns, then what was deferred.

The rounds of a sequential builder become ranks.  In round one a topic takes its quota of (snippet, question) pairs in the
snippets' order, topics one after another until the target is reached.  In round two every snippet gives its first pairs; the
rest is deferred to round three, which only runs if places are left.  A pair is used once, in the earliest of its places.
Ranks come from one distributed order of all pairs, so neither a topic nor a round is held by one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.operators.order import in_order

#: Topics of a snippet that give pairs, pairs of them that are not deferred, and the topic of a snippet without any.
TOPICS, AT_ONCE = 3, 2
#: Positions that are searched together when an earlier row is looked for.
STRETCH = 4_096


def matched_topics(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Topics of which a word stands in the text, in the lexicon's order."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, cues))), topic) for topic, cues in lexicon.items()]))


def _questions(variants: list[str]) -> Column:
    return F.array(*map(F.lit, variants))


def topic_quotas(snippets: DataFrame, variants: dict[str, list[str]], quotas: dict[str, int], target: int) -> tuple[DataFrame, int]:
    """``(position, s, topic, question)`` of round one, and how many they are.  ``snippets``: s (place in order), topics.

    Topics with a quota must not share a question.
    """
    order = {t: i for i, t in enumerate(quotas)}
    table = F.inline(F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(order[t]).alias("at"), F.lit(n).alias("quota"), _questions(variants[t]).alias("questions")) for t, n in quotas.items()]))
    rows = snippets.select("s", "topics", table).where(F.array_contains("topics", F.col("topic")))
    by_topic = Window.partitionBy("topic")
    # a topic needs no more snippets than its quota has places
    rows = rows.withColumn("k", F.row_number().over(by_topic.orderBy("s"))).where(F.col("k") <= F.ceil(F.col("quota") / F.size("questions")))
    pairs = rows.select("s", "topic", "at", "quota", F.posexplode("questions").alias("v", "question"))
    pairs = pairs.withColumn("k", F.row_number().over(by_topic.orderBy("s", "v"))).where(F.col("k") <= F.col("quota"))
    counts = {r["at"]: r.n for r in pairs.groupBy("at").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for a, n in counts.items() if a < i) for i in range(len(quotas))]
    position = F.element_at(F.array(*map(F.lit, before)), F.col("at") + 1) + F.col("k")
    kept = pairs.select(position.cast("bigint").alias("position"), "s", "topic", "question").where(F.col("position") <= target)
    return kept, min(target, sum(counts.values()))


def later_rounds(snippets: DataFrame, variants: dict[str, list[str]], generic: list[str], default: str) -> DataFrame:
    """``(round, s, slot, topic, question)`` of every pair that rounds two and three offer."""
    pairs = lambda topic, questions: F.array(*[F.struct(F.lit(topic).alias("topic"), F.lit(q).alias("question")) for q in questions])
    of_topic = F.create_map(*[x for t, qs in variants.items() for x in (F.lit(t), pairs(t, qs))])
    topics = F.slice(F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit(default))), 1, TOPICS)
    own = F.flatten(F.transform(topics, lambda t: F.element_at(of_topic, t)))
    common = pairs("general", generic)
    rows = snippets.select("s", own.alias("own"))
    first, rest = F.concat(F.slice("own", 1, AT_ONCE), F.slice(common, 1, 1)), F.concat(F.slice("own", AT_ONCE + 1, 1 << 20), F.slice(common, 2, 1 << 20))
    rounds = F.inline(F.array(F.struct(F.lit(2).alias("round"), first.alias("pairs")), F.struct(F.lit(3).alias("round"), rest.alias("pairs"))))
    return rows.select("s", rounds).select("round", "s", F.posexplode("pairs").alias("slot", "p")).select("round", "s", "slot", "p.topic", "p.question")


def curated(snippets: DataFrame, variants: dict[str, list[str]], generic: list[str], quotas: dict[str, int], target: int, default: str = "coverage") -> DataFrame:
    """``(position, round, s, topic, question)``: at most ``target`` pairs in the order a sequential builder would take them.

    ``snippets``: s, the place of each in the builder's order from 1, and topics.  A snippet without topics counts as ``default``.
    """
    first, n = topic_quotas(snippets, variants, quotas, target)
    offered = later_rounds(snippets, variants, generic, default).join(first.select("s", "question"), ["s", "question"], "left_anti")
    once = Window.partitionBy("s", "question").orderBy("round", "slot")
    offered = offered.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    placed, _ = in_order(offered, [F.asc("round"), F.asc("s"), F.asc("slot")])
    later = placed.where(F.col("place") <= target - n).select((F.col("place") + n).alias("position"), "round", "s", "topic", "question")
    return first.select("position", F.lit(1).alias("round"), "s", "topic", "question").unionByName(later)


def last_at_or_before(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (key, position, ...) with ``found``: the greatest position of the key's ``rows`` that is no later.

    Where there is none the search goes on from the end: then it is the greatest of all, null if the key has no rows.
    Positions are searched in stretches, each summed to its greatest, so that no window holds a whole key.
    """
    held = rows.select("key", "position", (F.col("position") / STRETCH).cast("bigint").alias("stretch"))
    tops = held.groupBy("key", "stretch").agg(F.max("position").alias("top"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    asked = probes.withColumn("stretch", (F.col("position") / STRETCH).cast("bigint"))
    marks = tops.select("key", "stretch", "top").unionByName(asked.select("key", "stretch", F.lit(None).cast("bigint").alias("top")).distinct())
    marks = marks.groupBy("key", "stretch").agg(F.max("top").alias("top")).withColumn("before", F.max("top").over(earlier)).withColumn("all", F.max("top").over(Window.partitionBy("key")))
    inside = asked.select("key", "stretch", F.col("position").alias("asked")).distinct().join(held, ["key", "stretch"]).where("position <= asked")
    inside = inside.groupBy("key", "asked").agg(F.max("position").alias("own"))
    out = asked.join(marks.select("key", "stretch", "before", "all"), ["key", "stretch"]).join(inside.withColumnRenamed("asked", "position"), ["key", "position"], "left")
    return out.select(*probes.columns, F.coalesce("own", "before", "all").alias("found"))


def counterexamples(records: DataFrame, total: int, questions: list[str], supports, n: int) -> DataFrame:
    """``(idx, question, position)``: questions, in turn, each with a record whose evidence does not support it.

    ``records``: position (1 to ``total``) and evidence.  The search begins at the end, one record further down for
    each question, and goes on downwards and round.  Questions that every record supports are left out.
    """
    many = min(n, total)
    rows = records.select("position", "evidence", F.posexplode(_questions(questions)).alias("key", "question"))
    open_ = rows.where(~F.coalesce(supports(F.col("question"), F.col("evidence")), F.lit(False))).select("key", "position")
    idx = records.sparkSession.range(many).select(F.col("id").alias("idx"))
    asked = idx.select("idx", (F.col("idx") % len(questions)).cast("int").alias("key"), (total - F.col("idx")).alias("position"))
    found = last_at_or_before(open_, asked).where("found IS NOT NULL")
    return found.select("idx", F.element_at(_questions(questions), F.col("key") + 1).alias("question"), F.col("found").alias("position"))
