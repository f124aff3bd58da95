"""Negatives for training groups: ranked channels with quotas, without replacement and without aliases of a positive.

Texts are told apart by a key of their normal form, so a copy of a positive is never a negative and no text is taken twice.
A channel takes only what the ones before it left; what is missing in the end is named, not filled silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.functions import text as T

#: Ids that random negatives are drawn from, by hash: a group has few exclusions, so a small pool serves all groups.
POOL, SEED = 64, "mine"


def text_keys(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, key)``: a hash of each text's normal form, so that no text travels."""
    return docs.select(F.col(ident).alias("id"), F.sha2(T.alnum_key(F.coalesce(F.col(text), F.lit(""))), 256).alias("key"))


def random_ranks(groups: DataFrame, keys: DataFrame, seed: str = SEED, pool: int = POOL) -> DataFrame:
    """``(qid, id, key, rank)``: for each group its own order of a pool of ids, drawn by hash from all of them."""
    drawn = keys.where("id IS NOT NULL").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "id"), 256), "id").limit(pool)
    held = drawn.agg(F.collect_list(F.struct("id", "key")).alias("pool"))  # one row of ``pool`` entries
    own = F.sha2(F.concat_ws("|", F.lit(seed), "qid", "id"), 256)
    rows = groups.select("qid").distinct().join(F.broadcast(held)).select("qid", F.inline("pool"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(own, "id")))


def distinct_texts(ranked: DataFrame, order: list) -> DataFrame:
    """The first row of each group's texts in ``order``."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "key").orderBy(*order))).where("_n = 1").drop("_n")


def alias_keys(gold: DataFrame, keys: DataFrame) -> DataFrame:
    """``(qid, key)`` of the positives' texts."""
    return gold.select("qid", "id").distinct().join(keys, "id").select("qid", "key").distinct()


def quota_negatives(channels: list[tuple[str, DataFrame, int]], gold_keys: DataFrame) -> DataFrame:
    """``(qid, kind, place, id, key)``: from each channel, in turn, its quota of texts that none before it took.

    A channel is its name, rows ``(qid, id, key, rank)`` and its quota.
    """
    taken = None
    for kind, ranked, quota in channels:
        rows = ranked.join(gold_keys, ["qid", "key"], "left_anti")
        if taken is not None:
            rows = rows.join(taken.select("qid", "key"), ["qid", "key"], "left_anti")
        place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))
        rows = distinct_texts(rows, ["rank", "id"]).withColumn("place", place).where(F.col("place") <= quota)
        rows = rows.select("qid", F.lit(kind).alias("kind"), "place", "id", "key")
        taken = rows if taken is None else taken.unionByName(rows)
    return taken


def shortages(groups: DataFrame, negatives: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """``(qid, kind, missing)`` of every group and channel below its quota."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("quota")) for k, n in quotas.items()]))
    held = negatives.groupBy("qid", "kind").agg(F.count("*").alias("n"))
    rows = groups.select("qid").distinct().select("qid", wanted.alias("w")).select("qid", "w.kind", "w.quota").join(held, ["qid", "kind"], "left")
    return rows.withColumn("missing", F.col("quota") - F.coalesce("n", F.lit(0))).where("missing > 0").select("qid", "kind", F.col("missing").cast("bigint").alias("missing"))


def accepted(ranked: DataFrame, gold_keys: DataFrame, forbidden: DataFrame, quota: int | None = None) -> DataFrame:
    """``(qid, id, key, rank)`` of a list's first rows that are no positive, no copy of one and not forbidden, ranked anew."""
    rows = ranked.join(gold_keys, ["qid", "key"], "left_anti").join(forbidden.select("id"), "id", "left_anti")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).select("qid", "id", "key", "rank")
    return rows if quota is None else rows.where(F.col("rank") <= quota)


def candidate_pool(channels: list[tuple[str, DataFrame]], spare: DataFrame, least: int = 10) -> DataFrame:
    """``(qid, id, key, source)``: what a teacher is to score, and one more random id (source ``random``).

    Channels and ``spare`` are accepted lists; a text that several hold stands under the first.  Groups with fewer than
    ``least`` candidates are filled up from ``spare`` (source ``fill``); the next one there is the random one.
    """
    found = None
    for at, (source, rows) in enumerate(channels):
        rows = rows.select("qid", "id", "key", F.lit(source).alias("source"), F.struct(F.lit(at).alias("at"), "rank").alias("turn"))
        found = rows if found is None else found.unionByName(rows)
    found = distinct_texts(found, ["turn", "id"]).select("qid", "id", "key", "source")
    counts = found.groupBy("qid").agg(F.count("*").alias("n"))
    rest = distinct_texts(spare.join(found.select("qid", "key"), ["qid", "key"], "left_anti"), ["rank", "id"]).join(counts, "qid", "left").fillna(0, ["n"])
    wanted = F.greatest(F.lit(0), least - F.col("n"))
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).where(F.col("place") <= wanted + 1)
    return found.unionByName(rest.select("qid", "id", "key", F.when(F.col("place") > wanted, "random").otherwise("fill").alias("source")))


def model_negatives(pool: DataFrame, lexical: DataFrame, hard: int = 6, lex: int = 4, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(qid, place, id, kind)`` of each group, and ``(qid, reason)`` of those that fail.

    ``pool``: as from ``candidate_pool`` with a teacher's ``score``.  ``lexical``: qid, id, rank.  The ``hard`` best by the
    teacher come first; then up to ``lex`` of the lexical list, in its order, their missing places filled by the
    teacher's order; then the random one.  A group with fewer than ``least`` candidates fails.
    """
    group = Window.partitionBy("qid")
    real = pool.where("source <> 'random'")
    order = F.row_number().over(group.orderBy(F.desc("score"), "id"))
    rows = real.withColumn("order", order).withColumn("n", F.count("*").over(group)).join(lexical.select("qid", "id", F.col("rank").alias("lexical")), ["qid", "id"], "left")
    failed = pool.select("qid").distinct().join(rows.where(F.col("n") >= least).select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(f"fewer_than_{least}_distinct_negatives").alias("reason"))
    rows = rows.where(F.col("n") >= least)
    top = rows.where(F.col("order") <= hard).select("qid", "id", F.lit("model").alias("kind"), F.col("order").alias("place"))
    rest = rows.where(F.col("order") > hard)
    at = F.row_number().over(group.orderBy(F.col("lexical").isNull(), F.coalesce("lexical", "order"), "id"))
    second = rest.withColumn("at", at).where(F.col("at") <= lex).select("qid", "id", F.lit("lexical").alias("kind"), (F.col("at") + hard).alias("place"))
    whole = rows.select("qid").distinct()
    last = pool.where("source = 'random'").join(whole, "qid", "left_semi").select("qid", "id", F.lit("random").alias("kind"), F.lit(hard + lex + 1).alias("place"))
    return top.unionByName(second).unionByName(last).select("qid", "place", "id", "kind"), failed


def overlap(keys: Column, terms: Column) -> Column:
    """A stand-in teacher: the share of a question's key terms that a text has, six digits."""
    return F.round(F.size(F.array_intersect(keys, terms)) / F.greatest(F.lit(1), F.size(keys)), 6)
