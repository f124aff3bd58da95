"""Fusion of ranked lists: reciprocal ranks, score blends, candidate pools, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.operators.index import top_k


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, ident: str = "id") -> DataFrame:
    """Of rows ``(qid, channel, id, rank, score)`` the sum of 1 / (k + rank) for each id."""
    return lists.groupBy("qid", ident).agg(F.round(F.sum(1.0 / (F.greatest(F.lit(1), F.lit(k)) + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("best"), F.min("rank").alias("best_rank"))


def minmax(score: Column, group: str = "qid") -> Column:
    """Scores of a group brought to 0..1; a constant group is 0."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.0)


def pool(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Candidates of two lists ``(qid, id, score, rank)`` with both scores, missing ones 0."""
    d = dense.select("qid", "id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
    s = sparse.select("qid", "id", F.col("score").alias("sparse"), F.col("rank").alias("sparse_rank"))
    return d.join(s, ["qid", "id"], "full_outer").fillna(0.0, ["dense", "sparse"])


def pooled(lists: DataFrame) -> DataFrame:
    """``pool`` of the channels ``dense`` and ``sparse`` of rows ``(qid, channel, id, score, rank)``, which are made once."""
    of = lambda channel, column: F.max(F.when(F.col("channel") == channel, F.col(column)))
    both = [of(c, "score").alias(c) for c in ("dense", "sparse")] + [of(c, "rank").alias(f"{c}_rank") for c in ("dense", "sparse")]
    return lists.groupBy("qid", "id").agg(*both).fillna(0.0, ["dense", "sparse"])


def blend(candidates: DataFrame, lexical: float, cross: float = 0.0) -> DataFrame:
    """(1 - lexical) dense + lexical sparse over scores scaled within a query, then mixed with ``cross``."""
    first = (1 - lexical) * minmax(F.col("dense")) + lexical * minmax(F.col("sparse"))
    out = candidates.withColumn("blend", F.round(first, 6))
    if cross:
        out = out.withColumn("blend", F.round((1 - cross) * first + cross * minmax(F.col("cross")), 6))
    return out


def restricted_blend(candidates: DataFrame, lexical: float, keep: int) -> DataFrame:
    """The best ``keep`` by the blend over the union; the blend is then taken anew inside them."""
    kept = top_k(blend(candidates, lexical), "qid", "id", keep, "blend").drop("rank", "blend")
    return blend(kept, lexical)


def prioritised(rows: DataFrame, k: int) -> DataFrame:
    """Ordered by metadata score, then raw score; keeps max(k, min(n, k + max(2, k / 2)))."""
    w = Window.partitionBy("qid").orderBy(F.desc("metadata"), F.desc("score"), F.asc("id"))
    n = F.count("*").over(Window.partitionBy("qid"))
    keep = F.greatest(F.lit(k), F.least(n, F.lit(k + max(2, k // 2))))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("keep", keep).where("place <= keep").drop("keep")


def rollup(candidates: DataFrame, group: str = "source", bonus: float = 0.04) -> DataFrame:
    """Candidates to one row a page: best scores and ranks, both record types earn a bonus."""
    grouped = candidates.groupBy("qid", group).agg(F.max("score").alias("top"), F.min("rank").alias("best_rank"), F.count("*").alias("n"), F.sort_array(F.collect_set("channel")).alias("channels"), F.min_by("id", F.struct("rank", "id")).alias("first_id"))
    both = F.when(F.size("channels") > 1, bonus).otherwise(0.0)
    return grouped.withColumn("page_score", F.round(F.col("top") + both, 6))


def without_contained(snippets: Column) -> Column:
    """Snippets in order; one that contains or is contained in an earlier one goes."""
    plain = F.filter(F.transform(snippets, lambda s: F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))), lambda s: s != "")
    clash = lambda kept, s: F.exists(kept, lambda k: F.lower(k).contains(F.lower(s)) | F.lower(s).contains(F.lower(k)))
    return F.aggregate(plain, F.array().cast("array<string>"), lambda kept, s: F.when(clash(kept, s), kept).otherwise(F.concat(kept, F.array(s))))


def round_robin(rows: DataFrame, bucket: str, order: str, n: int) -> DataFrame:
    """Rows taken in turn from the buckets, in the order of ``order``, until there are ``n``."""
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", bucket).limit(n)
