"""Document graphs: candidate and explicit edges, adjacency, bounded walks, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def group_id(packet: Column, doc: Column) -> Column:
    return F.when(F.trim(F.coalesce(packet, F.lit(""))) != "", F.concat(F.lit("packet::"), F.trim(packet))).otherwise(F.concat(F.lit("doc::"), doc))


def candidate_edges(pages: DataFrame) -> DataFrame:
    """Heuristic edges between the pages of a group that share coverage tags or sections.

    ``pages``: key, group_id, policy_number, document_type, clause_types, coverage_tags,
    section_path, section_tokens.  One self-join on the group gives all relation families;
    edges across two different policy numbers are dropped.
    """
    side = lambda p: pages.select("group_id", F.struct(*[F.col(c) for c in pages.columns if c != "group_id"]).alias(p))
    pairs = side("s").join(side("t"), "group_id")
    has = lambda side, kind: F.array_contains(F.col(f"{side}.clause_types"), kind)
    typed = lambda side, kind: F.col(f"{side}.document_type") == kind
    cov = F.arrays_overlap("s.coverage_tags", "t.coverage_tags")
    paths = (F.size("s.section_path") > 0) & (F.size("t.section_path") > 0)
    sec = F.when(paths, F.arrays_overlap("s.section_path", "t.section_path")).otherwise(F.arrays_overlap("s.section_tokens", "t.section_tokens"))
    other, either, both = F.col("s.key") != F.col("t.key"), cov | sec, cov & sec
    money = has("t", "limit") | has("t", "deductible") | has("t", "premium")
    families = [
        ("defines_limit_for", typed("s", "declarations") & other & (cov | money), F.when(cov, 0.82).otherwise(0.72)),
        ("modifies", (typed("s", "endorsement") | has("s", "endorsement")) & other & (either | has("t", "exclusion")), F.when(both, 0.88).otherwise(0.76)),
        ("limited_by", has("s", "coverage") & has("t", "exclusion") & other & either, F.when(cov, 0.78).otherwise(0.70)),
        ("overridden_by", has("s", "exclusion") & (typed("t", "endorsement") | has("t", "endorsement")) & either, F.when(cov, 0.90).otherwise(0.78)),
        ("qualified_by", has("s", "exclusion") & has("t", "exception") & other & either, F.when(both, 0.80).otherwise(0.72)),
        ("defines_term_for", has("s", "definition") & other & either, F.lit(0.74)),
    ]
    edges = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(f"candidate_{name}").alias("relation"), conf.alias("confidence"))) for name, cond, conf in families]))
    clash = (F.col("s.policy_number") != F.col("t.policy_number")) & (F.col("s.policy_number") != "") & (F.col("t.policy_number") != "")
    rows = pairs.where(~F.coalesce(clash, F.lit(False))).select(F.col("s.key").alias("source"), F.col("t.key").alias("target"), F.explode(edges).alias("e"))
    return rows.select("source", "target", "e.relation", "e.confidence")


def reference_edges(pages: DataFrame, pattern: str, headings: DataFrame) -> DataFrame:
    """Explicit edges from a page that names a heading which only one page of its group has."""
    refs = pages.select("group_id", F.col("key").alias("source"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.lower(x)))).alias("name"))
    unique = headings.groupBy("group_id", "name").agg(F.count("*").alias("n"), F.min("key").alias("target")).where("n = 1")
    return refs.join(unique, ["group_id", "name"]).where("source <> target").select("source", "target", F.lit("references_section").alias("relation"), F.lit(1.0).alias("confidence"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges and their reversals, which are marked as such."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("reverse::"), "relation").alias("relation"), "confidence")
    return edges.select("source", "target", "relation", "confidence").unionByName(back)


def bounded_walk(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 8) -> DataFrame:
    """``(qid, node, hop, place)``: pages reached from seeds, each once, at most ``most`` a query.

    Explicit edges (those not marked ``candidate_``) come first and alone lead past one hop.  A hop keeps
    its first ``most`` pages: pages of a later hop rank behind all of an earlier one, so no other can enter.
    """
    explicit = ~F.col("relation").contains("candidate_")
    seen = seeds.select("qid", F.col("node")).withColumn("hop", F.lit(0))
    frontier, found = seen.select("qid", "node"), None
    for hop in range(1, hops + 1):
        steps = frontier.join(edges.where(explicit) if hop > 1 else edges, frontier["node"] == edges["source"]).select("qid", F.col("target").alias("node"), explicit.alias("explicit"), "confidence", "relation", F.col("source").alias("origin"))
        first = Window.partitionBy("qid", "node").orderBy(F.desc("explicit"), F.desc("confidence"), "relation", "origin")
        steps = steps.withColumn("k", F.row_number().over(first)).where("k = 1").join(seen.select("qid", "node"), ["qid", "node"], "left_anti").withColumn("hop", F.lit(hop))
        best = Window.partitionBy("qid").orderBy(F.desc("explicit"), F.desc("confidence"), "node")
        steps = steps.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most)
        found = steps if found is None else found.unionByName(steps)
        seen = seen.unionByName(steps.select("qid", "node", "hop"))
        frontier = steps.where("explicit").select("qid", "node")
    place = Window.partitionBy("qid").orderBy("hop", F.desc("explicit"), F.desc("confidence"), "node")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("qid", "node", "hop", "place")


def reserve_dependencies(ranked: DataFrame, edges: DataFrame, k: int, hops: int = 2, most: int = 8) -> DataFrame:
    """``(qid, id, role, place)``: ``k`` pages a query, with places kept for what one of them refers to.

    ``ranked``: qid, id, place.  The anchor is the first of the first ``k`` pages whose explicit edges lead,
    within ``hops`` and ``most`` pages, to a ranked page.  It comes first, then those pages in the walk's
    order, then the ranking.  Without an anchor, or with ``k`` below two, the ranking stays.

    A walk has one seed, so it has seen at most ``most + 1`` pages; ``2 * most + 1`` edges of a page are
    therefore enough, and a page that many refer to sends out no more.
    """
    fan = Window.partitionBy("source").orderBy(F.desc("confidence"), "target")
    plain = edges.where(~F.col("relation").contains("candidate_")).groupBy("source", "target").agg(F.max("confidence").alias("confidence")).withColumn("relation", F.lit("explicit"))
    plain = plain.where("source <> target").withColumn("n", F.row_number().over(fan)).where(F.col("n") <= 2 * most + 1).drop("n")
    top = ranked.where(F.col("place") <= k).where(F.lit(k >= 2))
    walks = bounded_walk(top.select(F.struct("qid", "id").alias("qid"), F.col("id").alias("node")), plain, hops, most)
    steps = walks.select(F.col("qid.qid").alias("qid"), F.col("qid.id").alias("anchor"), F.col("node").alias("id"), F.col("place").alias("step"))
    linked = steps.join(ranked.select("qid", "id"), ["qid", "id"]).join(top.select("qid", F.col("id").alias("anchor"), F.col("place").alias("at")), ["qid", "anchor"])
    chosen = linked.withColumn("first", F.min("at").over(Window.partitionBy("qid"))).where("at = first")
    kept = chosen.select("qid", "id", "step").unionByName(chosen.select("qid", F.col("anchor").alias("id"), F.lit(0).alias("step")).distinct())
    order = Window.partitionBy("qid").orderBy(F.col("step").isNull(), F.coalesce("step", "place"))
    role = F.when(F.col("step") == 0, "anchor").when(F.col("step") > 0, "dependency").otherwise("ranked")
    rows = ranked.join(kept, ["qid", "id"], "left").withColumn("role", role).withColumn("new", F.row_number().over(order))
    return rows.where(F.col("new") <= k).select("qid", "id", "role", F.col("new").alias("place"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)`` with the least node reachable; labels halve their distance each round.

    Each round is written to the folder that the cluster shares, so lineage stays short.
    """
    spark = edges.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    folder, serial = f"{base.rstrip('/')}/components-{uuid.uuid4().hex}", 0

    def cut(df: DataFrame) -> DataFrame:
        nonlocal serial
        serial += 1
        df.write.parquet(f"{folder}/{serial}")
        return spark.read.parquet(f"{folder}/{serial}")

    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near").distinct())
    labels = cut(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        low = both.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("low"))
        step = labels.join(low, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("mid"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = cut(step.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "was"))
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels


#: Arms of the path study: the lists that rank pages, and the edges that lead on from the best of them.
ARMS = {"sparse": (("sparse",), None), "dense": (("dense",), None), "hybrid": (("sparse", "dense"), None), "hybrid_explicit_graph": (("sparse", "dense"), "explicit"), "hybrid_all_graph": (("sparse", "dense"), "all")}


def path_study(gold: DataFrame, lists: DataFrame, edges: DataFrame, k: int = 3, seeds: int = 4, hops: int = 2, most: int = 8, smooth: int = 60) -> DataFrame:
    """``(cid, arm, n_gold, found, complete)``: how much of what a case needs is among the first ``k`` pages of each arm.

    ``gold``: cid, id of every page that is needed.  ``lists``: cid, channel, id, place, within the case's packet.  ``edges``: as for
    ``bounded_walk``.  An arm ranks by reciprocal ranks of its lists; with a graph, the pages that a walk from its first
    ``seeds`` reaches come before all others, in the walk's order.  A case is complete only if all its pages are there.
    """
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.array(*map(F.lit, channels)).alias("channels"), F.lit(mode).cast("string").alias("mode")) for a, (channels, mode) in ARMS.items()]))
    rows = lists.select("cid", "channel", "id", "place", arms.alias("a")).where(F.array_contains("a.channels", F.col("channel")))
    fused = rows.groupBy("cid", F.col("a.arm").alias("arm"), F.col("a.mode").alias("mode"), "id").agg(F.sum(1.0 / (smooth + F.col("place"))).alias("score"))
    order = Window.partitionBy("cid", "arm").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = fused.withColumn("n", F.row_number().over(order))
    starts = ranked.where((F.col("n") <= seeds) & F.col("mode").isNotNull()).select(F.struct("cid", "arm").alias("qid"), F.col("id").alias("node"), "mode")
    reached = None
    for mode in ("explicit", "all"):
        mine = starts.where(F.col("mode") == mode).drop("mode")
        walk = bounded_walk(mine, edges if mode == "all" else edges.where(~F.col("relation").contains("candidate_")), hops, most)
        steps = walk.select(F.col("qid.cid").alias("cid"), F.col("qid.arm").alias("arm"), F.col("node").alias("id"), F.col("place").alias("step"))
        reached = steps if reached is None else reached.unionByName(steps)
    every = ranked.select("cid", "arm", "id", "n").join(reached, ["cid", "arm", "id"], "full_outer")
    first = Window.partitionBy("cid", "arm").orderBy(F.col("step").isNull(), "step", "n")
    top = every.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).select("cid", "arm", "id")
    wanted = gold.select("cid", "id").distinct().select("cid", "id", arms.alias("a")).select("cid", "id", "a.arm")
    hits = wanted.join(top.withColumn("hit", F.lit(1)), ["cid", "arm", "id"], "left").groupBy("cid", "arm").agg(F.count("*").alias("n_gold"), F.count("hit").alias("found"))
    return hits.withColumn("complete", F.col("found") == F.col("n_gold"))
