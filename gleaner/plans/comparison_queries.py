"""Runs compared on the same questions: dense against lexical search, and blends of both.

A question is a benchmark text; its gold documents are those that hold it.  Questions fall into two domains by length.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.functions import tags, text as T
from gleaner.operators import conflicts as C
from gleaner.operators import graph as G
from gleaner.operators import index
from gleaner.operators import metrics as M
from gleaner.operators import rank, sets
from gleaner.plans import fixtures as X
from gleaner.plans.base import Catalog, table
from gleaner.plans.graph_queries import shared_lines
from gleaner.plans.rank_queries import BOTH_CTE, POOL_CTE, found, pooled, questions, scored_pairs, sql_minmax
from gleaner.plans.tag_queries import enrich
from gleaner.session import shared_folder

catalog = Catalog()

LONG = 180
GOLD_CTE = f"""asked AS (SELECT item_id AS qid, CASE WHEN length(text) >= {LONG} THEN 'long' ELSE 'short' END AS mode FROM benchmark),
    gold AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '')"""
FIRST_CTE = f"""{BOTH_CTE}, {GOLD_CTE}, firsts AS (SELECT a.qid, mode, (SELECT min(rank) FROM dense d JOIN gold g ON g.qid = d.qid AND g.id = d.id WHERE d.qid = a.qid) AS dense, (SELECT min(rank) FROM sparse s JOIN gold g ON g.qid = s.qid AND g.id = s.id WHERE s.qid = a.qid) AS sparse FROM asked a)"""


def asked(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.when(F.length("text") >= LONG, "long").otherwise("short").alias("mode"))


def gold(spark, sf_dir):
    held = sets.contained_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return held.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id")).distinct()


def first_ranks(spark, sf_dir):
    """``qid, mode, dense, sparse``: the first gold rank in each list, null if none is listed."""
    of = lambda c: F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(c)
    ranks = found(spark, sf_dir).join(gold(spark, sf_dir), ["qid", "id"]).groupBy("qid").agg(of("dense"), of("sparse"))
    return asked(spark, sf_dir).join(ranks, "qid", "left")


def hit(column: str, k: int):
    return F.coalesce(F.col(column) <= k, F.lit(False))


SQL_P = "CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0::DOUBLE))))) END"


@catalog.add(
    "mt23_paired_wins",
    f"""WITH {FIRST_CTE}, c AS (SELECT mode, count(*) AS n, count(*) FILTER (coalesce(sparse <= 1, FALSE) AND NOT coalesce(dense <= 1, FALSE)) AS wins, count(*) FILTER (coalesce(dense <= 1, FALSE) AND NOT coalesce(sparse <= 1, FALSE)) AS losses FROM firsts GROUP BY mode)
        SELECT mode, n, wins, losses, n - wins - losses AS ties, round((wins - losses) / n::DOUBLE, 6) AS difference, round({SQL_P}, 9)::DOUBLE AS p FROM c""",
)
def paired_wins(spark, sf_dir):
    """Lexical against dense search by first hits, with the exact two-sided p-value."""
    pairs = first_ranks(spark, sf_dir).select("mode", hit("sparse", 1).alias("new"), hit("dense", 1).alias("old"))
    return M.paired_outcomes(pairs, ["mode"]).withColumns({"difference": F.round("difference", 6), "p": F.round("p", 9)})


@catalog.add("mt23_cluster_interval")
def cluster_interval(spark, sf_dir):
    """The difference's interval over clusters of questions that share a gold document."""
    held, asked_ = gold(spark, sf_dir), asked(spark, sf_dir)
    first = held.groupBy("id").agg(F.min("qid").alias("a"))
    edges = held.join(first, "id").where("qid <> a").select("a", F.col("qid").alias("b")).distinct()
    clusters = G.components(edges, asked_.select(F.col("qid").alias("node"))).select(F.col("node").alias("qid"), "component")
    rows = first_ranks(spark, sf_dir).select("qid", (hit("sparse", 1).cast("int") - hit("dense", 1).cast("int")).alias("num"), F.lit(1).alias("den")).join(clusters, "qid")
    draws = M.bootstrap(rows, "component", 1_000)
    return draws.agg(F.count("ratio").alias("draws"), F.round(F.percentile("ratio", 0.025), 6).alias("low"), F.round(F.percentile("ratio", 0.975), 6).alias("high"))


@catalog.add(
    "mt28_run_contingency",
    f"""WITH {FIRST_CTE}, long AS (SELECT mode, metric, coalesce(dense <= k, FALSE) AS x, coalesce(sparse <= k, FALSE) AS y FROM firsts, (VALUES ('hit1', 1), ('hit10', 10)) m(metric, k))
        SELECT mode, metric, count(*) AS n, count(*) FILTER (x AND y) AS both_pass, count(*) FILTER (x AND NOT y) AS left_only, count(*) FILTER (NOT x AND y) AS right_only, count(*) FILTER (NOT x AND NOT y) AS neither_pass,
        round(100 * (count(*) FILTER (NOT x AND y) - count(*) FILTER (x AND NOT y)) / count(*)::DOUBLE, 6) AS points FROM long GROUP BY ALL""",
)
def contingency(spark, sf_dir):
    """Two runs over the same questions, matched request by request."""
    ranks = first_ranks(spark, sf_dir)
    run = lambda c: ranks.select("mode", F.col("qid").alias("id"), hit(c, 1).alias("hit1"), hit(c, 10).alias("hit10"))
    return M.run_contingency(run("dense"), run("sparse"), ["hit1", "hit10"])


CONFIGS = [("previous_0", "previous", 0.0), ("previous_20", "previous", 0.2), ("new_50", "new", 0.5), ("new_100", "new", 1.0)]
UTILITY = {"long": ("mrr", 0.6), "short": ("mrr", 0.4)}
GUARDS = {"long": ("hit1", 0.05), "short": ("hit1", 0.1)}


@catalog.add(
    "mt26_guarded_selection",
    f"""WITH {POOL_CTE}, {GOLD_CTE}, configs(config, model, l) AS (VALUES {', '.join(f"('{c}', '{m}', {x}::DOUBLE)" for c, m, x in CONFIGS)}), scaled AS (SELECT qid, id, {sql_minmax('dense')} AS d, {sql_minmax('sparse')} AS s FROM pool),
        ranked AS (SELECT config, qid, id, row_number() OVER (PARTITION BY config, qid ORDER BY round((1 - l) * d + l * s, 6) DESC, id) AS place FROM scaled, configs),
        firsts AS (SELECT c.config, model, mode, a.qid, min(place) AS first FROM configs c CROSS JOIN asked a LEFT JOIN (SELECT r.* FROM ranked r JOIN gold USING (qid, id)) g ON g.config = c.config AND g.qid = a.qid GROUP BY ALL),
        m AS (SELECT config, model, mode, avg(coalesce((first <= 1)::INTEGER, 0)) AS hit1, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM firsts GROUP BY ALL),
        w AS (SELECT config, model, 0.6 * max(mrr) FILTER (mode = 'long') + 0.4 * max(mrr) FILTER (mode = 'short') AS utility, max(hit1) FILTER (mode = 'long') AS g0, max(hit1) FILTER (mode = 'short') AS g1 FROM m GROUP BY ALL),
        e AS (SELECT w.*, w.g0 + 1e-12 >= b.g0 - 0.05 AND w.g1 + 1e-12 >= b.g1 - 0.1 AS eligible FROM w, w b WHERE b.config = 'previous_20'),
        old AS (SELECT * FROM e WHERE eligible AND model = 'previous' ORDER BY utility DESC, g0 DESC, config LIMIT 1), new AS (SELECT * FROM e WHERE eligible AND model <> 'previous' ORDER BY utility DESC, g0 DESC, config LIMIT 1),
        p AS (SELECT coalesce((SELECT utility FROM new) > (SELECT utility FROM old) + 1e-12, FALSE) AS promoted)
        SELECT config, model, round(utility, 6) AS utility, eligible, config = CASE WHEN promoted THEN (SELECT config FROM new) ELSE (SELECT config FROM old) END AS chosen, promoted FROM e, p""",
)
def selection(spark, sf_dir):
    """Which blend to use: guards against the present one, and a new model only if it is strictly better."""
    d, s = rank.minmax(F.col("dense")), rank.minmax(F.col("sparse"))
    scaled = pooled(spark, sf_dir).select("qid", "id", d.alias("d"), s.alias("s"))
    configs = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(m).alias("model"), F.lit(x).alias("l")) for c, m, x in CONFIGS])
    blended = scaled.select("qid", "id", "d", "s", F.inline(configs)).withColumn("blend", F.round((1 - F.col("l")) * F.col("d") + F.col("l") * F.col("s"), 6))
    placed = blended.withColumn("place", F.row_number().over(Window.partitionBy("config", "qid").orderBy(F.desc("blend"), "id")))
    firsts = placed.join(gold(spark, sf_dir), ["qid", "id"]).groupBy("config", "qid").agg(F.min("place").alias("first"))
    every = asked(spark, sf_dir).select("qid", "mode", F.inline(configs)).join(firsts, ["config", "qid"], "left")
    wide = every.groupBy("config", "model", F.col("mode").alias("domain")).agg(F.avg(hit("first", 1).cast("int")).alias("hit1"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
    long = wide.unpivot(["config", "model", "domain"], ["hit1", "mrr"], "metric", "value")
    return M.guarded_selection(long, UTILITY, GUARDS, "previous_20", ("long", "hit1")).withColumn("utility", F.round("utility", 6))


SCOPED, NEEDED = 100, 3


def study_cases(spark, sf_dir):
    """Gold pages, lists and edges of the path study: a packet is a component of documents that share long lines."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "paths")

    def cut(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    shared = cut(shared_lines(spark, sf_dir), "shared")
    packets = G.components(shared, docs.select(F.col("doc_id").alias("node"))).select(F.col("node").alias("id"), F.col("component").alias("packet"))
    held = gold(spark, sf_dir).withColumnRenamed("qid", "cid").join(packets, "id")
    scope = held.groupBy("cid").agg(F.min_by("packet", "id").alias("packet"))
    own = held.join(scope, ["cid", "packet"]).withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("n") <= NEEDED)
    listed = found(spark, sf_dir, SCOPED).withColumnRenamed("qid", "cid").join(packets, "id").join(scope, ["cid", "packet"])
    place = F.row_number().over(Window.partitionBy("cid", "channel").orderBy("rank"))
    after = Window.partitionBy("packet").orderBy("id")
    following = packets.withColumn("target", F.lead("id").over(after)).where("target IS NOT NULL").select(F.col("id").alias("source"), "target", F.lit("candidate_next").alias("relation"), F.lit(0.4).alias("confidence"))
    lines = shared.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("shares_line").alias("relation"), F.lit(0.5).alias("confidence"))
    return cut(own.select("cid", "id"), "gold"), cut(listed.select("cid", "channel", "id", place.alias("place")), "lists"), cut(G.adjacency(lines).unionByName(following), "edges")


@catalog.add("gr10_path_study")
def path_study(spark, sf_dir):
    """Five arms over packets of documents that share lines: recall and completeness of the pages that a case needs."""
    rows = G.path_study(*study_cases(spark, sf_dir))
    return rows.groupBy("arm").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("found") / F.col("n_gold")), 6).alias("page_recall"), F.round(F.avg(F.col("complete").cast("int")), 6).alias("complete_evidence"))


@catalog.add("an10_conflict_types")
def conflict_types(spark, sf_dir):
    """Conflicts among the five pages that score best for each question, over whole tables and the small pages."""
    pages = X.PAGES.frame(spark, sf_dir)
    asked_ = X.QUESTIONS.frame(spark)
    low = F.lower("question")
    flags = asked_.select("qid", tags.understanding(F.col("question"))["needs_endorsement_check"].alias("needs_endorsement"), low.rlike("except|unless|however").alias("needs_exception"), tags.understanding(F.col("question"))["needs_limit"].alias("needs_limit"))
    scored = scored_pairs(asked_, pages).select("qid", "source", "score")
    top = index.top_k(scored, "qid", "source", C.TOP)
    marked = enrich(pages.join(top.select("source").distinct(), "source", "left_semi"))
    kind = marked.select("source", "document_type", F.col("primary_clause_type").alias("primary_clause"), F.col("coverage_tags").alias("coverages"), F.col("section_titles").alias("sections"), F.col("form_codes").alias("forms"), F.col("text").rlike(T.AMOUNT).alias("numeric"))
    none = "array<struct<relation:string,page:string,coverages:array<string>,sections:array<string>,forms:array<string>>>"
    rows = top.select("qid", F.col("rank").alias("place"), "source").join(kind, "source").withColumn("relations", F.array().cast(none))
    return C.conflicts(rows, flags).select("qid", "n", "type", "severity", *[F.array_join(c, "|").alias(c) for c in ("sources", "coverages", "sections", "forms")])


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
