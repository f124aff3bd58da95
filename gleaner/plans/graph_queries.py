"""Graphs over enriched pages, shared lines and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import tags
from gleaner.operators import graph as G
from gleaner.operators import index, sets
from gleaner.operators.order import in_order
from gleaner.plans import fixtures as X
from gleaner.plans.base import Catalog, quoted, sql_tags, table
from gleaner.plans.rank_queries import VECTORS_CTE, near_vectors
from gleaner.plans.tag_queries import SQL_CLAUSES, SQL_TYPE, TITLES, enrich
from gleaner.session import shared_folder

catalog = Catalog()

TOKENS = f"list_sort(list_distinct(list_filter(flatten(list_transform(titles, lambda t: regexp_extract_all(lower(t), '[a-z]+'))), lambda w: length(w) >= 3 AND NOT list_contains({quoted(tags.GENERIC_SECTION_TOKENS)}, w))))"
GRAPH_CTE = f"""{X.PAGES.whole()}, raw_titles AS (SELECT *, {TITLES} AS raw FROM fixture_pages), titled AS (SELECT * EXCLUDE raw, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS titles FROM raw_titles),
    g AS (SELECT doc_id || '::p' || page_number AS key, CASE WHEN trim(coalesce(packet_id, ''), ' ') <> '' THEN 'packet::' || packet_id ELSE 'doc::' || doc_id END AS group_id, policy_number, text, {SQL_TYPE} AS dt, {SQL_CLAUSES} AS ct, {sql_tags(tags.COVERAGE, 'lower(text)')} AS cov, titles[1:3] AS path, {TOKENS} AS toks FROM titled),
    pr AS (SELECT s.key AS source, t.key AS target, s.dt AS sdt, t.dt AS tdt, s.ct AS sct, t.ct AS tct, list_has_any(s.cov, t.cov) AS cov, CASE WHEN len(s.path) > 0 AND len(t.path) > 0 THEN list_has_any(s.path, t.path) ELSE list_has_any(s.toks, t.toks) END AS sec
        FROM g s JOIN g t USING (group_id) WHERE NOT coalesce(s.policy_number <> t.policy_number AND s.policy_number <> '' AND t.policy_number <> '', FALSE)),
    edges AS (SELECT source, target, 'candidate_defines_limit_for' AS relation, CASE WHEN cov THEN 0.82 ELSE 0.72 END::DOUBLE AS confidence FROM pr WHERE sdt = 'declarations' AND source <> target AND (cov OR list_has_any(tct, ['limit', 'deductible', 'premium']))
        UNION ALL SELECT source, target, 'candidate_modifies', CASE WHEN cov AND sec THEN 0.88 ELSE 0.76 END FROM pr WHERE (sdt = 'endorsement' OR list_contains(sct, 'endorsement')) AND source <> target AND (cov OR sec OR list_contains(tct, 'exclusion'))
        UNION ALL SELECT source, target, 'candidate_limited_by', CASE WHEN cov THEN 0.78 ELSE 0.70 END FROM pr WHERE list_contains(sct, 'coverage') AND list_contains(tct, 'exclusion') AND source <> target AND (cov OR sec)
        UNION ALL SELECT source, target, 'candidate_overridden_by', CASE WHEN cov THEN 0.90 ELSE 0.78 END FROM pr WHERE list_contains(sct, 'exclusion') AND (tdt = 'endorsement' OR list_contains(tct, 'endorsement')) AND (cov OR sec)
        UNION ALL SELECT source, target, 'candidate_qualified_by', CASE WHEN cov AND sec THEN 0.80 ELSE 0.72 END FROM pr WHERE list_contains(sct, 'exclusion') AND list_contains(tct, 'exception') AND source <> target AND (cov OR sec)
        UNION ALL SELECT source, target, 'candidate_defines_term_for', 0.74 FROM pr WHERE list_contains(sct, 'definition') AND source <> target AND (cov OR sec)),
    refs AS (SELECT DISTINCT group_id, key AS source, lower(unnest(regexp_extract_all(text, '(?i)see (section [ivx]+)', 1))) AS name FROM g), heads AS (SELECT group_id, name, count(*) AS n, min(key) AS target FROM (SELECT DISTINCT group_id, key, lower(unnest(regexp_extract_all(text, '(?i)(?:^|\\n)(section [ivx]+)', 1))) AS name FROM g) GROUP BY ALL),
    ref_edges AS (SELECT source, target, 'references_section' AS relation, 1.0::DOUBLE AS confidence FROM refs JOIN heads USING (group_id, name) WHERE n = 1 AND source <> target)"""


def graph_pages(spark, sf_dir, groups=None):
    """Pages with what edges depend on; only those of ``groups`` (``group_id``) are read by the taggers, if given."""
    pages = X.PAGES.frame(spark, sf_dir)
    key, named = F.concat("doc_id", F.lit("::p"), "page_number"), G.group_id(F.col("packet_id"), F.col("doc_id")).alias("group_id")
    df = enrich(pages if groups is None else pages.withColumn("group_id", named).join(groups, "group_id", "left_semi").drop("group_id"))
    return df.select(key.alias("key"), named, "policy_number", "document_type", "clause_types", "coverage_tags", "section_path", "section_tokens", "text")


@catalog.add("gr1_candidate_edges", f"WITH {GRAPH_CTE} SELECT * FROM edges")
def candidate_edges(spark, sf_dir):
    return G.candidate_edges(graph_pages(spark, sf_dir).drop("text"))


def references(spark, sf_dir):
    pages = graph_pages(spark, sf_dir)
    heads = pages.select("group_id", "key", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(?:^|\n)(section [ivx]+)"), F.lit(1)), lambda x: F.lower(x)))).alias("name"))
    return G.reference_edges(pages, r"(?i)see (section [ivx]+)", heads)


@catalog.add("gr2_reference_edges", f"WITH {GRAPH_CTE} SELECT * FROM ref_edges")
def reference_edges(spark, sf_dir):
    return references(spark, sf_dir)


@catalog.add("jn6_unique_headings", f"WITH {GRAPH_CTE} SELECT group_id, name, target FROM heads WHERE n = 1")
def unique_headings(spark, sf_dir):
    pages = graph_pages(spark, sf_dir)
    heads = pages.select("group_id", "key", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(?:^|\n)(section [ivx]+)"), F.lit(1)), lambda x: F.lower(x)))).alias("name"))
    return heads.groupBy("group_id", "name").agg(F.count("*").alias("n"), F.min("key").alias("target")).where("n = 1").drop("n")


LINES_CTE = "ln AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), line_heads AS (SELECT line, min(doc_id) AS a FROM ln WHERE length(line) >= 60 GROUP BY line HAVING count(*) > 1), shared AS (SELECT DISTINCT 'd' || a || '::p1' AS source, 'd' || doc_id || '::p1' AS target, 'shares_line' AS relation, 0.5::DOUBLE AS confidence FROM line_heads JOIN ln USING (line) WHERE doc_id <> a)"
ALL_EDGES_CTE = f"{GRAPH_CTE}, {LINES_CTE}, every AS (SELECT * FROM edges UNION ALL SELECT * FROM shared)"


def line_edges(spark, sf_dir, of=None):
    """Documents that share a long line, as explicit edges from the least of them; only edges that begin in ``of`` (``doc_id``), if given."""
    key = lambda c: F.concat(F.lit("d"), c, F.lit("::p1"))
    return shared_lines(spark, sf_dir, of).select(key("a").alias("source"), key("b").alias("target"), F.lit("shares_line").alias("relation"), F.lit(0.5).alias("confidence"))


def every_edge(spark, sf_dir):
    return candidate_edges(spark, sf_dir).unionByName(line_edges(spark, sf_dir))


@catalog.add("gr4_adjacency", f"WITH {ALL_EDGES_CTE} SELECT * FROM every UNION ALL SELECT target, source, 'reverse::' || relation, confidence FROM every")
def adjacency(spark, sf_dir):
    return G.adjacency(every_edge(spark, sf_dir))


@catalog.add(
    "gr5_bounded_walk",
    f"""WITH {ALL_EDGES_CTE}, e AS (SELECT source, target, max(relation NOT LIKE 'candidate%') AS plain, max(confidence) AS confidence FROM every GROUP BY ALL), seeds AS (SELECT row_number() OVER (ORDER BY key) AS qid, key AS node FROM g),
        one AS (SELECT qid, e.target AS node, plain, e.confidence FROM seeds JOIN e ON e.source = seeds.node WHERE e.target <> seeds.node QUALIFY row_number() OVER (PARTITION BY qid ORDER BY plain DESC, e.confidence DESC, e.target) <= 8),
        two AS (SELECT qid, e.target AS node, TRUE AS plain, max(e.confidence) AS confidence FROM one JOIN e ON e.source = one.node WHERE one.plain AND e.plain AND (qid, e.target) NOT IN (SELECT (qid, node) FROM one) AND (qid, e.target) NOT IN (SELECT (qid, node) FROM seeds) GROUP BY qid, e.target),
        every_hop AS (SELECT *, 1 AS hop FROM one UNION ALL SELECT *, 2 FROM two)
        SELECT qid, node, hop, row_number() OVER (PARTITION BY qid ORDER BY hop, plain DESC, confidence DESC, node) AS place FROM every_hop QUALIFY place <= 8""",
)
def bounded_walk(spark, sf_dir):
    """Every page is a query of its own: its candidate edges lead one hop, shared lines two."""
    seeds, _ = in_order(graph_pages(spark, sf_dir).select("key"), [F.asc("key")], place="qid")
    return G.bounded_walk(seeds.select("qid", F.col("key").alias("node")), every_edge(spark, sf_dir))


@catalog.add("jn20_two_hops", "WITH edges AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN customer ON s_nationkey + 1 = c_nationkey), one AS (SELECT DISTINCT a, b, 1 AS hop FROM edges), two AS (SELECT DISTINCT x.a, y.b, 2 AS hop FROM edges x JOIN edges y ON x.b = y.a) SELECT a, b, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY a, b")
def two_hops(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    e = s.select(F.col("s_nationkey").alias("a")).distinct().join(c.select(F.col("c_nationkey").alias("b")).distinct(), F.col("a") + 1 == F.col("b"))
    two = e.join(e.toDF("m", "c"), F.col("b") == F.col("m")).select("a", F.col("c").alias("b"))
    return e.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2))).groupBy("a", "b").agg(F.min("hop").alias("hop"))


@catalog.add(
    "gr6_graph_candidates",
    f"""WITH {ALL_EDGES_CTE}, base AS (SELECT item_id AS qid, 'd' || doc_id || '::p1' AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''), extra AS (SELECT DISTINCT qid, target AS id FROM base JOIN every ON source = id WHERE (qid, target) NOT IN (SELECT (qid, id) FROM base))
        SELECT DISTINCT qid, id, 0.0164::DOUBLE AS rrf FROM base UNION ALL SELECT qid, id, 0.08 FROM extra""",
)
def graph_candidates(spark, sf_dir):
    """Pages that an edge leads to from a question's candidates join them with a fixed score, if they are not there yet."""
    held = sets.contained_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    folder = shared_folder(spark, "candidates")
    held.select(F.col("item_id").alias("qid"), "doc_id").distinct().write.parquet(folder)  # few rows, which four steps read
    held = spark.read.parquet(folder)
    base = held.select("qid", F.concat(F.lit("d"), "doc_id", F.lit("::p1")).alias("id"))
    steps = base.join(edges_from(spark, sf_dir, base.select("id"), held.select("doc_id")), F.col("id") == F.col("source")).select("qid", F.col("target").alias("id")).distinct()
    extra = steps.join(base, ["qid", "id"], "left_anti")
    return base.withColumn("rrf", F.lit(0.0164)).unionByName(extra.withColumn("rrf", F.lit(0.08)))


def edges_from(spark, sf_dir, keys, docs):
    """The rows of ``every_edge`` that begin in given pages (``id``) and documents: no other group is tagged, no other line counted.

    Both ends of a candidate edge are of one group.  A line links its least document, so it counts only if a given one has it.
    """
    pages = X.PAGES.frame(spark, sf_dir)
    key = F.concat("doc_id", F.lit("::p"), "page_number")
    groups = pages.select(key.alias("id"), G.group_id(F.col("packet_id"), F.col("doc_id")).alias("group_id")).join(keys, "id", "left_semi").select("group_id").distinct()
    return G.candidate_edges(graph_pages(spark, sf_dir, groups).drop("text")).unionByName(line_edges(spark, sf_dir, docs))


@catalog.add("gr7_group_ids", "WITH " + X.PAGES.whole() + " SELECT doc_id, page_number, CASE WHEN trim(coalesce(packet_id, ''), ' ') <> '' THEN 'packet::' || trim(packet_id, ' ') ELSE 'doc::' || doc_id END AS group_id FROM fixture_pages")
def group_ids(spark, sf_dir):
    return X.PAGES.frame(spark, sf_dir).select("doc_id", "page_number", G.group_id(F.col("packet_id"), F.col("doc_id")).alias("group_id"))


SHARED_CTE = "ln AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), heads AS (SELECT line, min(doc_id) AS a FROM ln WHERE length(line) >= 60 GROUP BY line HAVING count(*) > 1), e AS (SELECT DISTINCT a, doc_id AS b FROM heads JOIN ln USING (line) WHERE doc_id <> a)"


@catalog.add(
    "gr8_shared_line_components",
    f"""WITH RECURSIVE {SHARED_CTE}, sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, b.b FROM reach r JOIN sides b ON b.a = r.seen)
        SELECT node, min(seen) AS component FROM reach GROUP BY node""",
)
def shared_line_components(spark, sf_dir):
    return G.components(shared_lines(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node")))


def shared_lines(spark, sf_dir, of=None):
    """Edges between documents that share a long line; each line links to its least document, one of ``of`` (``doc_id``) if given."""
    docs = table(spark, sf_dir, "documents")
    ln = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.xxhash64(F.trim("l")).alias("line"), F.length(F.trim("l")).alias("n")).where("n >= 60").select("doc_id", "line")
    if of is not None:
        ln = ln.join(ln.join(of, "doc_id", "left_semi").select("line").distinct(), "line", "left_semi")
    ln = ln.distinct()
    heads = ln.groupBy("line").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return ln.join(heads, "line").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


@catalog.add(
    "gr9_navigation_arms",
    f"""WITH {VECTORS_CTE}, anchors AS (SELECT DISTINCT id FROM near WHERE rank <= 2), hop AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(round(list_dot_product(q.v, d.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10) * (sqrt(list_dot_product(d.v, d.v)) + 1e-10)), 9), 6) AS score FROM unit q, unit d WHERE q.vec_id IN (SELECT id FROM anchors)),
        far AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hop) WHERE rank <= 3), arms AS (SELECT qid, id, 1 AS arm, rank FROM near WHERE rank <= 2 UNION ALL SELECT n.qid, m.id, 2, n.rank * 100 + m.rank FROM near n JOIN far m ON m.qid = n.id WHERE n.rank <= 2),
        firsts AS (SELECT qid, id, min(arm * 100000 + rank) AS k FROM arms GROUP BY ALL) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS place FROM firsts QUALIFY place <= 3""",
)
def navigation_arms(spark, sf_dir):
    """Anchors first, then the neighbours of every anchor among all vectors; the first three distinct ones."""
    from pyspark.sql import Window

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = near_vectors(spark, sf_dir, 2).select("qid", "id", "rank")
    anchors = vectors.join(n.select(F.col("id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    m = index.dense_top_k(vectors, anchors, 3).select(F.col("qid").alias("anchor"), F.col("id").alias("far"), F.col("rank").alias("far_rank"))
    more = n.join(m, n.id == m.anchor).select("qid", F.col("far").alias("id"), (F.lit(200000) + F.col("rank") * 100 + F.col("far_rank")).alias("k"))
    firsts = n.select("qid", "id", (F.col("rank") + 100000).alias("k")).unionByName(more).groupBy("qid", "id").agg(F.min("k").alias("k"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("k", "id"))).where("place <= 3").select("qid", "id", "place")


@catalog.add("jn8_policy_guard", "WITH " + X.PAGES.cte() + " SELECT s.source AS a, t.source AS b FROM fixture_pages s JOIN fixture_pages t ON s.page_number = t.page_number AND s.source < t.source WHERE NOT coalesce(s.policy_number <> t.policy_number, FALSE)")
def policy_guard(spark, sf_dir):
    """Pairs across two different known policy numbers are dropped; unknown ones pass."""
    p = X.PAGES.frame(spark).select("page_number", F.struct("source", "policy_number").alias("s"))
    pairs = p.join(p.withColumnRenamed("s", "t"), "page_number").where("s.source < t.source")
    return pairs.where(~F.coalesce(F.col("s.policy_number") != F.col("t.policy_number"), F.lit(False))).select(F.col("s.source").alias("a"), F.col("t.source").alias("b"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
