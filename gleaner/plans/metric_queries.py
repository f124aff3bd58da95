"""Metrics over vector search, events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.operators import metrics as M
from gleaner.plans.base import Catalog, Relation, table
from gleaner.plans.rank_queries import VECTORS_CTE, near_vectors

catalog = Catalog()

PER_CTE = f"""{VECTORS_CTE}, gold AS (SELECT q.vec_id AS qid, q.label, d.vec_id AS id FROM unit q JOIN unit d USING (label) WHERE q.vec_id % 100 = 0), sizes AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid),
    hits AS (SELECT qid, rank FROM near JOIN gold USING (qid, id)),
    per AS (SELECT qid, n_gold, coalesce(max((rank <= 1)::INTEGER), 0) AS hit1, coalesce(max((rank <= 5)::INTEGER), 0) AS hit5, coalesce(max((rank <= 10)::INTEGER), 0) AS hit10, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr,
        count(*) FILTER (rank <= 10) AS in10, count(*) FILTER (rank <= 5) AS in5, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 10), 0) AS dcg, min(rank) AS first FROM sizes LEFT JOIN hits USING (qid) GROUP BY qid, n_gold),
    ideal AS (SELECT qid, sum(1 / log2(i + 1.0::DOUBLE)) AS idcg FROM (SELECT qid, unnest(range(1, least(10, n_gold) + 1)) AS i FROM sizes) GROUP BY qid)"""


def per_query(spark, sf_dir):
    """A vector's gold rows are those of its label; they are counted, not listed."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    counts = v.groupBy("label").agg(F.count("*").alias("n_gold"))
    sizes = v.where("vec_id % 100 = 0").join(counts, "label").select(F.col("vec_id").alias("qid"), "n_gold")
    near = near_vectors(spark, sf_dir).join(v.toDF("qid", "own"), "qid").join(v.toDF("id", "other"), "id")
    return M.ranking_metrics(near.where("own = other").select("qid", "rank"), sizes)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@catalog.add("mt1_hits_mrr_recall", f"WITH {PER_CTE} SELECT qid, hit1, hit5, hit10, round(mrr, 6) AS mrr, round(in10 / n_gold::DOUBLE, 6) AS label_recall10 FROM per")
def hits(spark, sf_dir):
    return rounded(per_query(spark, sf_dir).select("qid", "hit1", "hit5", "hit10", "mrr", "label_recall10"), "mrr", "label_recall10")


@catalog.add("mt2_ndcg", f"WITH {PER_CTE} SELECT qid, round(dcg / idcg, 6) AS ndcg10, first IS NOT NULL AS candidate_hit FROM per JOIN ideal USING (qid)")
def ndcg(spark, sf_dir):
    return per_query(spark, sf_dir).select("qid", F.round("ndcg10", 6).alias("ndcg10"), F.col("first").isNotNull().alias("candidate_hit"))


@catalog.add("mt3_complete_evidence", f"WITH {PER_CTE} SELECT qid, (in5 = n_gold)::INTEGER AS complete5, round(in5 / n_gold::DOUBLE, 6) AS recall5 FROM per")
def complete(spark, sf_dir):
    return rounded(per_query(spark, sf_dir).select("qid", "complete5", "recall5"), "recall5")


@catalog.add("mt4_page_metrics", f"WITH {PER_CTE} SELECT qid, hit1, hit5, round(mrr, 6) AS mrr, round(coalesce(1 / log2(first + 1.0::DOUBLE), 0), 6) AS first_ndcg FROM per")
def page_metrics(spark, sf_dir):
    return rounded(per_query(spark, sf_dir).select("qid", "hit1", "hit5", "mrr", "first_ndcg"), "mrr", "first_ndcg")


@catalog.add("mt5_gold_resolution", "SELECT e.event_id, d.doc_id FROM events e JOIN documents d ON e.user_id = d.doc_id UNION SELECT e.event_id, d.doc_id FROM events e JOIN documents d ON e.event_id = d.doc_id")
def gold_resolution(spark, sf_dir):
    """A reference may name either of two keys: a union of equi-joins instead of an OR."""
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents").select("doc_id")
    by = lambda key: e.join(d, e[key] == d.doc_id).select("event_id", "doc_id")
    return by("user_id").union(by("event_id")).distinct()


def sql_wilson(s: str, n: str, sign: str) -> str:
    z = M.Z
    bound = "greatest(0, {})" if sign == "-" else "least(1, {})"
    return "round(" + bound.format(f"(({s} / {n}::DOUBLE + {z * z}::DOUBLE / (2 * {n})) {sign} {z}::DOUBLE * sqrt({s} / {n}::DOUBLE * (1 - {s} / {n}::DOUBLE) / {n} + {z * z}::DOUBLE / (4 * {n} * {n}))) / (1 + {z * z}::DOUBLE / {n})") + ", 6)"


@catalog.add("mt7_macro_wilson", f"WITH {PER_CTE}, t AS (SELECT sum(hit10) AS s, count(*) AS n, avg(mrr) AS mrr FROM per) SELECT n, round(s / n::DOUBLE, 6) AS hit10, round(mrr, 6) AS mrr, {sql_wilson('s', 'n', '-')} AS low, {sql_wilson('s', 'n', '+')} AS high FROM t")
def macro(spark, sf_dir):
    t = per_query(spark, sf_dir).agg(F.sum("hit10").alias("s"), F.count("*").alias("n"), F.avg("mrr").alias("mrr"))
    low, high = M.wilson(F.col("s"), F.col("n"))
    return t.select("n", F.round(F.col("s") / F.col("n"), 6).alias("hit10"), F.round("mrr", 6).alias("mrr"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@catalog.add("mt8_wilson_by_kind", f"WITH t AS (SELECT event_type, count(*) FILTER (value > 50) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type, s, n, {sql_wilson('s', 'n', '-')} AS low, {sql_wilson('s', 'n', '+')} AS high FROM t")
def wilson_by_kind(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("s"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("s"), F.col("n"))
    return t.select("event_type", "s", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@catalog.add("mt9_grouping_sets", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())")
def grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM _documents GROUP BY GROUPING SETS ((lang), (lang, source), ())")


PAIRS = "replies AS (SELECT a.conv_id, a.turn, lower(trim(regexp_replace(a.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS p, lower(trim(regexp_replace(u.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS r FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant')"
F1_TAIL = """pw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(p, ' ')) AS w FROM replies) GROUP BY ALL), rw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(r, ' ')) AS w FROM replies) GROUP BY ALL),
    same AS (SELECT conv_id, turn, sum(least(pw.n, rw.n)) AS same FROM pw JOIN rw USING (conv_id, turn, w) GROUP BY ALL),
    f1 AS (SELECT conv_id, turn, (p = r)::INTEGER AS exact, round(coalesce(2 * (same / len(string_split(p, ' '))::DOUBLE) * (same / len(string_split(r, ' '))::DOUBLE) / ((same / len(string_split(p, ' '))::DOUBLE) + (same / len(string_split(r, ' '))::DOUBLE)), 0), 6) AS f1 FROM replies LEFT JOIN same USING (conv_id, turn))"""
F1_CTE = f"{PAIRS}, {F1_TAIL}"


def answer_f1(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    user = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    rows = c.where("role = 'assistant'").join(user, ["conv_id", "turn"])
    plain = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0b]+", " ")))
    exact = rows.select("conv_id", "turn", (plain(F.col("text")) == plain(F.col("reference"))).cast("int").alias("exact"))
    scored = M.token_f1(rows, ["conv_id", "turn"], "text", "reference")
    return exact.join(scored.withColumn("f1", F.round("f1", 6)), ["conv_id", "turn"])


@catalog.add("mt10_answer_f1", f"WITH {F1_CTE} SELECT * FROM f1")
def answers(spark, sf_dir):
    return answer_f1(spark, sf_dir)


@catalog.add("mt12_prediction_set", f"WITH {F1_CTE} SELECT count(*) AS n, round(avg(exact), 6) AS exact, round(avg(f1), 6) AS f1 FROM f1")
def prediction_set(spark, sf_dir):
    return answer_f1(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("f1"), 6).alias("f1"))


CITED = Relation("fixture_cited", "cid int, predicted array<string>, gold array<string>", [(1, ["a.pdf#page=1", "x"], ["A.pdf#page=1"]), (2, [], ["b"]), (3, ["guide"], ["the guide book"]), (4, ["q", "r"], ["s"])])


@catalog.add("mt11_citation_precision", f"WITH {CITED.cte()} SELECT cid, coalesce(round(len(list_filter(predicted, lambda p: len(list_filter(gold, lambda g: contains(lower(g), lower(p)) OR contains(lower(p), lower(g)))) > 0)) / nullif(len(predicted), 0)::DOUBLE, 6), 0) AS precision FROM fixture_cited")
def citation_precision(spark, sf_dir):
    hit = lambda p: F.exists("gold", lambda g: F.lower(g).contains(F.lower(p)) | F.lower(p).contains(F.lower(g)))
    share = F.try_divide(F.size(F.filter("predicted", hit)), F.size("predicted"))
    return CITED.frame(spark).select("cid", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("precision"))


@catalog.add("mt13_answer_summary", "SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 6) AS even_mean, round(avg((value > 50)::INTEGER), 6) AS share, count(*) AS n FROM events GROUP BY 1")
def answer_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 6).alias("even_mean"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("share"), F.count("*").alias("n"))


@catalog.add("mt14_latency_percentiles", "SELECT event_type, list_sort(list(value))[floor(0.5::DOUBLE * (count(*) - 1))::INTEGER + 1] AS p50, list_sort(list(value))[floor(0.95::DOUBLE * (count(*) - 1))::INTEGER + 1] AS p95 FROM events GROUP BY 1")
def latency(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(M.lower_percentile(F.col("value"), 0.5).alias("p50"), M.lower_percentile(F.col("value"), 0.95).alias("p95"))


@catalog.add("mt15_interpolated_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def interpolated(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


PLAIN_TEXT = "lower(trim(regexp_replace({0}.text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '))"
TAXONOMY_CTE = f"""{VECTORS_CTE}, others AS (SELECT n.qid, n.id, n.score, a.label = b.label AS same, row_number() OVER (PARTITION BY n.qid ORDER BY n.rank) AS k FROM near n JOIN unit a ON a.vec_id = n.qid JOIN unit b ON b.vec_id = n.id WHERE n.id <> n.qid),
    judged AS (SELECT qid, bool_or(same AND k <= 5) AS hit, bool_or(same AND k = 1) AS evidence, max(CASE WHEN k = 1 THEN id END) AS id, max(CASE WHEN k = 1 THEN score END) < 0.5 AS abstain FROM others GROUP BY qid), sure AS (SELECT vec_id AS qid, count(*) OVER (PARTITION BY label) > 1 AS answerable FROM unit),
    replies AS (SELECT j.qid AS conv_id, j.id AS turn, {PLAIN_TEXT.format('d')} AS p, {PLAIN_TEXT.format('u')} AS r FROM judged j JOIN documents d ON d.doc_id = j.id JOIN documents u ON u.doc_id = j.qid), {F1_TAIL},
    typed AS (SELECT qid, CASE WHEN NOT answerable THEN CASE WHEN abstain THEN 'none' ELSE 'unsupported_false_positive' END WHEN NOT hit THEN 'retrieval_miss' WHEN NOT evidence THEN 'citation_mismatch' WHEN abstain OR coalesce(f1, 0) <= 0.05 THEN 'weak_answer_extraction' ELSE 'none' END AS error_type
        FROM judged JOIN sure USING (qid) LEFT JOIN f1 ON conv_id = qid AND turn = judged.id)"""


@catalog.add("mt16_error_taxonomy", f"WITH {TAXONOMY_CTE} SELECT * FROM typed")
def taxonomy(spark, sf_dir):
    """A vector's best neighbour is its cited answer: right if of the same label, and as good as its document's words."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    labels = v.groupBy("label").agg((F.count("*") > 1).alias("answerable"))
    near = near_vectors(spark, sf_dir).where("id <> qid").join(v.join(labels, "label").toDF("own", "qid", "answerable"), "qid").join(v.toDF("id", "other"), "id")
    rows = near.withColumn("same", F.col("own") == F.col("other")).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    top = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    judged = rows.groupBy("qid", "answerable").agg(F.bool_or(F.col("same") & (F.col("k") <= 5)).alias("hit"), top("same").alias("evidence"), top("id").alias("id"), (top("score") < 0.5).alias("abstain"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = judged.select("qid", "id").join(d.toDF("id", "answer"), "id").join(d.toDF("qid", "reference"), "qid")
    f1 = M.token_f1(texts, ["qid", "id"], "answer", "reference")
    f1 = f1.select("qid", "id", F.round("f1", 6).alias("f1"))
    kind = M.error_type(F.col("answerable"), F.col("abstain"), F.col("hit"), F.lit(True), F.col("evidence"), F.coalesce("f1", F.lit(0.0)))
    return judged.join(f1, ["qid", "id"], "left").select("qid", F.coalesce(kind, F.lit("none")).alias("error_type"))


@catalog.add("mt17_error_counts", f"WITH {TAXONOMY_CTE} SELECT error_type, count(*) AS n FROM typed GROUP BY 1")
def error_counts(spark, sf_dir):
    return taxonomy(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n"))


SCORED = "scored AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS confidence, quality = 1 AS answerable, toxic = 0 AS correct FROM labels)"
CURVE = f"""{SCORED}, th AS (SELECT i, i / 20.0::DOUBLE AS t FROM range(21) r(i)), sums AS (SELECT round(t, 2) AS threshold, count(*) FILTER (up) AS answered, count(*) AS n, count(*) FILTER (up AND answerable) AS aa, count(*) FILTER (answerable) AS al, count(*) FILTER (up AND answerable AND correct) AS good, count(*) FILTER (NOT up AND NOT answerable) AS declined, count(*) FILTER (NOT answerable) AS un
    FROM (SELECT *, confidence * 20 + 1e-9 >= i AS up FROM scored, th) GROUP BY t), curve AS (SELECT threshold, round(answered / n::DOUBLE, 6) AS coverage, coalesce(round(aa / nullif(al, 0)::DOUBLE, 6), 0) AS answerable_coverage, coalesce(round((answered - good) / nullif(answered, 0)::DOUBLE, 6), 0) AS selective_risk, coalesce(round(good / nullif(aa, 0)::DOUBLE, 6), 0) AS accuracy, coalesce(round(declined / nullif(un, 0)::DOUBLE, 6), 0) AS abstention FROM sums)"""


def scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 37 % 101 / 100).alias("confidence"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("correct"))


@catalog.add("mt18_calibration_curve", f"WITH {CURVE} SELECT * FROM curve")
def calibration(spark, sf_dir):
    return M.calibration_curve(scored(spark, sf_dir))


@catalog.add("mt19_threshold_pick", f"WITH {CURVE} SELECT * FROM curve ORDER BY (selective_risk <= 0.35) DESC, CASE WHEN selective_risk <= 0.35 THEN -coverage ELSE selective_risk END, CASE WHEN selective_risk <= 0.35 THEN -abstention ELSE 0 END, threshold LIMIT 1")
def threshold_pick(spark, sf_dir):
    """Enough safety first: the widest coverage under the risk bound, else the least risk."""
    safe = F.col("selective_risk") <= 0.35
    return M.calibration_curve(scored(spark, sf_dir)).orderBy(safe.desc(), F.when(safe, -F.col("coverage")).otherwise(F.col("selective_risk")), F.when(safe, -F.col("abstention")).otherwise(0.0), "threshold").limit(1)


@catalog.add("mt20_ratio_metrics", f"WITH {SCORED} SELECT count(*) FILTER (answerable AND correct) AS success, count(*) FILTER (answerable) AS eligible, round(count(*) FILTER (answerable AND correct) / nullif(count(*) FILTER (answerable), 0)::DOUBLE, 6) AS rate, round(count(*) FILTER (NOT answerable AND confidence < 0.2) / nullif(count(*) FILTER (NOT answerable), 0)::DOUBLE, 6) AS declined, round(count(*) FILTER (confidence >= 0.2) / count(*)::DOUBLE, 6) AS answered FROM scored")
def ratios(spark, sf_dir):
    """Each ratio has its own denominator; one without rows is null."""
    a, c, conf = F.col("answerable"), F.col("correct"), F.col("confidence")
    ratio = lambda x, y: F.round(F.try_divide(F.count_if(x), F.count_if(y)), 6)
    return scored(spark, sf_dir).agg(F.count_if(a & c).alias("success"), F.count_if(a).alias("eligible"), ratio(a & c, a).alias("rate"), ratio(~a & (conf < 0.2), ~a).alias("declined"), ratio(conf >= 0.2, F.lit(True)).alias("answered"))


@catalog.add("mt21_cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    """Share of long documents, resampled by source; the sums by cluster are all that is drawn from."""
    rows = table(spark, sf_dir, "documents").select("source", (F.col("n_chars") > 2000).cast("int").alias("num"), F.lit(1).alias("den"))
    return M.bootstrap(rows, "source").agg(F.round(F.avg("ratio"), 4).alias("mean"), F.round(F.percentile("ratio", 0.025), 4).alias("low"), F.round(F.percentile("ratio", 0.975), 4).alias("high"))


@catalog.add("mt22_paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """The difference of two shares of the same documents, resampled by source."""
    rows = table(spark, sf_dir, "documents").select("source", ((F.col("n_chars") > 2000).cast("int") - (F.col("n_chars") % 2).cast("int")).alias("num"), F.lit(1).alias("den"))
    return M.bootstrap(rows, "source").agg(F.round(F.avg("ratio"), 4).alias("mean"), F.round(F.percentile("ratio", 0.025), 4).alias("low"), F.round(F.percentile("ratio", 0.975), 4).alias("high"))


@catalog.add("mt25_packet_bootstrap")
def packet_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "assistant").cast("int").alias("num"), F.lit(1).alias("den"))
    return M.bootstrap(rows, "conv_id", 50).agg(F.round(F.percentile("ratio", 0.025), 4).alias("low"), F.round(F.percentile("ratio", 0.975), 4).alias("high"))


@catalog.add("mt24_metric_table", f"WITH {PER_CTE}, long AS (SELECT qid, unnest(['hit1', 'hit10', 'mrr']) AS metric, unnest([hit1::DOUBLE, hit10::DOUBLE, mrr]) AS value FROM per) SELECT metric, round(avg(value), 6) AS mean, count(*) FILTER (value > 0.5) AS above FROM long GROUP BY metric")
def metric_table(spark, sf_dir):
    long = per_query(spark, sf_dir).select("qid", F.col("hit1").cast("double"), F.col("hit10").cast("double"), "mrr").unpivot("qid", ["hit1", "hit10", "mrr"], "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 0.5).alias("above"))


@catalog.add("mt27_stratum_summary", "SELECT lang, round(avg(quality), 6) AS quality, round(avg(toxic) FILTER (quality = 0), 6) AS toxic_when_poor, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def strata(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(F.when(F.col("quality") == 0, F.col("toxic"))), 6).alias("toxic_when_poor"), F.count("*").alias("n"))


@catalog.add("mt30_ambiguous_questions", "SELECT sha256(text) AS key, count(DISTINCT source) AS n_sources FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def ambiguous(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "source")
    return keyed.groupBy("key").agg(F.countDistinct("source").alias("n_sources")).where("n_sources > 1")


@catalog.add("mt31_dataset_summary", "SELECT count(*) AS rows, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS chars, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM documents")
def summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("chars"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@catalog.add("win1_running_state", "SELECT event_id, user_id, row_number() OVER w AS k, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, lead(event_id) OVER w AS next_id, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def running(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).alias("k"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lead("event_id").over(w).alias("next_id"), F.first("event_id").over(w).alias("first_id"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
