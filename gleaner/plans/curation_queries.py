"""Decontamination, hard negatives and quotas over documents, with benchmark texts as held-out questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import blocks, curate, mining, near, sets
from gleaner.operators.order import in_order
from gleaner.plans.base import Catalog, quoted, table
from gleaner.plans.rank_queries import BOTH_CTE, SQL_KEY, SQL_TERMS, found, questions
from gleaner.session import shared_folder

catalog = Catalog()


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def near_sql(left: str, right: str, threshold: float) -> str:
    """CTEs up to ``nearest`` (id, other, similarity): every pair scored on character 3- to 5-grams."""
    grams = ", ".join(f"list_transform(range(1, length(w) - {n - 2}), lambda i: substr(w, i, {n}))" for n in (3, 4, 5))
    return f"""sides AS (SELECT 'l' AS side, * FROM ({left}) UNION ALL SELECT 'r', * FROM ({right})),
        padded AS (SELECT side, id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) || ' ' AS w FROM sides),
        tfs AS (SELECT side, id, gram, count(*) AS tf FROM (SELECT side, id, unnest(list_concat({grams})) AS gram FROM padded) GROUP BY ALL),
        dfs AS (SELECT gram, ln((1 + (SELECT count(*) FROM sides)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tfs GROUP BY gram HAVING count(*) >= 2),
        weights AS (SELECT side, id, gram, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY side, id)) AS w FROM tfs JOIN dfs USING (gram)),
        firsts AS (SELECT min(id) AS id FROM sides WHERE side = 'r' AND text IS NOT NULL GROUP BY text),
        near AS (SELECT l.id, r.id AS other, sum(l.w * r.w) AS similarity FROM weights l JOIN weights r USING (gram) WHERE l.side = 'l' AND r.side = 'r' AND r.id IN (SELECT id FROM firsts) GROUP BY ALL HAVING sum(l.w * r.w) >= {threshold} - 1e-9),
        nearest AS (SELECT id, other, round(similarity, 6) AS similarity FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(similarity, 6) DESC, other) = 1)"""


NEAREST_FROM, NEAR_FROM = 0.6, 0.92
DOCS_SQL, ITEMS_SQL = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS id, text FROM benchmark"


def near_items(spark, sf_dir, threshold):
    """Of every document the nearest benchmark text from ``threshold`` on."""
    return near.nearest(near.near_texts(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), threshold))


@catalog.add("jn11_nearest_neighbour", f"WITH {near_sql(DOCS_SQL, ITEMS_SQL, NEAREST_FROM)} SELECT * FROM nearest")
def nearest_neighbour(spark, sf_dir):
    return near_items(spark, sf_dir, NEAREST_FROM)


SQL_ALNUM = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')"


@catalog.add(
    "st4_exclusion_reasons",
    f"""WITH {near_sql(DOCS_SQL, ITEMS_SQL, NEAR_FROM)}, gold AS (SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
        marked AS (SELECT doc_id AS id, other, similarity, list_filter([CASE WHEN other IS NOT NULL THEN 'near_held_out' END, CASE WHEN doc_id IN (FROM gold) THEN 'shared_gold' END,
            CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY {SQL_ALNUM}) THEN 'duplicate' END], lambda r: r IS NOT NULL) AS reasons FROM documents LEFT JOIN nearest ON id = doc_id)
        SELECT id, array_to_string(reasons, '+') AS reasons, other, similarity FROM marked WHERE len(reasons) > 0""",
)
def exclusion_reasons(spark, sf_dir):
    """Documents that are near a held-out text, hold one, or repeat an earlier document, with all of their reasons."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    gold = sets.contained_passages(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id"))
    out = near.exclusions(docs, near_items(spark, sf_dir, NEAR_FROM), gold, T.alnum_key(F.col("text")))
    return out.withColumn("reasons", F.array_join("reasons", "+"))


DEPTH = 100
QUOTAS = {"dense": 4, "sparse": 4, "random": 1}
GOLD_CTE = f"""keys AS (SELECT doc_id AS id, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')) AS key FROM documents),
    gold AS (SELECT DISTINCT item_id AS qid, doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''), gold_keys AS (SELECT DISTINCT qid, key FROM gold JOIN keys USING (id)),
    drawn AS (SELECT id, key FROM keys ORDER BY sha256('{mining.SEED}|' || id), id LIMIT {mining.POOL}),
    spare AS (SELECT qid, id, key, row_number() OVER (PARTITION BY qid ORDER BY sha256('{mining.SEED}|' || qid || '|' || id), id) AS rank FROM (SELECT item_id AS qid FROM benchmark), drawn)"""


def _channel_sql(name: str, source: str, quota: int, before: list[str]) -> str:
    keyed = source if source == "spare" else f"(SELECT qid, id, key, rank FROM {source} JOIN keys USING (id))"
    anti = "".join(f" ANTI JOIN {b} USING (qid, key)" for b in ["gold_keys", *before])
    firsts = f"SELECT qid, id, key, rank FROM {keyed}{anti} QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY rank, id) = 1"
    return f"{name} AS (SELECT qid, '{source if source != 'spare' else 'random'}' AS kind, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS place, id, key FROM ({firsts}) QUALIFY place <= {quota})"


MINED_CTE = f"{BOTH_CTE}, {GOLD_CTE}, {_channel_sql('m1', 'dense', 4, [])}, {_channel_sql('m2', 'sparse', 4, ['m1'])}, {_channel_sql('m3', 'spare', 1, ['m1', 'm2'])}, mined AS (FROM m1 UNION ALL FROM m2 UNION ALL FROM m3)"


def mining_inputs(spark, sf_dir):
    """Both ranked lists with text keys, the keys of positives, and each question's random order of a drawn pool."""
    docs, asked, folder = documents(spark, sf_dir), questions(spark, sf_dir), shared_folder(spark, "mining")

    def cut(df, name):
        """Narrow rows that several steps read are made once."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    keys = cut(mining.text_keys(docs), "keys")
    lists = cut(found(spark, sf_dir, DEPTH).join(keys, "id").select("qid", "channel", "id", "key", "rank"), "lists")
    held = sets.contained_passages(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"))
    of = {c: lists.where(F.col("channel") == c).drop("channel") for c in blocks.CHANNELS}
    return docs, asked, of, cut(mining.alias_keys(held, keys), "gold"), cut(mining.random_ranks(asked, keys), "spare")


def mined(spark, sf_dir):
    _, asked, of, gold, spare = mining_inputs(spark, sf_dir)
    return asked, by_quota(of, gold, spare)


def by_quota(of, gold, spare):
    return mining.quota_negatives([("dense", of["dense"], QUOTAS["dense"]), ("sparse", of["sparse"], QUOTAS["sparse"]), ("random", spare, QUOTAS["random"])], gold)


@catalog.add("dg8_quota_mining", f"WITH {MINED_CTE} SELECT qid, kind, place, id FROM mined")
def quota_mining(spark, sf_dir):
    """Four dense, four lexical and one random negative of every question, no text twice and none of a positive's texts."""
    return mined(spark, sf_dir)[1].drop("key")


@catalog.add("dg8_shortages", f"WITH {MINED_CTE} SELECT item_id AS qid, kind, quota - count(id) AS missing FROM benchmark CROSS JOIN (VALUES ('dense', 4), ('sparse', 4), ('random', 1)) q(kind, quota) LEFT JOIN mined ON qid = item_id AND mined.kind = q.kind GROUP BY item_id, q.kind, quota HAVING count(id) < quota".replace("SELECT item_id AS qid, kind,", "SELECT item_id AS qid, q.kind,"))
def mining_shortages(spark, sf_dir):
    """What a channel had too little of, by question: of short texts few documents share a term."""
    return mining.shortages(*mined(spark, sf_dir), QUOTAS)


DEEP, LISTED = 30, 16
FORBIDDEN = "toxic = 1"


def _accepted_sql(name: str, source: str, quota: int | None) -> str:
    keyed = "spare" if source == "spare" else f"(SELECT qid, id, key, rank FROM {source} JOIN keys USING (id) WHERE rank <= {DEEP})"
    limit = "" if quota is None else f" WHERE n <= {quota}"
    return f"{name} AS (SELECT qid, id, key, n AS rank FROM (SELECT qid, id, key, row_number() OVER (PARTITION BY qid ORDER BY s.rank, id) AS n FROM {keyed} s ANTI JOIN gold_keys USING (qid, key) ANTI JOIN barred USING (id)){limit})"


TEACHER_SQL = f"""round(len(list_intersect({SQL_KEY.replace('question', 'b.text')}, {SQL_TERMS.format('d.text', 3)}))::DOUBLE / greatest(1, len({SQL_KEY.replace('question', 'b.text')})), 6)"""
MODEL_CTE = f"""{MINED_CTE}, barred AS (SELECT DISTINCT doc_id AS id FROM labels WHERE {FORBIDDEN}), {_accepted_sql('a1', 'dense', LISTED)}, {_accepted_sql('a2', 'sparse', LISTED)}, {_accepted_sql('a4', 'spare', None)},
    a3 AS (SELECT qid, id, key, row_number() OVER (PARTITION BY qid ORDER BY t, id) AS rank FROM (SELECT qid, id, key, CASE kind WHEN 'dense' THEN place WHEN 'sparse' THEN 100 + place ELSE 200 + place END AS t FROM mined) ANTI JOIN barred USING (id)),
    chosen AS (SELECT qid, id, key FROM (SELECT *, 1 AS step FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3) QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY step, rank, id) = 1),
    rest AS (SELECT qid, id, key, rank FROM a4 ANTI JOIN chosen USING (qid, key) QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY rank, id) = 1),
    filled AS (SELECT r.qid, id, key, row_number() OVER (PARTITION BY r.qid ORDER BY rank, id) AS place, greatest(0, 10 - coalesce(n, 0)) AS wanted FROM rest r LEFT JOIN (SELECT qid, count(*) AS n FROM chosen GROUP BY 1) c ON c.qid = r.qid QUALIFY place <= wanted + 1),
    pool AS (SELECT qid, id, FALSE AS last FROM chosen UNION ALL SELECT qid, id, place > wanted FROM filled),
    scored AS (SELECT p.qid, p.id, p.last, {TEACHER_SQL} AS score FROM pool p JOIN documents d ON d.doc_id = p.id JOIN benchmark b ON b.item_id = p.qid),
    ordered AS (SELECT s.qid, s.id, s.score, a2.rank AS lexical, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.id) AS place, count(*) OVER (PARTITION BY s.qid) AS n FROM scored s LEFT JOIN a2 ON a2.qid = s.qid AND a2.id = s.id WHERE NOT s.last),
    top AS (SELECT qid, id, 'model' AS kind, place FROM ordered WHERE n >= 5 AND place <= 6),
    second AS (SELECT qid, id, 'lexical' AS kind, 6 + m AS place FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY lexical IS NULL, coalesce(lexical, place), id) AS m FROM ordered WHERE n >= 5 AND place > 6) WHERE m <= 4)"""


def model_mined(spark, sf_dir):
    docs, asked, of, gold, spare = mining_inputs(spark, sf_dir)
    barred = table(spark, sf_dir, "labels").where(FORBIDDEN).select(F.col("doc_id").alias("id")).distinct()
    old = by_quota(of, gold, spare)
    turn = F.col("place") + F.when(F.col("kind") == "dense", 0).when(F.col("kind") == "sparse", 100).otherwise(200)
    lists = {c: mining.accepted(of[c].where(F.col("rank") <= DEEP), gold, barred, LISTED) for c in of}
    old = mining.accepted(old.withColumn("rank", turn), gold, barred)
    pool = mining.candidate_pool([("dense", lists["dense"]), ("sparse", lists["sparse"]), ("old", old)], mining.accepted(spare, gold, barred))
    terms = docs.select(F.col("doc_id").alias("id"), T.terms(F.col("text"), 3).alias("terms"))
    wanted = asked.select("qid", T.key_terms(F.col("text")).alias("keys"))
    scored = pool.join(terms, "id").join(wanted, "qid").withColumn("score", mining.overlap(F.col("keys"), F.col("terms"))).select("qid", "id", "source", "score")
    return mining.model_negatives(scored, lists["sparse"])


@catalog.add("dg9_model_hard_negatives", f"WITH {MODEL_CTE} SELECT qid, place, id, kind FROM (FROM top UNION ALL FROM second UNION ALL SELECT qid, id, 'random', 11 FROM scored WHERE last AND qid IN (SELECT qid FROM ordered WHERE n >= 5))")
def model_hard(spark, sf_dir):
    """Six negatives by a teacher's rank, four lexical ones with back-fill and a random one, from a pool of three lists."""
    return model_mined(spark, sf_dir)[0]


# A rule table for the generated texts, whose words are syllables: topics, their questions, and what they must at least have.
LEXICON = {"coverage": ["that", "with"], "limits": ["tion", "thon"], "duties": ["ther", "shre", "thre"], "claims": ["estion", "ingen"]}
VARIANTS = {t: [f"What does the page say about {t}?", f"Which part of the page settles {t}?", f"Explain {t} in one sentence."] for t in LEXICON}
GENERIC = ["What is this page for?", "Name the main point of the page.", "What should a reader check here?"]
MINIMUMS = {"claims": 120, "duties": 150, "limits": 90}
UNSUPPORTED = ["Does the page mention the?", "Does the page mention tion?", "Does the page mention zebra?"]
TARGET, COUNTEREXAMPLES, LINE_WORDS = 1_000, 120, (20, 140)
SQL_WORDS = "regexp_split_to_array(lower(line), '[^a-z0-9]+')"
SQL_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN list_has_any({SQL_WORDS}, {quoted(w)}) THEN '{t}' END" for t, w in LEXICON.items()) + "], lambda t: t IS NOT NULL)"
SQL_HITS = f"len(list_filter({SQL_WORDS}, lambda w: list_contains({quoted([w for ws in LEXICON.values() for w in ws])}, w)))"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


CURATED_CTE = f"""variants(topic, v, question) AS (VALUES {_values([(t, i, q) for t, qs in VARIANTS.items() for i, q in enumerate(qs)])}), generic(g, question) AS (VALUES {_values(list(enumerate(GENERIC)))}),
    quotas(topic, step, quota) AS (VALUES {_values([(t, i, n) for i, (t, n) in enumerate(MINIMUMS.items())])}),
    lined AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    sized AS (SELECT *, {SQL_HITS} AS hits, len(list_filter({SQL_WORDS}, lambda w: w <> '')) AS words FROM lined),
    sn AS (SELECT doc_id, pos, line, {SQL_TOPICS} AS topics, row_number() OVER (ORDER BY hits DESC, words DESC, doc_id, pos) AS s FROM sized WHERE hits >= 2 AND words BETWEEN {LINE_WORDS[0]} AND {LINE_WORDS[1]}),
    r1 AS (SELECT topic, s, question, step, row_number() OVER (PARTITION BY topic ORDER BY s, v) AS k FROM sn JOIN variants ON list_contains(topics, topic) JOIN quotas USING (topic) QUALIFY k <= any_value(quota) OVER (PARTITION BY topic)),
    t1 AS (SELECT row_number() OVER (ORDER BY step, k) AS position, 1 AS round, s, topic, question FROM r1 QUALIFY position <= {TARGET}),
    firsts AS (SELECT s, unnest(f) AS topic, generate_subscripts(f, 1) AS i FROM (SELECT s, (CASE WHEN len(topics) > 0 THEN topics ELSE ['coverage'] END)[1:3] AS f FROM sn)),
    own AS (SELECT s, topic, question, row_number() OVER (PARTITION BY s ORDER BY i, v) - 1 AS j FROM firsts JOIN variants USING (topic)),
    offered AS (SELECT CASE WHEN j < 2 THEN 2 ELSE 3 END AS round, s, j AS slot, topic, question FROM own UNION ALL SELECT CASE WHEN g = 0 THEN 2 ELSE 3 END, s, 1000 + g, 'general', question FROM sn, generic),
    fresh AS (SELECT * FROM offered ANTI JOIN t1 USING (s, question) QUALIFY row_number() OVER (PARTITION BY s, question ORDER BY round, slot) = 1),
    later AS (SELECT row_number() OVER (ORDER BY round, s, slot) + (SELECT count(*) FROM t1) AS position, round, s, topic, question FROM fresh QUALIFY position <= {TARGET}),
    records AS (SELECT position, round, doc_id, pos, topic, question, line FROM (SELECT * FROM t1 UNION ALL SELECT * FROM later) JOIN sn USING (s))"""


def snippets(spark, sf_dir):
    """Lines of a fair length with two words of the lexicon at least, in the builder's order ``s``."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.split(F.lower("line"), "[^a-z0-9]+")
    cues = [w for ws in LEXICON.values() for w in ws]
    sized = lines.withColumn("hits", F.size(F.filter(words, lambda w: w.isin(cues)))).withColumn("words", F.size(F.filter(words, lambda w: w != "")))
    fair = sized.where((F.col("hits") >= 2) & F.col("words").between(*LINE_WORDS)).withColumn("topics", curate.matched_topics(F.col("line"), LEXICON))
    return in_order(fair, [F.desc("hits"), F.desc("words"), F.asc("doc_id"), F.asc("pos")], place="s")[0].drop("hits", "words")


def curated_records(spark, sf_dir):
    rows = snippets(spark, sf_dir)
    pairs = curate.curated(rows.select("s", "topics"), VARIANTS, GENERIC, MINIMUMS, TARGET)
    return pairs.join(rows.select("s", "doc_id", "pos", "line"), "s")


@catalog.add("dg13_curated_quota", f"WITH {CURATED_CTE} SELECT position, round, doc_id, pos, topic, question FROM records")
def curated_quota(spark, sf_dir):
    """A thousand questions over lines: topic quotas, then each line's first questions, then deferred ones."""
    return curated_records(spark, sf_dir).select("position", "round", "doc_id", "pos", "topic", "question")


SQL_ASKED = "CASE idx % 3 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(UNSUPPORTED)) + " END"


def mentions(question, evidence):
    """The last word of the question stands in the evidence."""
    return F.array_contains(F.split(F.lower(evidence), "[^a-z0-9]+"), F.regexp_extract(question, "([a-z]+)[?]$", 1))


@catalog.add(
    "dg13_counterexamples",
    f"""WITH {CURATED_CTE}, n AS (SELECT count(*) AS n FROM records), probes AS (SELECT idx, {SQL_ASKED} AS question FROM range({COUNTEREXAMPLES}) r(idx), n WHERE idx < n),
        far AS (SELECT idx, p.question, position, (n - position - idx + n) % n AS distance FROM probes p, n, records WHERE NOT list_contains({SQL_WORDS}, regexp_extract(p.question, '([a-z]+)[?]$', 1)))
        SELECT idx, question, position FROM far QUALIFY row_number() OVER (PARTITION BY idx ORDER BY distance) = 1""",
)
def curated_counterexamples(spark, sf_dir):
    """Questions that the record beside them does not support."""
    records = curated_records(spark, sf_dir).select("position", F.col("line").alias("evidence"))
    folder = shared_folder(spark, "curated")
    records.write.parquet(folder)
    records = spark.read.parquet(folder)
    return curate.counterexamples(records, records.count(), UNSUPPORTED, mentions, COUNTEREXAMPLES)


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
