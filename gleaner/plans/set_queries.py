"""Dedup, decontamination, isolation, validation and diffs over documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.functions import text as T
from gleaner.operators import sets
from gleaner.operators.order import in_order
from gleaner.plans import fixtures as X
from gleaner.plans.base import Catalog, Relation, sql_any, table
from gleaner.plans.text_queries import SQL_COLLAPSED

catalog = Catalog()

FOLDED = "lower(" + SQL_COLLAPSED.format("text") + ")"
ALNUM = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@catalog.add("st1_merged_first_wins", "WITH rows AS (SELECT 1 AS file, doc_id, text, source FROM documents UNION ALL SELECT 2, doc_id + 1000000, text, source FROM documents WHERE lang = 'en') SELECT file, doc_id FROM rows QUALIFY row_number() OVER (PARTITION BY sha256(text), source ORDER BY file, doc_id) = 1")
def merged_first_wins(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), "source", "lang")
    second = d.where("lang = 'en'").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    rows = d.withColumn("file", F.lit(1)).unionByName(second.withColumn("file", F.lit(2)))
    return sets.first_wins(rows, ["key", "source"], ["file", "doc_id"]).select("file", "doc_id")


@catalog.add("st2_exact_dedup", f"SELECT sha256({FOLDED}) AS key, min(doc_id) AS doc_id, count(*) AS copies, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def exact_dedup(spark, sf_dir):
    return sets.merged_copies(documents(spark, sf_dir), T.folded(F.col("text"))).withColumn("sources", F.array_join("sources", ","))


@catalog.add("src18_provenance_merge", f"SELECT sha256({ALNUM}) AS key, min(doc_id) AS doc_id, count(*) AS copies, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def provenance_merge(spark, sf_dir):
    return sets.merged_copies(documents(spark, sf_dir), T.alnum_key(F.col("text"))).withColumn("sources", F.array_join("sources", ","))


@catalog.add("st3_ambiguous_dropped", "WITH qa AS (SELECT u.conv_id, u.turn, lower(trim(u.text, ' ')) AS q, sha256(a.text) AS ans FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user') SELECT conv_id, turn FROM qa WHERE q IN (SELECT q FROM qa GROUP BY q HAVING count(DISTINCT ans) = 1)")
def ambiguous_dropped(spark, sf_dir):
    """Questions with several different answers go; a hashed question is what is shuffled."""
    c = table(spark, sf_dir, "conversations")
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.sha2("text", 256).alias("ans"))
    qa = c.where("role = 'user'").select("conv_id", "turn", F.sha2(F.lower(F.trim("text")), 256).alias("q")).join(answer, ["conv_id", "turn"])
    clear = qa.groupBy("q").agg(F.countDistinct("ans").alias("n")).where("n = 1")
    return qa.join(clear, "q", "left_semi").select("conv_id", "turn")


@catalog.add("st4_contained_passages", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contained(spark, sf_dir):
    return sets.contained_passages(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


REASONS = "CASE WHEN doc_id IN (SELECT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) THEN 'passage' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'poor' WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END"


@catalog.add("st5_reason_cascade", f"SELECT doc_id, {REASONS} AS reason FROM documents")
def cascade(spark, sf_dir):
    """One reason a document, the first that holds."""
    d = documents(spark, sf_dir)
    hit = sets.contained_passages(d.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct().withColumn("passage", F.lit(True))
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("poor"))
    keyed = d.select("doc_id", F.sha2("text", 256).alias("key")).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")))
    rows = keyed.join(hit, "doc_id", "left").join(poor, "doc_id", "left")
    reason = F.when(F.col("passage"), "passage").when(F.col("poor"), "poor").when(F.col("k") > 1, "duplicate").otherwise("kept")
    return rows.select("doc_id", reason.alias("reason"))


@catalog.add("st6_held_out_texts", f"WITH held AS (SELECT DISTINCT {ALNUM} AS key FROM documents WHERE source = 'src0') SELECT doc_id FROM documents WHERE source <> 'src0' AND {ALNUM} NOT IN (SELECT key FROM held)")
def held_out_texts(spark, sf_dir):
    keyed = documents(spark, sf_dir).select("doc_id", "source", F.sha2(T.alnum_key(F.col("text")), 256).alias("key"))
    return keyed.where("source <> 'src0'").join(keyed.where("source = 'src0'").select("key"), "key", "left_anti").select("doc_id")


@catalog.add("st7_source_closure", "SELECT DISTINCT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE source IN ('src1', 'src2'))")
def closure(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("text"))
    return sets.source_closure(rows, spark.createDataFrame([("src1",), ("src2",)], "source string"))


@catalog.add("jn15_isolation", f"WITH held AS (SELECT doc_id, source, {ALNUM} AS key FROM documents WHERE source = 'src3') SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM held) AND {ALNUM} NOT IN (SELECT key FROM held) AND source NOT IN (SELECT source FROM held)")
def isolation(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source", "text")
    return sets.isolated(d, d.where("source = 'src3'"), "doc_id", "text", "source").select("doc_id")


TEST_SOURCES = "SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1"
VALID_SOURCES = "SELECT source FROM documents WHERE lang = 'de' AND n_chars > 20000"


@catalog.add("st8_group_disjoint", f"SELECT 'valid' AS split, doc_id FROM documents WHERE lang = 'de' AND source NOT IN ({TEST_SOURCES}) UNION ALL SELECT 'train', doc_id FROM documents WHERE lang = 'en' AND source NOT IN ({TEST_SOURCES}) AND source NOT IN ({VALID_SOURCES})")
def group_disjoint(spark, sf_dir):
    """Validation rows without the test's sources; training rows without those of either."""
    d, l = documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    test = d.join(l.where("quality = 0 AND toxic = 1"), "doc_id", "left_semi").select("source").distinct()
    valid = d.where("lang = 'de' AND n_chars > 20000").select("source").distinct()
    v = d.where("lang = 'de'").join(test, "source", "left_anti").select(F.lit("valid").alias("split"), "doc_id")
    t = d.where("lang = 'en'").join(test, "source", "left_anti").join(valid, "source", "left_anti").select(F.lit("train").alias("split"), "doc_id")
    return v.unionByName(t)


@catalog.add("st9_split_audit", "WITH s AS (SELECT source, text, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) SELECT split, count(*) AS n, count(DISTINCT sha256(text)) AS n_texts, count(*) FILTER (text IN (SELECT text FROM s o WHERE o.split <> s.split)) AS overlapping FROM s GROUP BY split")
def split_audit(spark, sf_dir):
    keyed = documents(spark, sf_dir).select(F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    cells = keyed.groupBy("key", "split").agg(F.count("*").alias("n"))
    both = cells.withColumn("splits", F.count("*").over(Window.partitionBy("key")))
    return both.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"), F.sum(F.when(F.col("splits") > 1, F.col("n")).otherwise(0)).alias("overlapping"))


@catalog.add("st10_overlap_audit", "SELECT b.item_id, count(DISTINCT d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def overlap_audit(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    found = sets.contained_passages(documents(spark, sf_dir).select("doc_id", "text"), b)
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return b.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


FIELDS = ["instruction", "evidence", "question", "source", "answer"]


@catalog.add("st11_required_fields", "WITH " + X.SFT.whole() + ", c AS (SELECT rid, list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL) AS m, list_filter([" + ", ".join(f"CASE WHEN trim({f}, ' ') = '' THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL) AS e FROM fixture_sft) SELECT rid, array_to_string(m, ',') AS missing, array_to_string(e, ',') AS empty FROM c")
def required_fields(spark, sf_dir):
    listed = lambda cond: F.array_join(F.array_compact(F.array(*[F.when(cond(F.col(f)), F.lit(f)) for f in FIELDS])), ",")
    return X.SFT.frame(spark, sf_dir).select("rid", listed(lambda c: c.isNull()).alias("missing"), listed(lambda c: F.trim(c) == "").alias("empty"))


@catalog.add("st12_duplicate_keys", "SELECT count(*) AS groups, sum(n)::BIGINT AS records FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_keys(spark, sf_dir):
    """Groups with more than one row, and all rows in them, the first included."""
    keyed = documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return keyed.agg(F.count("*").alias("groups"), F.sum("n").alias("records"))


@catalog.add("st13_split_leakage", "SELECT source, count(DISTINCT lang) AS n_splits, CASE WHEN count(DISTINCT lang) > 1 THEN 'leaks' WHEN count(*) < 2 THEN 'unknown' ELSE 'clean' END AS status FROM documents GROUP BY source")
def split_leakage(spark, sf_dir):
    g = documents(spark, sf_dir).groupBy("source").agg(F.countDistinct("lang").alias("n_splits"), F.count("*").alias("n"))
    return g.select("source", "n_splits", F.when(F.col("n_splits") > 1, "leaks").when(F.col("n") < 2, "unknown").otherwise("clean").alias("status"))


@catalog.add("st14_validation_errors", "SELECT 'blank_text' AS error, count(*) AS n FROM documents WHERE trim(text, ' ') = '' UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'orphan_label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)")
def validation_errors(spark, sf_dir):
    d, l = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    checks = {
        "blank_text": d.where(F.trim("text") == "").select("doc_id"),
        "wrong_length": d.where("n_chars <> length(text)").select("doc_id"),
        "orphan_label": l.join(d, "doc_id", "left_anti").select("doc_id"),
        "repeated_id": d.groupBy("doc_id").count().where("count > 1").select("doc_id"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("error"), "n") for name, df in checks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


FAMILIES = "fam AS (SELECT doc_id, 'id' AS family, sha256(doc_id::VARCHAR) AS print, doc_id % 10 = 0 AS held FROM documents UNION ALL SELECT doc_id, 'text', sha256(text), doc_id % 10 = 0 FROM documents UNION ALL SELECT doc_id, 'source', sha256(source), doc_id % 10 = 0 FROM documents)"


def families(spark, sf_dir):
    d = documents(spark, sf_dir)
    prints = F.array(*[F.struct(F.lit(n).alias("family"), F.sha2(c, 256).alias("print")) for n, c in (("id", F.col("doc_id").cast("string")), ("text", F.col("text")), ("source", F.col("source")))])
    return d.select("doc_id", (F.col("doc_id") % 10 == 0).alias("held"), F.explode(prints).alias("f")).select("doc_id", "held", "f.family", "f.print")


@catalog.add("st15_fingerprint_families", f"WITH {FAMILIES} SELECT family, print, count(*) AS n FROM fam GROUP BY ALL")
def fingerprint_families(spark, sf_dir):
    return families(spark, sf_dir).groupBy("family", "print").agg(F.count("*").alias("n"))


@catalog.add("st16_held_out_audit", f"WITH {FAMILIES} SELECT family, count(*) FILTER (h AND t) AS overlap, count(*) FILTER (h) AS held, family <> 'source' AND count(*) FILTER (h AND t) > 0 AS blocks FROM (SELECT family, print, bool_or(held) AS h, bool_or(NOT held) AS t FROM fam GROUP BY ALL) GROUP BY family")
def held_out_audit(spark, sf_dir):
    sides = families(spark, sf_dir).groupBy("family", "print").agg(F.bool_or("held").alias("h"), F.bool_or(~F.col("held")).alias("t"))
    both = F.count_if(F.col("h") & F.col("t"))
    return sides.groupBy("family").agg(both.alias("overlap"), F.count_if("h").alias("held"), ((F.first("family") != "source") & (both > 0)).alias("blocks"))


@catalog.add("st17_cumulative_provenance", "SELECT DISTINCT source, lang FROM documents WHERE lang IN ('en', 'de') UNION SELECT source, lang FROM documents WHERE lang <> 'en'")
def provenance(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source", "lang")
    return d.where(F.col("lang").isin("en", "de")).select("source", "lang").union(d.where("lang <> 'en'").select("source", "lang")).distinct()


@catalog.add("st18_fixture_constraints", "SELECT 'cross_split_text' AS rule, count(*) AS violations FROM (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id % 2) > 1) UNION ALL SELECT 'span_outside', count(*) FROM documents WHERE NOT contains(text, substring(text, 1, 20))")
def constraints(spark, sf_dir):
    d = documents(spark, sf_dir)
    cross = d.groupBy(F.sha2("text", 256).alias("k")).agg(F.countDistinct(F.col("doc_id") % 2).alias("s")).where("s > 1")
    outside = d.where(~F.col("text").contains(F.substring("text", 1, 20)))
    one = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return one(cross, "cross_split_text").unionByName(one(outside, "span_outside"))


@catalog.add("st19_corpus_concat", "SELECT 'd' || doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'b' || item_id, length(text) FROM benchmark")
def concat(spark, sf_dir):
    d, b = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    part = lambda df, c, p: df.select(F.concat(F.lit(p), c).alias("id"), F.length("text").alias("n"))
    return part(d, "doc_id", "d").unionByName(part(b, "item_id", "b"))


@catalog.add("st20_manifest_compare", "SELECT count(*) AS only_old FROM (SELECT doc_id, n_chars FROM documents EXCEPT ALL SELECT doc_id, length(text) FROM documents)")
def manifest_compare(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", "n_chars").exceptAll(d.select("doc_id", F.length("text").cast("bigint"))).agg(F.count("*").alias("only_old"))


LINES = "list_distinct(list_filter(list_transform(regexp_split_to_array({0}, '\\n+'), lambda s: trim(s, ' ')), lambda s: s <> ''))"
PAIRS = "pairs AS (SELECT doc_id AS key, text AS new, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old FROM documents QUALIFY old IS NOT NULL)"


def version_pairs(spark, sf_dir):
    """Each document against the one before it of the same source; only ids are put in order, whatever a source's size."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    placed, _ = in_order(docs.select("doc_id", "source"), [F.asc("source"), F.asc("doc_id")])
    after = placed.select(F.col("doc_id").alias("key"), (F.col("place") - 1).alias("place"), "source")
    pairs = after.join(placed.withColumnRenamed("doc_id", "before"), ["place", "source"]).select("key", "before")
    texts = docs.select("doc_id", "text")
    with_new = pairs.join(texts.toDF("key", "new"), "key")
    return with_new.join(texts.toDF("before", "old"), "before").select("key", "new", "old").where("old IS NOT NULL")


DIFF_TAIL = f"sides AS (SELECT key, {LINES.format('new')} AS n, {LINES.format('old')} AS o FROM pairs), diffs AS (SELECT key, 'added' AS change, unnest(list_filter(n, lambda x: NOT list_contains(o, x))) AS line FROM sides UNION ALL SELECT key, 'removed', unnest(list_filter(o, lambda x: NOT list_contains(n, x))) FROM sides)"
DIFF_CTE = f"{PAIRS}, {DIFF_TAIL}"


@catalog.add("st21_line_diff", f"WITH {DIFF_CTE} SELECT * FROM diffs")
def line_diff(spark, sf_dir):
    return sets.line_differences(version_pairs(spark, sf_dir))


@catalog.add("st22_sentence_changes")
def sentence_changes(spark, sf_dir, texts=True):
    """Each document against the one before it, and the pages of small documents, sentence by sentence."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    pages = X.PAGES.frame(spark).select(F.xxhash64("doc_id", "page_number").alias("key"), F.lag("text").over(w).alias("old"), F.col("text").alias("new"))
    return sets.sentence_changes(pages.where("old IS NOT NULL").unionByName(version_pairs(spark, sf_dir)), texts)


@catalog.add("st23_change_summary")
def change_summary(spark, sf_dir):
    changes = sentence_changes(spark, sf_dir, texts=False)
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"))


VERSIONS = Relation(
    "fixture_versions", "key bigint, old string, new string",
    [(-1, "Collision Deductible: $500\nRoof Limit: $9\nsame", "Collision Deductible: $750\n\n  Roof Limit: $9 \nsame"), (-2, "This rider excludes mold.\nDUTIES: notify", "You must promptly notify us\nno rule here"), (-3, "a\nb", "b\nc"), (-4, "", "Liability limit, with a deductible"), (-5, "x", "x")],
)
IN_GROUP = {name: sql_any(words, "lower(line)") for name, words in sets.POLICY_GROUPS.items()}


@catalog.add(
    "st24_policy_diff",
    f"""WITH {VERSIONS.cte()}, {PAIRS.replace('pairs AS', 'documents_pairs AS')}, pairs AS (SELECT key, new, old FROM documents_pairs UNION ALL SELECT key, new, old FROM fixture_versions), {DIFF_TAIL},
        n AS (SELECT pairs.key, {', '.join(f"count(*) FILTER ({c}) AS {g}" for g, c in IN_GROUP.items())} FROM pairs LEFT JOIN diffs USING (key) GROUP BY pairs.key), named AS (SELECT *, concat_ws(', ', {', '.join(f"CASE WHEN {g} > 0 THEN '{g}' END" for g in IN_GROUP)}) AS names FROM n)
        SELECT * EXCLUDE names, CASE WHEN names = '' THEN 'No material policy-rule changes detected.' ELSE 'Detected changes in: ' || names || '.' END AS summary FROM named""",
)
def policy_diff(spark, sf_dir):
    """Each document against the one before it, and small versions in the domain's words."""
    return sets.policy_changes(version_pairs(spark, sf_dir).unionByName(VERSIONS.frame(spark)))


@catalog.add("dg18_hash_split", "WITH s AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, row_number() OVER (ORDER BY sha256('seed|' || source)) AS place, count(*) OVER () AS n FROM s) SELECT source, place, CASE WHEN place <= round_even(n * 0.5, 0) THEN 'train' WHEN place <= round_even(n * 0.75, 0) THEN 'valid' ELSE 'test' END AS split FROM p")
def hash_split(spark, sf_dir):
    return sets.hash_split(documents(spark, sf_dir).select("source").distinct(), "seed")


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
