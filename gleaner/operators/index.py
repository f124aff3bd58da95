"""Indexes and scoring: postings, BM25, hashed vectors and exact dense search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.functions import text as T

K1, B = 1.5, 0.75
DIMENSIONS = 512
#: Queries of one block; blocks are scored one after another, so what goes out to tasks is bounded.
QUERY_BLOCK = 4_096


def top_k(scored: DataFrame, group: str | list[str], ident: str, k: int, score: str = "score") -> DataFrame:
    """The ``k`` highest scores a group, ties by id; Spark limits groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(ident))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def doc_lengths(docs: DataFrame, ident: str = "doc_id", column: str = "text") -> DataFrame:
    return docs.select(ident, F.size(T.tokens(F.col(column))).alias("dl"))


def term_frequencies(docs: DataFrame, ident: str = "doc_id", column: str = "text") -> DataFrame:
    return docs.select(ident, F.explode(T.tokens(F.col(column))).alias("term")).groupBy(ident, "term").agg(F.count("*").alias("tf"))


def idf(df, n):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Document frequency and idf of every term; each document counts a term once."""
    terms = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return terms.join(n).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, ident: str = "doc_id", qid: str = "qid") -> DataFrame:
    """``(qid, id, score)`` for every pair that shares a term; repeated query terms count again.

    Only the queries' terms are counted in the corpus, so nothing else of it is shuffled.
    """
    wanted = term_frequencies(queries, qid).withColumnRenamed("tf", "qtf")
    lengths = doc_lengths(docs, ident)
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    arrays = docs.select(ident, T.tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts"))  # once a document
    terms = arrays.select(ident, "dl", F.explode("ts").alias("term"))
    tf = terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy(ident, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(F.col("df"), F.col("n")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1e-10))))
    parts = tf.join(df, "term").join(corpus).select(ident, "term", weight.alias("w"))
    return parts.join(wanted, "term").groupBy(qid, ident).agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def hash_buckets(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``(id, bucket, value)``: token counts by hash bucket, brought to unit length."""
    bucket = F.pmod(F.conv(F.expr("right(sha2(term, 256), 3)"), 16, 10).cast("int"), F.lit(DIMENSIONS))
    counts = term_frequencies(docs, ident).groupBy(ident, bucket.alias("bucket")).agg(F.sum("tf").alias("c"))
    norms = counts.groupBy(ident).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, ident).select(ident, "bucket", (F.col("c") / (F.col("norm") + 1e-10)).alias("value"))


_TOKEN = re.compile("[a-z0-9$%]+")


def hash_vector(text: str | None, memo: dict[str, int]) -> np.ndarray:
    v = np.zeros(DIMENSIONS)
    for token in _TOKEN.findall((text or "").lower()):
        if (b := memo.get(token)) is None:
            b = int(hashlib.sha256(token.encode()).hexdigest()[-3:], 16) % DIMENSIONS
            if len(memo) < 200_000:
                memo[token] = b
        v[b] += 1
    return v / (np.sqrt(v @ v) + 1e-10)


def _search(corpus: DataFrame, ids: list, matrix: np.ndarray, k: int, vector_of, kinds: tuple[str, str]) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))  # one block of queries

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        make = vector_of()
        for batch in frames:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                if not part.num_rows:
                    continue
                scores = np.round(make(part.column(1)) @ q.T, 9)
                own = np.arange(part.num_rows)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                rows = [own[np.lexsort((keys, -scores[:, j]))[:k]] for j in range(len(qids))]
                pick = np.concatenate(rows)
                of = np.repeat(np.arange(len(qids)), [len(r) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(qids)[of]), part.column(0).take(pa.array(pick)), pa.array(scores[pick, of])], names=["qid", "id", "score"])

    return corpus.mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, score double")


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, vectors: str = "array") -> DataFrame:
    """Exact cosine search of all queries (``qid``, value) over the whole corpus (``id``, value).

    Values are arrays, or texts that are hashed to vectors.  Queries go out in blocks; each
    batch of the corpus keeps its own best ``k`` for a query, and only those are shuffled.
    """
    kinds = (queries.schema[0].dataType.simpleString(), corpus.schema[0].dataType.simpleString())

    def arrays():
        def make(column) -> np.ndarray:
            m = np.array(column.to_pylist(), float)
            return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10)

        return make

    def texts():
        memo: dict[str, int] = {}
        return lambda column: np.stack([hash_vector(t, memo) for t in column.to_pylist()])

    vector_of = arrays if vectors == "array" else texts
    total, out = queries.count(), None
    numbered = queries.toDF("qid", "value").withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-total // QUERY_BLOCK)))))
    for b in range(max(1, -(-total // QUERY_BLOCK))):
        rows = numbered.where(F.col("b") == b).orderBy("qid").collect()
        if not rows:
            continue
        matrix = vector_of()(pa.array([r["value"] for r in rows]))
        found = _search(corpus, [r["qid"] for r in rows], matrix, k, vector_of, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], f"qid {kinds[0]}, id {kinds[1]}, score double")
    return top_k(out.withColumn("score", F.round("score", 6)), "qid", "id", k)


def blended(a, b, alpha: float):
    """A query vector moved towards another one and brought to unit length."""
    mixed = F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y)
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(mixed, lambda x: x / norm)
