"""Importance resampling towards a target distribution of hashed n-grams, in two Arrow passes.

The first pass counts features by bucket: each partition gives one vector of ``buckets`` counts
(``np.bincount``), and ``treeReduce`` merges the vectors, so the driver gets one of that size whatever the table's.
A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus.  The second pass gathers
the broadcast gains of a document's features and sums them (``np.bincount`` with weights).  Gumbel noise from a
hash of the id is added, and the highest scores are drawn: a weighted sample without replacement that any run
repeats.  Places come from ``operators.order``, so no task sorts the whole table.

Null texts have no features.  Rows with a null id are drawn by the noise of an empty id and come after others
among ties; repeated rows count, score and are drawn one by one.  A table without rows gives none, and an empty target
leaves gains that favour rare buckets.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batches, cut, shared_dir
from gleaner.operators.order import in_order

BUCKETS, RUNS, SEED = 10_000, 1, "2024"
LEAST_FEATURES, SHARE = 20, 10
#: A thousandth of a nat is the unit of gains, weights and noise.
UNIT = 1000
#: Words are ASCII letters and digits and all that is not ASCII; in UTF-8 that is decided byte by byte.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def feature_codes(words: list[bytes], runs: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``runs`` consecutive words, repeats included."""
    made = list(map(zlib.crc32, words))
    for n in range(2, runs + 1):
        made += [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(made, np.int64) % buckets


def _words(frames: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches(frames):
        yield batch, [(t or b"").translate(_FOLDED).split() for t in batch.column(column).cast(pa.binary()).to_pylist()]


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table fall into each bucket."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for _, texts in _words(frames, 0):
            for words in texts:
                held += np.bincount(feature_codes(words, runs, buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    vectors = docs.select("text").mapInArrow(count, "held binary").rdd.map(lambda r: np.frombuffer(r.held, np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add)


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a document's weight."""
    t, s, buckets = target.astype(float), corpus.astype(float), float(len(corpus))
    ratio = ((t + 1.0) * (s.sum() + buckets)) / ((s + 1.0) * (t.sum() + buckets))
    return np.floor(UNIT * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row: the weight is the sum of its features' gains."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(gain), docs.schema["doc_id"].dataType.simpleString()

    def weigh(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch, texts in _words(frames, 1):
            codes = [feature_codes(words, runs, len(gain)) for words in texts]
            sizes = np.array(list(map(len, codes)), np.int64)
            owner = np.repeat(np.arange(len(codes)), sizes)
            # sums of integers, exact in doubles up to 2**53
            total = np.bincount(owner, gain[np.concatenate(codes)], len(codes)) if codes else np.zeros(0)
            columns = [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(sizes), pa.array(total.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: str):
    """A standard Gumbel value in whole thousandths, from the first 32 bits of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-float(UNIT) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_FEATURES, runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row; ``rank`` is null for rows not drawn.

    ``share`` per cent of the rows with ``least`` words are drawn, by descending score, ties to the smaller id.
    """
    gain = gains(bucket_counts(target, runs, buckets), bucket_counts(docs, runs, buckets))
    scored = weights(docs, gain, runs).withColumn("score", F.col("weight") + noise(seed))
    # narrow rows are written once: ranges are cut from a sample of them, which would else weigh all texts again
    scored = cut(scored.withColumn("enough", F.col("n_words") >= least), shared_dir(docs.sparkSession), "scores")
    placed, _ = in_order(scored, [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id")])
    drawn = scored.where("enough").count() * share // 100
    rank = F.when(F.col("enough") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
