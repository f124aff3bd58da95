"""I-Match document fingerprints over randomised subsets of a mid-frequency lexicon.

The lexicon holds the words whose document frequency, over all documents, lies between
``LOW`` and ``HIGH`` of their number (a band of inverse document frequency).  The lower end
bounds it: with ``m`` distinct words in the mean document it has at most ``m / LOW`` words,
however large the corpus, so its hashes can go to every task.  A fingerprint hashes, for
each of ``SUBSETS`` subsets of the lexicon (the whole one, then random ones), the sorted distinct
words of the text in that subset.  Random subsets take from 1/16 to 1/1024 of the lexicon,
so that some hold only a few words of a text and outlive an edit.  The likeness of two fingerprints is the share of equal
hashes among the subsets that are not empty in both.

A text without lexicon words is hashed over all its words.  Null text counts as empty; its
hashes are all "-" and its likeness to another empty text is 1.  Repeated rows each have a row; an empty
table gives none; very long texts are read whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batches, mix64

LOW, HIGH = 0.001, 0.1
#: Shares of the lexicon in the subsets: the whole, then each power of one half four times.
POWERS = (0, *(p for p in range(4, 11) for _ in range(4)))
SUBSETS = len(POWERS)
FLUSH = 150_000
ROWS_A_BUCKET, MOST_BUCKETS = 5_000, 2_048


def words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").split())


def word_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's lower-case words."""
    found = words(text)
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def frequency_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map of texts to ``(word, n)``: documents with the word, summed before the shuffle."""

    def flush() -> pa.RecordBatch:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches(frames):
        for text in batch.column(0).to_pylist():
            counts.update(words(text or ""))
        if len(counts) >= 4 * FLUSH:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the words in the band; document counts cover every document."""
    total = docs.count()
    counts = docs.select("text").mapInArrow(frequency_rows, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= max(2, low * total)) & (F.col("n") <= high * total))
    found = band.select("word").toPandas()["word"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def subset_bits(hashes: np.ndarray) -> np.ndarray:
    """For each word a bit for each subset that has it."""
    bits = np.zeros(len(hashes), np.uint64)
    for k, power in enumerate(POWERS):
        draw = mix64(hashes ^ mix64(np.full(1, k + 1, np.uint64)))
        bits |= (draw < np.uint64(2**64 - 1 >> power)).astype(np.uint64) << np.uint64(k)
    return bits


class Fingerprinter:
    def __init__(self, terms: np.ndarray):
        self.terms, self.bits = terms, subset_bits(terms)

    def hashes(self, text: str) -> list[str]:
        h = word_hashes(text)
        if len(self.terms) and len(h):
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            hit = self.terms[at] == h
            own, bits = h[hit], self.bits[at[hit]]
        else:
            own, bits = h[:0], h[:0]
        if not len(own):
            own, bits = h, subset_bits(h)
        out = []
        for k in range(SUBSETS):
            part = own[(bits >> np.uint64(k)) & np.uint64(1) == 1]
            out.append(hashlib.blake2b(part.tobytes(), digest_size=8).hexdigest() if len(part) else "-")
        return out


def likeness(a: list[str], b: list[str]) -> float:
    pairs = [(x, y) for x, y in zip(a, b) if x != "-" or y != "-"]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``doc_id`` and ``fingerprint``, the subset hashes joined by commas; a narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        f = Fingerprinter(shared.value)
        for batch in batches(frames):
            made = [",".join(f.hashes(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_following(docs: DataFrame) -> DataFrame:
    """Rows ``(bucket, ctx, doc_id, text)`` dealt so that each document lies before its next one.

    Ids are cut into buckets at quantiles, highest ids first.  A bucket ends with a row of
    ``ctx`` 1 that holds the first text of the next bucket (of the first, after the last).
    Ids that are not whole numbers stand where their hash does.  Ties of an id are ordered by text; null ids come last.
    """
    named = F.col("doc_id").cast("string")
    key = F.when(named.isNotNull(), F.coalesce(named.try_cast("bigint"), F.xxhash64(named))).otherwise(F.lit(-(2**63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", key.alias("key"), text.alias("text"))
    total = base.count()
    n = max(1, min(MOST_BUCKETS, total // ROWS_A_BUCKET))
    cuts: list[int] = []
    if n > 1:
        shares = ", ".join(str(i / n) for i in range(1, n))
        cuts = sorted({int(x) for x in base.agg(F.expr(f"percentile_approx(key, array({shares}), 20000)")).first()[0]})
    bucket = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c > F.col("key"))) if cuts else F.lit(0)
    rows = base.withColumn("bucket", bucket)
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    if not tops:
        return rows.select("bucket", F.lit(0).alias("ctx"), "key", "doc_id", "text")
    before = {b: tops[i - 1][0] for i, (b, _) in enumerate(tops)}
    heads = rows.where(F.col("key").isin([t for _, t in tops])).groupBy("bucket", "key").agg(F.min("text").alias("text"))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    none = F.lit(None).cast(docs.schema["doc_id"].dataType)
    heads = heads.select(to[F.col("bucket")].alias("bucket"), F.lit(1).alias("ctx"), "key", none.alias("doc_id"), "text")
    return rows.select("bucket", F.lit(0).alias("ctx"), "key", "doc_id", "text").unionByName(heads)


def edit_test(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(lexicon(docs))  # at most mean words / LOW hashes
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held = Fingerprinter(terms.value), None
        for batch in batches(frames):
            out = []
            for bucket, ctx, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = f.hashes(text)
                if held is not None and held[0] == bucket:
                    _, prev_id, prev, prev_own = held
                    new = edited(prev, text)
                    made = f.hashes(new) if new != prev else prev_own
                    out.append((prev_id, len(prev), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), ",".join(prev_own), ",".join(made), likeness(prev_own, made), likeness(prev_own, own)))
                held = None if ctx else (bucket, doc_id, text, own)
            columns = list(zip(*out)) or [[]] * len(names)
            kinds = [batch.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = with_following(docs).repartition("bucket").sortWithinPartitions("bucket", "ctx", F.desc("key"), "text")
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("bucket", "ctx", "doc_id", "text").mapInArrow(run, schema)
