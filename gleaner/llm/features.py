"""Hashed n-gram indicators of whole texts, and bounded labelled samples."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BITS, GRAM_BITS = 17, 17
N_FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS)
#: The last word buckets are kept for words that follow themselves: any, and from these shares on.
SHARES = (0.0, 0.02, 0.1, 0.4)
REPEATED = (1 << WORD_BITS) - len(SHARES)


def word_codes(text: str) -> np.ndarray:
    """Hashed lower-case words, each once, sorted."""
    words = set(text.lower().encode("utf-8", "surrogatepass").split())
    codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return np.unique(codes % REPEATED)


def gram_codes(text: str) -> np.ndarray:
    """Hashed byte trigrams and a mark for repeated neighbours, each once, sorted."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    if len(data) < 3:
        grams = np.zeros(0, np.int64)
    else:
        raw = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        seen = np.zeros(1 << GRAM_BITS, bool)
        seen[(raw * 0x9E3779B1 >> 11) & ((1 << GRAM_BITS) - 1)] = True
        grams = np.flatnonzero(seen)
    return grams + (1 << WORD_BITS)


def indicator_codes(text: str | None) -> np.ndarray:
    """All n-gram indicators of a text, sorted; an empty text has none."""
    text = text or ""
    words = text.split()
    twice = sum(map(str.__eq__, words, words[1:]))
    marks = [REPEATED + i for i, share in enumerate(SHARES) if twice > share * len(words)]
    return np.concatenate([word_codes(text), np.array(marks, np.int64), gram_codes(text)])


def bounded_labels(labels: DataFrame, columns: list[str], most: int, where=None) -> DataFrame:
    """At most ``most`` labelled ids, those of the smallest hash; repeated ids count once.

    Rows with a null id or label are left out.  The sample does not depend on how the table
    is split, and its size is bounded by the parameter whatever the size of the table.
    """
    rows = labels.select("doc_id", *columns).where(F.col("doc_id").isNotNull())
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_rows(docs: DataFrame, sample: list[tuple], run, schema: str) -> list:
    """Applies an Arrow map to the documents of a bounded sample of labels and collects it.

    ``sample`` holds ``(doc_id, label...)`` tuples; the ids go out with the task, so the
    documents are scanned in place and nothing but the sample's rows is moved.  Where an id is
    repeated, its least row counts, so no more rows come back than the sample has.
    """
    if not sample:
        return []
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame([(s[0],) for s in sample], f"doc_id {kind}"))
    found = docs.select("doc_id", F.col("text")).join(wanted, "doc_id", "left_semi").mapInArrow(run, schema)
    rest = F.min(F.struct(*[c for c in found.columns if c != "doc_id"])).alias("least")
    return found.groupBy("doc_id").agg(rest).select("doc_id", "least.*").collect()


def code_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map ``(id, text)`` to ``(id, codes)`` with the codes as packed 32-bit integers."""
    for batch in frames:
        packed = [indicator_codes(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "codes"])
