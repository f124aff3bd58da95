"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SUFFIX = ".parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}{TABLE_SUFFIX}")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) the warehouse folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/gleaner-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so that lineage ends there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``cut`` wrote, once no later plan reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def row_key():
    """A hash of a row's id and text, for joins and for draws that don't depend on the plan."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def whole_text(column: str = "text"):
    """A document's text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def first_free(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, or that name with underscores before it if the table has it already."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: Bytes that separate words: U+0020 and U+0009 to U+000D, just what bytes.split() takes.
def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class TwoGenerationCache:
    """A bounded memo: at most ``2 * size`` entries, keeping those used lately."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """An avalanche permutation of 64-bit integers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def batches(frames: Iterator, step: int = 256) -> Iterator:
    """Splits Arrow record batches so that few whole texts are held as Python objects at once."""
    for frame in frames:
        for i in range(0, frame.num_rows, step):
            yield frame.slice(i, step)
