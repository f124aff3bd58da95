"""Incremental counts and indexes: each micro-batch adds partial sums under a version of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def consume(stream: DataFrame, partial, folder: str) -> None:
    """Runs what is available through ``partial`` and writes each batch to ``folder/version=N``.

    A batch that is run again overwrites its own version, so results count once.
    """

    def write(batch: DataFrame, version: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/version={version}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind by hour, from partial sums of the stream's batches."""
    schema, folder = spark.read.parquet(f"{sf_dir}/events.parquet").schema, shared_folder(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    hour = F.window("ts", "1 hour")["start"].alias("hour")
    consume(stream, lambda b: b.groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), folder)
    parts = spark.read.parquet(folder)
    return parts.groupBy("hour", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
