"""Session factory used by tests, the benchmark and interactive work."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "gleaner", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitted configuration wins."""
    cores = cpus or os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
