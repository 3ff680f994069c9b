"""Session settings every plan here relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results; the rest is tuning left to the cluster.
SEMANTIC = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mnemospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in SEMANTIC.items():
        builder = builder.config(key, value)
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
