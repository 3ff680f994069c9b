"""Reading tables and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="mnemospark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    _remove_at_exit(spark, folder)
    return folder


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    def remove() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(remove)


def commit_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a file of that content where none is yet, at once: it is written beside and renamed without overwriting.

    A writer that dies leaves at most a file of another name; one that comes second gets an error. The folder must lie
    in a file system whose rename is atomic, as that of a cluster is.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(beside, target, options)


def release(spark: SparkSession) -> None:
    """Let the cluster delete the shuffles of plans that nothing refers to any more: it does so when the driver's heap is
    collected, which may otherwise come long after the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Later stages then start from files that outlive any executor, and a plan that uses the result twice computes it
    once. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/mnemospark/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    _remove_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)
