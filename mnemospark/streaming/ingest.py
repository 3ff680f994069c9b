"""Ingest of transcripts, in batches or as a stream, into a store of versioned Parquet folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.embedding import embed
from mnemospark.functions.redaction import redact
from mnemospark.functions.rules import low_signal
from mnemospark.operators.store import ensure_sessions, insert_new, upsert_sessions
from mnemospark.schemas import SESSIONS, TURNS, VECTORS
from mnemospark.sources.tail import TailSource
from mnemospark.sources.transcripts import ADAPTERS, Adapter, Roots, meetings, read_lines, read_notes
from mnemospark.storage import commit_file

#: Row ids leave room for so many ids a batch.
ID_SPACE = 1 << 46


class Store:
    """Tables as lists of folders in a manifest, one manifest a version. Turns and vectors are appended, sessions rewritten.

    A manifest is written last, under a name that must not exist, and names the batch it holds: a batch that is
    delivered again after a failure changes nothing.
    """

    SCHEMAS = {"sessions": SESSIONS, "turns": TURNS, "vectors": VECTORS}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.startswith("v") and n.endswith(".json")]
        if not names:
            return {"version": 0, "batch": -1, "tables": {t: [] for t in self.SCHEMAS}}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{names[-1]}"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        commit_file(self.spark, f"{self.path}/manifests/v{manifest['version']:08d}.json", json.dumps(manifest))

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        folders = (manifest or self.manifest())["tables"][table]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        return self.spark.read.schema(self.SCHEMAS[table]).parquet(*(f"{self.path}/{f}" for f in folders))

    def write(self, table: str, rows: DataFrame) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        names = self.SCHEMAS[table].fieldNames()
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.SCHEMAS[table] if f.name in names)).write.parquet(f"{self.path}/{folder}")
        return folder


def ingest(store: Store, parsed: DataFrame, agent: str, batch: int, embedder: Callable | None = None) -> dict[str, int]:
    """Apply one batch of parsed lines. Returns how many turns were new and how many of them got a vector.

    Redaction comes before anything is stored. Thin turns are stored and never embedded.
    """
    old = store.manifest()
    if batch <= old["batch"]:
        return {"turns": 0, "embedded": 0}
    turns = parsed.where("turn IS NOT NULL").select("path", "offset", "turn.*")
    turns = redact(turns, "content").withColumnRenamed("redactions", "redaction_count").drop("by_rule")
    turns = turns.withColumn("arrival", F.struct("path", "offset"))
    new = insert_new(store.read("turns", old), turns, "arrival")
    new = new.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    new = new.withColumn("row_id", F.lit(batch * ID_SPACE) + F.monotonically_increasing_id())
    added = store.write("turns", new)
    kept = store.spark.read.schema(TURNS).parquet(f"{store.path}/{added}")
    lines = parsed.where("session IS NOT NULL").select(F.struct("path", "offset").alias("at"), "session.*").withColumn("source_agent", F.lit(agent))
    sessions = upsert_sessions(store.read("sessions", old), lines, "at")
    if "title" in parsed.columns:
        titles = parsed.groupBy(F.col("session_id").alias("id")).agg(F.max_by("title", "offset").alias("t"))
        sessions = sessions.join(titles, "id", "left").withColumn("title", F.coalesce("t", "title")).drop("t")
    sessions = store.write("sessions", ensure_sessions(sessions, kept, F.lit(agent)))
    worth = kept.where(~low_signal(F.col("role"), F.col("content")))
    vectors = store.write("vectors", embed(worth, "content", *([] if embedder is None else [embedder])))
    tables = {"sessions": [sessions], "turns": [*old["tables"]["turns"], added], "vectors": [*old["tables"]["vectors"], vectors]}
    store.commit({"version": old["version"] + 1, "batch": batch, "tables": tables})
    return {"turns": kept.count(), "embedded": worth.count()}


def ingest_notes(store: Store, path: str, embedder: Callable | None = None) -> dict[str, int]:
    """Ingest meeting notes as one batch: a session each, of which only title and time are set anew, and one turn."""
    return ingest(store, meetings(read_notes(store.spark, path)), "granola", store.manifest()["batch"] + 1, embedder)


def catch_up(spark: SparkSession, folder: str, store: Store, now: datetime, adapter: Adapter = ADAPTERS["claude-code"], roots: Roots = (), days: int = P.CATCH_UP_DAYS) -> dict[str, int]:
    """Ingest the files below folder that changed in the last days as one batch, before a stream takes over."""
    since = (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S")
    lines = read_lines(spark, folder, adapter.glob, since)
    return ingest(store, adapter.parse(lines, list(roots)), adapter.name, store.manifest()["batch"] + 1)


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, adapter: Adapter = ADAPTERS["claude-code"], roots: Roots = (), once: bool = True, every: str = "2 seconds"):
    """Start a stream that ingests lines as they are appended to the files of folder; once takes what is there and ends."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", folder).option("glob", adapter.glob).load()

    def apply(rows: DataFrame, batch: int) -> None:
        ingest(store, adapter.parse(rows, list(roots)), adapter.name, batch)

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
