"""Applying a change feed to a table by bucketed copy-on-write.

The state lives in a folder of its own: data files under ``data/bucket=N/``, and one manifest file a version under
``manifests/``, which names the folders that make up that version. A change batch is reduced to one winning change a
key before any shuffle (partial aggregation), routed to its bucket, merged with that bucket's rows only, and written as
replacement files; untouched buckets keep their files. Rows of touched buckets that the batch doesn't name are copied
from file to file without a shuffle as long as the batch's keys can go with the tasks; beyond that both sides are
sort-merged by bucket. The new manifest is written last, whole and under a name that must not exist yet, so a lost
executor, a failed job, a driver that dies or a competing writer leaves the old version whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.storage import commit_file, materialize

#: A batch of at most so many keys goes with the tasks that copy the base.
MAX_BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Feed:
    """What the columns of a change feed mean.

    key: the column that names the row. order: expressions, the most significant first, by which the greatest change
    wins; a tie keeps either of two changes that are equal in all of them, by the remaining columns, so that repeated
    delivery and any order of arrival give the same state. deleted: true where the winning change removes the row.
    """

    key: str
    order: tuple[Column, ...]
    deleted: Column
    payload: tuple[str, ...] = field(default=())


def winners(changes: DataFrame, feed: Feed) -> DataFrame:
    """One row a key: the change that wins. Changes without a key are left out, as they name no row.

    max_by keeps one change a key on each side of the shuffle, so a key with a third of all changes costs one row a
    partition. Nulls in the order sort lowest; an empty feed gives an empty result.
    """
    payload = feed.payload or tuple(c for c in changes.columns if c != feed.key)
    order = F.struct(
        *(x.alias(f"o{i}") for i, x in enumerate(feed.order)),
        F.coalesce(feed.deleted, F.lit(False)).alias("gone"),
        F.xxhash64(*(F.col(c) for c in payload)).alias("tie"),
    )
    row = F.struct(*(F.col(c) for c in payload), F.coalesce(feed.deleted, F.lit(False)).alias("__deleted"), order.alias("__order"))
    return (
        changes.where(F.col(feed.key).isNotNull())
        .groupBy(F.col(feed.key))
        .agg(F.max_by(row, order).alias("__row"))
        .select(feed.key, "__row.*")
    )


class BucketedTable:
    """A keyed table in a folder, changed by copy-on-write of whole buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests -------------------------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 if the table doesn't exist."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version: schema, key, number of buckets, and the folder of each bucket that has rows."""
        version = self.version() if version is None else version
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/v{version:08d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict, version: int) -> None:
        commit_file(self.spark, f"{self.path}/manifests/v{version:08d}.json", json.dumps(manifest))  # fails where another writer was first

    # -- reading and writing ---------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, without those that were deleted."""
        return self._rows(self.manifest(version)).where(~F.col("__deleted")).drop("__deleted", "__order", "__bucket")

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    @staticmethod
    def _merge(base: DataFrame, won: DataFrame, key: str) -> DataFrame:
        """The rows of the touched buckets after the batch: for each key the greater of base and batch."""

        def greater(rows: DataFrame) -> DataFrame:
            # By bucket alone, which is even: rows of one bucket are then written by one task.
            rest = [c for c in rows.columns if c not in ("__bucket", key)]
            best = rows.repartition("__bucket").groupBy("__bucket", key).agg(F.max_by(F.struct(*rest), F.col("__order")).alias("r"))
            return best.select("__bucket", key, "r.*")

        if won.count() > MAX_BROADCAST_ROWS:
            return greater(base.unionByName(won))
        keys = F.broadcast(won.select(key))
        named = base.join(keys, key, "left_semi")
        return base.join(keys, key, "left_anti").unionByName(greater(named.unionByName(won)))

    def apply(self, changes: DataFrame, feed: Feed, buckets: int = 64) -> DataFrame:
        """Apply a batch of changes and return the new current rows.

        Deleted keys stay in the files as markers with their order, so a late older change can't bring them back.
        buckets counts only when the table is created. Copy-on-write touches the buckets that the batch names and no
        other; the winner of base and batch is taken by the same order as within the batch.
        """
        spark, base = self.spark, self.version()
        old = self.manifest(base) if base else None
        n = old["n"] if old else buckets
        won = winners(changes, feed).withColumn("__bucket", F.pmod(F.xxhash64(F.col(feed.key)), F.lit(n)).cast("int"))
        schema = won.schema
        if old:
            won = materialize(won, "change-winners")
            # The touched buckets are at most n small numbers; a bucket's rows never come to the driver.
            touched = [r[0] for r in won.select("__bucket").distinct().collect()]
            won = self._merge(self._rows(old, touched), won, feed.key)
        else:
            won = won.repartition("__bucket")
        stamp = uuid.uuid4().hex
        won.select(*schema.fieldNames(), F.col("__bucket").alias("__at")).write.option("compression", "zstd").partitionBy("__at").parquet(f"{self.path}/data/{stamp}")
        jvm, fs = self._fs()
        fresh = {}
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{stamp}")):
            name = s.getPath().getName()
            if name.startswith("__at="):
                fresh[name.partition("=")[2]] = f"data/{stamp}/{name}"
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        self._commit({"n": n, "key": feed.key, "schema": nullable.jsonValue(), "buckets": {**(old["buckets"] if old else {}), **fresh}}, base + 1)
        return self.read(base + 1)
