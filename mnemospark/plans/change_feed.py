"""Current state of the shared facts, rebuilt from the change feed as the hub received it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import instant
from mnemospark.operators.cdc import BucketedTable, Feed
from mnemospark.storage import shared_dir, table

#: How many arrival-ordered batches the feed is applied in.
BATCHES = 2

#: Feed rows one bucket of the state table is made for.
ROWS_A_BUCKET = 250_000


def fact_feed() -> Feed:
    """Higher version wins, then the later instant, then the greater device; an archived winner removes the fact."""
    return Feed(
        key="factid",
        order=(F.col("version"), instant(F.col("updatedat")), F.col("device")),
        deleted=F.col("archived"),
        payload=("seq", "op_id", "op_kind", "factkind", "content", "project", "createdat", "updatedat", "pinned", "archived", "version", "device"),
    )


def fact_state(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Apply wire_facts in batches by arrival to a bucketed table and return its current rows."""
    feed = table(spark, sf_dir, "wire_facts")
    path = path or f"{shared_dir(spark)}/mnemospark/facts-{uuid.uuid4().hex}"
    low, high, n = feed.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    state, buckets = BucketedTable(spark, path), max(4, n // ROWS_A_BUCKET)
    if not n:
        return state.apply(feed, fact_feed(), buckets)
    width = (high - low) // BATCHES + 1
    for i in range(BATCHES):
        batch = feed.where((F.col("seq") >= low + i * width) & (F.col("seq") < low + (i + 1) * width))
        current = state.apply(batch, fact_feed(), buckets)
    return current


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factid, version and device of the winning operation of every fact that is not archived."""
    return fact_state(spark, sf_dir).select("factid", "version", "device")


P6_SQL = """
WITH o AS (
  SELECT factid, version, device, archived,
         row_number() OVER (PARTITION BY factid ORDER BY version DESC NULLS LAST,
           CAST(CASE WHEN regexp_matches(updatedat, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN updatedat ELSE updatedat || 'Z' END AS TIMESTAMPTZ) DESC NULLS LAST,
           device DESC NULLS LAST) AS rn
  FROM wire_facts WHERE factid IS NOT NULL)
SELECT factid, version, device FROM o WHERE rn = 1 AND NOT coalesce(archived, false)
"""

QUERIES = {"p6_found": p6_found}
SQL = {"p6_found": P6_SQL}
