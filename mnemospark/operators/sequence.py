"""Looking at the rows before and after a row of a session, however many rows the session has.

Rows are cut into buckets of arrival, and a window runs within (session, bucket), so a session with a third of all rows
is spread over as many tasks as it has buckets. What lies beyond a bucket's edge comes from one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Row ids in one bucket: the greatest number of rows that a window sorts at once.
BUCKET = 1 << 14


def beside(rows: DataFrame, after: Column, before: Column, group: str = "session_id", order: str = "row_id", bucket: int = BUCKET) -> DataFrame:
    """rows with __after, the first value of after behind the row in its group, and __before, the last of before ahead of it.

    order must be a whole number that is unique in a group; rows whose expression is null are passed over. Rows without
    a group see each other.
    """
    rows = rows.withColumns({"__bucket": F.floor(F.col(order) / bucket), "__group": F.coalesce(F.col(group), F.lit("")), "__a": after, "__b": before})
    # What follows is looked at from behind: a frame that ends before the row grows by one row at a time, one that starts
    # behind it would be read anew for every row.
    passed = (Window.unboundedPreceding, -1)
    near = Window.partitionBy("__group", "__bucket")
    local = rows.withColumn("__after", F.last("__a", ignorenulls=True).over(near.orderBy(F.desc(order)).rowsBetween(*passed)))
    local = local.withColumn("__before", F.last("__b", ignorenulls=True).over(near.orderBy(order).rowsBetween(*passed)))
    edges = rows.groupBy("__group", "__bucket").agg(
        F.min_by("__a", F.when(F.col("__a").isNotNull(), F.col(order))).alias("first"), F.max_by("__b", F.when(F.col("__b").isNotNull(), F.col(order))).alias("last")
    )
    by_bucket = Window.partitionBy("__group")
    beyond = edges.select(
        "__group",
        "__bucket",
        F.last("first", ignorenulls=True).over(by_bucket.orderBy(F.desc("__bucket")).rowsBetween(*passed)).alias("__next"),
        F.last("last", ignorenulls=True).over(by_bucket.orderBy("__bucket").rowsBetween(*passed)).alias("__previous"),
    )
    joined = local.join(beyond, ["__group", "__bucket"])
    return joined.withColumns({"__after": F.coalesce("__after", "__next"), "__before": F.coalesce("__before", "__previous")}).drop("__bucket", "__group", "__a", "__b", "__next", "__previous")
