"""Schemas of the store; reading never infers them."""

from pyspark.sql import types as T


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SESSIONS = T.StructType(_s("id", "source_agent", "project", "git_branch", "cwd", "started_at", "last_seen_at", "title"))
TURNS = T.StructType(
    [T.StructField("row_id", T.LongType()), *_s("id", "session_id", "role", "content", "tool_summary", "ts"), T.StructField("redaction_count", T.IntegerType())]
)
VECTORS = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
FACTS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        *_s("id", "kind", "content", "content_hash"),
        T.StructField("source_turn_ids", T.ArrayType(T.StringType())),
        *_s("project", "created_at", "updated_at"),
        *(T.StructField(n, T.BooleanType()) for n in ("pinned", "archived", "edited")),
        *_s("origin"),
        *(T.StructField(n, T.IntegerType()) for n in ("shared", "version", "synced_version")),
        *_s("origin_device", "origin_member"),
    ]
)
#: Columns that later versions of the store added, with the value old rows get.
LATER = {
    "turns": {"redaction_count": 0},
    "facts": {"shared": 0, "version": 0, "synced_version": -1, "origin_device": None, "origin_member": None},
}
VERSION = 7


def upgraded(df, table: str):
    """df with the columns that its version of the store lacked, in the order of the current schema."""
    from pyspark.sql import functions as F

    schema = {"sessions": SESSIONS, "turns": TURNS, "facts": FACTS}[table]
    later = LATER.get(table, {})
    return df.select(
        *(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(later.get(f.name)).cast(f.dataType).alias(f.name) for f in schema)
    )
