"""Conversations rebuilt from message rows (problem 2).

Every row points to the row before it; pointer jumping finds each row's root and depth in a number of rounds that grows
with the logarithm of the longest path. Where the pointers come from time order, rows are first cut into ranges of
(session, time): within a range a window resolves all pointers, so that only the first rows of ranges that continue a
session of the range before are left to jump. A session with a third of all rows is so spread over as many tasks as
its share asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import instant, is_blank, speaker
from mnemospark.storage import materialize

#: Rounds after which what isn't resolved must be a cycle: paths up to 2**MAX_ROUNDS rows.
MAX_ROUNDS = 40


def pointer_jump(nodes: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """id, root, depth and state of nodes (id, parent, weight): one row an id.

    weight is the length of the step to the parent. state is ok; orphan where the path ends at a row whose parent isn't
    there, root is then that row; or cycle where it doesn't end, root and depth are then null. Each round joins the
    rows that aren't resolved with their targets and doubles the reach of every pointer. Null ids are left out, a null
    parent makes a root, repeated ids are an error of the caller. No rows give no rows.
    """
    nodes = nodes.where("id IS NOT NULL").select("id", "parent", F.coalesce(F.col("weight"), F.lit(1)).cast("long").alias("weight"))
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    start = nodes.join(there, "parent", "left").select(
        "id",
        F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("target"),
        F.when(F.col("there"), F.col("weight")).otherwise(F.lit(0)).cast("long").alias("depth"),
        F.col("there").isNull().alias("ended"),
        (F.col("there").isNull() & F.col("parent").isNotNull()).alias("orphan"),
    )
    start = materialize(start, "jump-0")
    ended, active = [start.where("ended")], start.where("NOT ended")
    for turn in range(1, max_rounds + 1):
        if active.isEmpty():
            break
        known = active
        for part in ended:
            known = known.unionByName(part)
        b = known.select(
            F.col("id").alias("b_id"), F.col("target").alias("b_target"), F.col("depth").alias("b_depth"), F.col("ended").alias("b_ended"), F.col("orphan").alias("b_orphan")
        )
        jumped = active.join(b, F.col("target") == F.col("b_id")).select(
            "id", F.col("b_target").alias("target"), (F.col("depth") + F.col("b_depth")).alias("depth"), F.col("b_ended").alias("ended"), F.col("b_orphan").alias("orphan")
        )
        jumped = materialize(jumped, f"jump-{turn}")
        ended.append(jumped.where("ended"))
        active = jumped.where("NOT ended")
    out = active.select("id", F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("state"))
    for part in ended:
        out = out.unionByName(part.select("id", F.col("target").alias("root"), "depth", F.when(F.col("orphan"), "orphan").otherwise("ok").alias("state")))
    return out


def threads(messages: DataFrame, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """Messages with thread (their root's id), depth and state, for rows that name the message they answer.

    Messages of a cycle have no thread. Columns of the same names are replaced.
    """
    nodes = messages.select(F.col(id).alias("id"), F.col(parent).alias("parent"), F.lit(1).alias("weight")).where("id IS NOT NULL").dropDuplicates(["id"])
    found = pointer_jump(nodes).select(F.col("id").alias("__id"), F.col("root").alias("thread"), "depth", "state")
    rest = messages.drop(*({"thread", "depth", "state"} & set(messages.columns)))
    return rest.join(found, F.col(id) == F.col("__id"), "left").drop("__id")


def once(turns: DataFrame) -> DataFrame:
    """row_id, id, session_id, speaker, at, blank of each turn, repeated rows of an id once: the one that arrived first.

    Rows without an id are all kept; rows without a session belong to no conversation and are left out.
    """
    rows = turns.where("session_id IS NOT NULL").select(
        "row_id",
        F.coalesce("id", F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("id"),
        "session_id",
        speaker(F.col("role")).alias("speaker"),
        instant(F.col("ts")).alias("at"),
        is_blank(F.col("content")).alias("blank"),
    )
    return rows.groupBy("id").agg(F.min_by(F.struct("row_id", "session_id", "speaker", "at", "blank"), "row_id").alias("r")).select("id", "r.*")


def order_turns(turns: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The speaker turns in order, and all other turns.

    The first has row_id, id, session_id, speaker, at, blank, root (the first speaker turn's row), position, next_row,
    next_speaker and next_blank; ties in time go by row_id. The second holds turns of other roles, without a role or
    without a usable time. Both read one written table.
    """
    spark = turns.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = once(turns)
    placed = rows.repartitionByRange(ranges, "session_id", "at", "row_id").withColumn("range", F.spark_partition_id())
    chained = F.col("speaker").isin("user", "assistant") & F.col("at").isNotNull()
    placed = placed.withColumn("chained", F.coalesce(chained, F.lit(False)))
    w = Window.partitionBy("session_id", "range", "chained").orderBy("at", "row_id")
    whole = Window.partitionBy("session_id", "range", "chained")
    local = placed.select(
        "*",
        F.row_number().over(w).alias("place"),
        F.first("row_id").over(w).alias("head"),
        F.lead("row_id").over(w).alias("next_row"),
        F.lead("speaker").over(w).alias("next_speaker"),
        F.lead("blank").over(w).alias("next_blank"),
        F.count("*").over(whole).alias("size"),
    )
    local = materialize(local, "turns-ordered")
    speakers, others = local.where("chained"), local.where("NOT chained")
    # One row for each range that a session has turns in.
    heads = speakers.where("place = 1").select("session_id", "range", "head", "size", F.col("speaker").alias("h_speaker"), F.col("blank").alias("h_blank"))
    by_range = Window.partitionBy("session_id").orderBy("range")
    linked = heads.select(
        "*",
        F.lag("head").over(by_range).alias("parent"),
        F.lag("size").over(by_range).alias("weight"),
        F.lead("head").over(by_range).alias("after"),
        F.lead("h_speaker").over(by_range).alias("after_speaker"),
        F.lead("h_blank").over(by_range).alias("after_blank"),
    )
    # Only sessions that cross the edge of a range have more than one head: at most two heads for each range, so what is
    # joined below has fewer rows than twice the number of ranges, whatever the data.
    crossing = materialize(linked.where("parent IS NOT NULL OR after IS NOT NULL"), "turn-heads")
    jumped = pointer_jump(crossing.select(F.col("head").alias("id"), "parent", "weight")).select(F.col("id").alias("head"), "root", "depth")
    ends = crossing.select("head", "after", "after_speaker", "after_blank").join(jumped, "head", "left")
    if ends.limit(2 * ranges + 1).count() <= 2 * ranges:
        ends = F.broadcast(ends)
    last = F.col("place") == F.col("size")
    ordered = speakers.join(ends, "head", "left").select(
        "row_id",
        "id",
        "session_id",
        "speaker",
        "at",
        "blank",
        F.coalesce("root", "head").alias("root"),
        (F.coalesce("depth", F.lit(0)) + F.col("place") - 1).alias("position"),
        F.when(last, F.col("after")).otherwise(F.col("next_row")).alias("next_row"),
        F.when(last, F.col("after_speaker")).otherwise(F.col("next_speaker")).alias("next_speaker"),
        F.when(last, F.col("after_blank")).otherwise(F.col("next_blank")).alias("next_blank"),
    )
    return ordered, others.select("row_id", "id", "session_id", "speaker", "at", "blank")


def session_defects(ordered: DataFrame, others: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id and defect of every session but those with notes only; defect is null where the session is kept.

    empty: no turn with content is a speaker's or without a role. broken: a turn has no role, a speaker's turn has no
    usable time, or the first with content is the assistant's. missing_reply: no assistant's turn with content comes
    after the last of the user. Sessions of sessions (id) without any turn are empty. One partial aggregation a session.
    """
    speaks = F.col("speaker").isin("user", "assistant")
    rows = ordered.select("session_id", "speaker", "blank", "position").unionByName(others.select("session_id", "speaker", "blank", F.lit(None).cast("long").alias("position")))
    full = ~F.col("blank") & F.col("position").isNotNull()
    position = F.col("position")
    flags = rows.groupBy("session_id").agg(
        F.max(F.coalesce(F.col("speaker") != "note", F.lit(True))).alias("other_than_notes"),
        F.max(~F.col("blank") & (F.col("speaker").isNull() | speaks)).alias("content"),
        F.max(F.col("speaker").isNull() | (F.coalesce(speaks, F.lit(False)) & position.isNull())).alias("unplaced"),
        F.min(F.when(full & (F.col("speaker") == "assistant"), position)).alias("first_assistant"),
        F.min(F.when(full & (F.col("speaker") == "user"), position)).alias("first_user"),
        F.max(F.when(full & (F.col("speaker") == "assistant"), position)).alias("last_assistant"),
        F.max(F.when(full & (F.col("speaker") == "user"), position)).alias("last_user"),
    )
    if sessions is not None:
        named = sessions.where("id IS NOT NULL").select(F.col("id").alias("session_id")).distinct()
        flags = flags.join(named, "session_id", "full_outer")
    led = F.col("first_assistant").isNotNull() & (F.col("first_user").isNull() | (F.col("first_assistant") < F.col("first_user")))
    defect = (
        F.when(~F.coalesce("content", F.lit(False)), "empty")
        .when(F.col("unplaced") | led, "broken")
        .when(F.coalesce(F.col("last_user") > F.coalesce("last_assistant", F.lit(-1)), F.lit(False)), "missing_reply")
    )
    return flags.where(F.coalesce("other_than_notes", F.lit(True))).select("session_id", defect.alias("defect"))


def conversations(turns: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row for each speaker's turn of the sessions that are kept: session_id, position, speaker, row_id, id, at.

    Rows, not one array a session, so that a session of any length stays distributed.
    """
    ordered, others = order_turns(turns)
    kept = session_defects(ordered, others, sessions).where("defect IS NULL").select("session_id")
    return ordered.join(kept, "session_id", "left_semi").select("session_id", "position", "speaker", "row_id", "id", "at", "blank")
