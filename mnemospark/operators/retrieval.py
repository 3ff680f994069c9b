"""Search over turns and facts for a batch of queries.

A batch has query_id, embedding, query (its text), exclude_session_id and project; limits are the same for all queries
of a batch. Filters come after the nearest rows are taken, so a narrow one may leave fewer than asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.rules import asks_about_memory, clip, self_referential
from mnemospark.operators.knn import knn
from mnemospark.operators.sequence import beside
from mnemospark.storage import materialize


def _rank(*order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")


def candidates(queries: DataFrame, vectors: DataFrame, turns: DataFrame, sessions: DataFrame, tool: str, limit: int = P.LIMIT, pool: int | None = None) -> DataFrame:
    """query_id, row_id, turn_id, session_id, role, content, tool_summary, ts, project, raw_score, score, self_penalized.

    The nearest turns of each query, joined to their turn and session, without those of the query's own session or of
    another project than it names; text about the search tool loses P.SELF_PENALTY unless the query is about it.
    """
    near = knn(vectors, queries.select("query_id", "embedding"), pool or P.turn_pool(limit))
    asked = queries.select("query_id", "query", "exclude_session_id", F.col("project").alias("q_project"))
    named = sessions.select(F.col("id").alias("session_id"), "project")
    rows = near.join(turns.select("row_id", F.col("id").alias("turn_id"), "session_id", "role", "content", "tool_summary", "ts"), "row_id")
    rows = rows.join(named, "session_id").join(asked, "query_id")
    rows = rows.where(F.col("exclude_session_id").isNull() | (F.col("session_id") != F.col("exclude_session_id")))
    rows = rows.where(F.col("q_project").isNull() | (F.col("project") == F.col("q_project")))
    penalized = ~F.coalesce(asks_about_memory(F.col("query"), tool), F.lit(False)) & F.coalesce(self_referential(F.col("content"), tool), F.lit(False))
    return rows.select(
        "query_id",
        "row_id",
        "turn_id",
        "session_id",
        "role",
        "content",
        "tool_summary",
        "ts",
        "project",
        F.col("similarity").alias("raw_score"),
        (F.col("similarity") - F.when(penalized, F.lit(P.SELF_PENALTY)).otherwise(F.lit(0.0))).alias("score"),
        penalized.alias("self_penalized"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """turns with text: a user's turn with the next answer of its session, any other with the question before it.

    The counterpart is taken by order of arrival; only its clipped start is moved.
    """
    after = F.when(F.col("role") == "assistant", clip(F.col("content"), P.PAIR_ANSWER_CLIP, True))
    before = F.when(F.col("role") == "user", clip(F.col("content"), P.PAIR_QUESTION_CLIP, True))
    rows = beside(turns, after, before)
    own = F.col("content")
    question = F.concat(F.lit("Q: "), own, F.lit("\nA: "), F.col("__after"))
    answer = F.concat(F.lit("Q: "), F.col("__before"), F.lit("\nA: "), own)
    text = F.when(F.col("role") == "user", F.coalesce(question, own)).otherwise(F.coalesce(answer, own))
    return rows.withColumn("text", text).drop("__after", "__before")


def snippets(found: DataFrame, turns: DataFrame, limit: int = P.LIMIT, min_score: float = P.MIN_SCORE) -> DataFrame:
    """The best candidate of each session, at most limit a query, from min_score on, with its counterpart's text; position from 1."""
    order = (F.desc("score"), "row_id")
    w = Window.partitionBy("query_id", "session_id").orderBy(*order)
    one = found.where(F.col("score") >= min_score).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    # Read twice below: written once, so the search runs once.
    top = materialize(one.withColumn("position", _rank(*order)).where(F.col("position") <= limit), "best-turns")
    # Only sessions that some result belongs to are read for counterparts.
    wanted = turns.join(top.select("session_id").distinct(), "session_id", "left_semi")
    return top.join(paired(wanted).select("row_id", "text"), "row_id")


def label_net(labels: DataFrame) -> DataFrame:
    """fact_id and net of labels (fact_id, verdict): one up for useful, one down for anything else."""
    return labels.groupBy("fact_id").agg(F.sum(F.when(F.col("verdict") == "useful", 1).otherwise(-1)).cast("long").alias("net"))


def fact_matches(queries: DataFrame, vectors: DataFrame, facts: DataFrame, labels: DataFrame | None = None, members: DataFrame | None = None, limit: int = P.LIMIT) -> DataFrame:
    """query_id, row_id, fact_id, kind, content, project, updated_at, pinned, source_turn_ids, via, similarity, score.

    The nearest facts of each query that aren't archived and are of its project, if it names one. The score adds a boost
    for facts, one for pinned ones and a bounded one by the net of labels.
    """
    near = knn(vectors, queries.select("query_id", "embedding"), P.fact_pool(limit))
    rows = near.join(facts.select("row_id", F.col("id").alias("fact_id"), "kind", "content", "project", "updated_at", "pinned", "archived", "source_turn_ids", "origin_member"), "row_id")
    rows = rows.join(queries.select("query_id", F.col("project").alias("q_project")), "query_id")
    rows = rows.where(~F.coalesce("archived", F.lit(False)) & (F.col("q_project").isNull() | (F.col("project") == F.col("q_project"))))
    rows = rows.join(label_net(labels), "fact_id", "left") if labels is not None else rows.withColumn("net", F.lit(0))
    rows = rows.join(members.select(F.col("member_id").alias("origin_member"), F.col("name").alias("via")), "origin_member", "left") if members is not None else rows.withColumn("via", F.lit(None).cast("string"))
    net = F.greatest(F.lit(P.LABEL_MIN), F.least(F.lit(P.LABEL_MAX), F.coalesce("net", F.lit(0))))
    score = F.col("similarity") + F.lit(P.FACT_BOOST) + F.when(F.coalesce("pinned", F.lit(False)), F.lit(P.PIN_BOOST)).otherwise(F.lit(0.0)) + F.lit(P.LABEL_WEIGHT) * net
    return rows.select("query_id", "row_id", "fact_id", "kind", "content", "project", "updated_at", "pinned", "source_turn_ids", "via", "similarity", F.round(score, 9).alias("score"))


def merged(found: DataFrame, matches: DataFrame, turns: DataFrame, limit: int = P.LIMIT, min_score: float = P.MIN_SCORE) -> DataFrame:
    """query_id, position, source (fact or turn), id, session_id, text, score: facts and turns in one ranking.

    Facts pass a slightly lower threshold and take at most limit - 1 places; turns that a chosen fact was made of are
    left out; at equal scores facts come first.
    """
    facts = matches.where(F.col("score") >= max(0.0, min_score - P.FACT_RELIEF))
    facts = facts.withColumn("position", _rank(F.desc("score"), F.desc("similarity"), "row_id")).where(F.col("position") <= max(0, limit - 1))
    facts = materialize(facts, "best-facts")
    used = facts.select("query_id", F.explode("source_turn_ids").alias("turn_id")).distinct()
    rest = snippets(found.join(used, ["query_id", "turn_id"], "left_anti"), turns, limit, min_score)
    a = facts.select("query_id", F.lit("fact").alias("source"), F.col("fact_id").alias("id"), F.concat(F.lit("fact:"), F.col("fact_id")).alias("session_id"), F.col("content").alias("text"), "score", "position")
    b = rest.select("query_id", F.lit("turn").alias("source"), F.col("turn_id").alias("id"), "session_id", "text", "score", "position")
    both = a.unionByName(b).withColumn("__p", _rank(F.desc("score"), F.when(F.col("source") == "fact", 0).otherwise(1), "position"))
    return both.where(F.col("__p") <= limit).withColumn("position", F.col("__p")).drop("__p")


def within_budget(rows: DataFrame, text: str, budget: int = P.HOOK_CHARS, group: str = "query_id", order: str = "position") -> DataFrame:
    """The rows of each group before the first whose text overflows the budget of characters; later ones don't come back."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w).cast("long")).where(F.col("used") <= budget)
