"""Keeping a store without MERGE: upserts, inserts that ignore what is there, deletes and rewrites as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.redaction import redact
from mnemospark.functions.rules import low_signal, project_of


def upsert_sessions(stored: DataFrame, batch: DataFrame, order: str, keep: tuple[str, ...] = ("project", "git_branch", "cwd")) -> DataFrame:
    """stored sessions with a batch of session lines (id, source_agent, project, git_branch, cwd, ts) applied.

    Of each id the last line of the batch by order counts. Values of that line replace stored ones unless null;
    started_at is set once, at the insert, and last_seen_at is the last one written, not the latest time.
    """
    fields = ["source_agent", *keep, "ts"]
    last = batch.groupBy("id").agg(F.max_by(F.struct(*fields), order).alias("n"))
    both = stored.join(last, "id", "full_outer")
    fresh = F.col("source_agent").isNull()
    new = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(c))
    out = {c: new(c).alias(c) for c in keep}
    out["source_agent"] = F.coalesce(F.col("source_agent"), F.col("n.source_agent")).alias("source_agent")
    out["started_at"] = F.when(fresh, F.col("n.ts")).otherwise(F.col("started_at")).alias("started_at")
    out["last_seen_at"] = F.coalesce(F.col("n.ts"), F.col("last_seen_at")).alias("last_seen_at")
    return both.select(*(out.get(c, F.col(c)) for c in stored.columns))


def ensure_sessions(stored: DataFrame, turns: DataFrame, agent: Column) -> DataFrame:
    """stored with a bare session for each that only turns name."""
    missing = turns.where("session_id IS NOT NULL").select(F.col("session_id").alias("id")).distinct().join(stored.select("id"), "id", "left_anti")
    return stored.unionByName(missing.withColumn("source_agent", agent), allowMissingColumns=True)


def insert_new(stored: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The rows of batch whose id isn't stored, of each id the first by order."""
    w = Window.partitionBy("id").orderBy(order)
    first = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(stored.select("id"), "id", "left_anti")


def to_embed(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """Turns that should have a vector and have none: a crash between the two writes heals with the next run."""
    return turns.where(~low_signal(F.col("role"), F.col("content"))).join(vectors.select("row_id"), "row_id", "left_anti")


def replace_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.join(new.select("row_id"), "row_id", "left_anti").unionByName(new.select("row_id", "embedding"))


def prune_noise(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that stay: those of turns that aren't too thin; the turns themselves stay anyway."""
    noise = turns.where(low_signal(F.col("role"), F.col("content"))).select("row_id")
    return vectors.join(noise, "row_id", "left_anti")


def junk(cwd: Column, parts: list[str]) -> Column:
    """True where cwd holds one of the parts, without regard to case."""
    low = F.lower(F.coalesce(cwd, F.lit("")))
    return F.exists(F.array(*(F.lit(p.strip().lower()) for p in parts if p.strip())).cast("array<string>"), lambda p: F.contains(low, p))


def reproject(sessions: DataFrame, roots: list[tuple[str, str]], prune: list[str]) -> DataFrame:
    """id, action (prune, relabel or keep), from and to of every session; pruning wins over a new label."""
    to = project_of(F.col("cwd"), roots)
    action = F.when(junk(F.col("cwd"), prune), "prune").when(~to.eqNullSafe(F.col("project")), "relabel").otherwise("keep")
    return sessions.select("id", action.alias("action"), F.col("project").alias("from"), to.alias("to"))


def cascade(sessions: DataFrame, turns: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, turns, vectors) without the sessions of gone (id) and what belongs to them."""
    dead = turns.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_semi").select("row_id")
    return (
        sessions.join(gone.select("id"), "id", "left_anti"),
        turns.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti"),
        vectors.join(dead, "row_id", "left_anti"),
    )


def retained_log(log: DataFrame, key: str, keep: int = P.LOG_KEEP) -> DataFrame:
    """The rows whose key isn't more than keep below the greatest. An empty log stays empty."""
    top = log.agg(F.max(key)).first()[0]
    return log if top is None else log.where(F.col(key) >= top - keep)


def redact_stored(turns: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, worklist): stored turns redacted again, their counts added up, and the rows whose vector must be made anew.

    Only turns that change and have a vector are on the worklist. The caller writes the turns to a new place and removes
    the old files, which is what removes the plain text.
    """
    done = redact(turns, "content").drop("by_rule")
    out = done.withColumn("redaction_count", (F.coalesce("redaction_count", F.lit(0)) + F.col("redactions")).cast("int"))
    work = done.where("redactions > 0").select("row_id").join(vectors.select("row_id"), "row_id", "left_semi")
    return out.select(*turns.columns), work


def redact_log(log: DataFrame) -> DataFrame:
    """The activity log with its queries redacted again. Written to a new place; removing the old files removes the plain text."""
    return redact(log, "query").drop("redactions", "by_rule").select(*log.columns)


def log_results(log: DataFrame) -> DataFrame:
    """One row for each result of each entry (results is an array of structs): query_id, ts, position, id, kind, score."""
    rows = log.select("query_id", "ts", F.explode("results").alias("r"))
    return rows.select("query_id", "ts", "r.position", "r.id", "r.kind", "r.score")


def log_entries(queries: DataFrame, results: DataFrame, source: str, now: str) -> DataFrame:
    """One row of the activity log for each query, those without results too.

    queries has query_id and query, results query_id, position, id, source and score. The query's text is clipped and
    redacted before it is kept; scores have four places.
    """
    found = results.select("query_id", F.struct("position", "id", F.col("source").alias("kind"), F.round("score", 4).alias("score")).alias("r"))
    by = found.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("results"))
    asked = redact(queries.select("query_id", F.substring("query", 1, P.LOG_QUERY_CLIP).alias("query")), "query").drop("redactions", "by_rule")
    rows = asked.join(by, "query_id", "left")
    empty = F.array().cast("array<struct<position:bigint,id:string,kind:string,score:double>>")
    rows = rows.withColumn("results", F.coalesce(F.col("results").cast("array<struct<position:bigint,id:string,kind:string,score:double>>"), empty))
    return rows.select(
        "query_id", F.lit(now).alias("ts"), F.lit(source).alias("source"), "query", "results", F.size("results").cast("long").alias("n_injected"), F.array_max(F.transform("results", lambda x: x["score"])).alias("top_score")
    )
