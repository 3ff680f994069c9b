"""Facts: classification of new ones against the store, distillation of turns, labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.rules import INJECTED_PREFIX, clip, content_hash, kind_of, self_referential, strip
from mnemospark.operators.knn import knn, within
from mnemospark.operators.sequence import beside
from mnemospark.storage import materialize


def near_class(new: DataFrame, facts: DataFrame, vectors: DataFrame, merge: float = P.MERGE_SIMILARITY, near: float = P.NEAR_SIMILARITY) -> DataFrame:
    """query_id, action and fact_id: what adding each of new (query_id, content, embedding) to a fixed store does.

    merged-exact if the content's hash is there, archived or not (the first such fact); else by the three nearest facts
    that aren't archived: merged-similar from merge on, near-duplicate-inserted from near on, inserted otherwise. A fact
    of the store whose row_id is the query_id itself is left out.
    """
    text = clip(strip(F.col("content")), P.FACT_CLIP)
    new = new.withColumn("h", content_hash(text))
    w = Window.partitionBy("content_hash").orderBy("row_id")
    # The first two of each hash: one of them is another row than the new one.
    known = facts.withColumn("__n", F.row_number().over(w)).where("__n <= 2").select(F.col("content_hash").alias("h"), "row_id", "id")
    exact = new.select("query_id", "h").join(known, "h").where("row_id <> query_id").groupBy("query_id").agg(F.min_by("id", "row_id").alias("exact"))
    close = knn(vectors, new.select("query_id", "embedding"), 4).where("row_id <> query_id")
    close = close.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 3")
    close = close.join(facts.where("NOT coalesce(archived, false)").select("row_id", "id"), "row_id")
    by = close.where(F.col("similarity") >= near).groupBy("query_id").agg(F.min_by(F.struct("id", "similarity"), "rank").alias("n"))
    n = F.col("n.similarity")
    action = F.when(F.col("exact").isNotNull(), "merged-exact").when(n >= merge, "merged-similar").when(n >= near, "near-duplicate-inserted").otherwise("inserted")
    return new.select("query_id").join(exact, "query_id", "left").join(by, "query_id", "left").select("query_id", action.alias("action"), F.coalesce("exact", F.col("n.id")).alias("fact_id"))


def add_facts(facts: DataFrame, vectors: DataFrame, new: DataFrame, now: str, merge: float = P.MERGE_SIMILARITY, near: float = P.NEAR_SIMILARITY, dims: int = P.DIMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, facts, vectors) after adding new ones in order of row_id, each before the next.

    new has row_id (greater than any stored one), id, kind, content, source_turn_ids, project and embedding; its columns
    beside those are carried on. outcomes has row_id, action and fact_id. A new fact merges into one with its hash,
    stored or added before it, else into the most similar one that isn't archived from merge on; else it is added, as a
    near duplicate from near on. What merges gives its sources to its target, each once in order. Facts without a
    content are skipped.

    Whether one is added depends on those before it; so all are decided whose similar predecessors are decided, round
    after round. Only pairs from near on are ever written, and a round looks only at what is open.
    """
    text = clip(strip(F.col("content")), P.FACT_CLIP)
    new = materialize(new.withColumn("content", text).withColumn("content_hash", content_hash(F.col("content"))), "new-facts")
    full = new.where("content IS NOT NULL AND content <> ''")
    # By hash: the first of the store, else the first of the batch.
    known = facts.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min_by("id", "row_id").alias("stored"))
    first = full.groupBy("content_hash").agg(F.min("row_id").alias("head"))
    rows = full.select("row_id", "id", "content_hash").join(known, "content_hash", "left").join(first, "content_hash")
    heads = materialize(rows.where("stored IS NULL AND row_id = head").select("row_id", "id"), "heads")
    asked = full.join(heads.select("row_id"), "row_id").select(F.col("row_id").alias("query_id"), "embedding")
    live = facts.where("NOT coalesce(archived, false)").select("row_id", "id")
    old = within(vectors.join(live.select("row_id"), "row_id", "left_semi"), asked, near, dims).join(live, "row_id").select("query_id", "similarity", "row_id", F.col("id").alias("target"))
    best = F.struct(F.col("similarity"), -F.col("row_id"), F.col("target"))
    old = materialize(old.groupBy("query_id").agg(F.max(best).alias("o")).select("query_id", "o.similarity", F.col("o.target").alias("target")), "near-stored")
    pairs = within(asked.withColumnRenamed("query_id", "row_id"), asked, near, dims).where("row_id < query_id")
    pairs = materialize(pairs, "near-new")
    state = heads.join(old.where(F.col("similarity") >= merge).select(F.col("query_id").alias("row_id")), "row_id", "left_semi").select("row_id", F.lit(False).alias("added"))
    state = materialize(state, "decided-0")
    # Only what lies above merge makes one depend on another.
    ties = pairs.where(F.col("similarity") >= merge).select("query_id", "row_id")
    turn = 0
    while True:
        open_ = heads.select("row_id").join(state.select("row_id"), "row_id", "left_anti")
        if open_.isEmpty():
            break
        turn += 1
        before = open_.withColumnRenamed("row_id", "query_id").join(ties, "query_id", "left").join(state, "row_id", "left")
        of = before.groupBy("query_id").agg(F.max(F.coalesce("added", F.lit(False))).alias("taken"), F.count_if(F.col("row_id").isNotNull() & F.col("added").isNull()).alias("waiting"))
        # One that an added predecessor takes, or that waits for none, is decided; the first open one always is.
        decided = of.where("taken OR waiting = 0").select(F.col("query_id").alias("row_id"), (~F.col("taken")).alias("added"))
        state = materialize(state.unionByName(decided), f"decided-{turn}")
    names = heads.select("row_id", F.col("id").alias("target")).join(state.where("added").select("row_id"), "row_id")
    inside = pairs.join(names, "row_id").groupBy("query_id").agg(F.max(best).alias("i")).select("query_id", F.col("i.similarity").alias("s_new"), F.col("i.target").alias("t_new"))
    judged = heads.withColumnRenamed("row_id", "query_id").join(state.withColumnRenamed("row_id", "query_id"), "query_id").join(old, "query_id", "left").join(inside, "query_id", "left")
    stored_first = F.coalesce("similarity", F.lit(-1.0)) >= F.coalesce("s_new", F.lit(-1.0))
    top = F.greatest(F.coalesce("similarity", F.lit(-1.0)), F.coalesce("s_new", F.lit(-1.0)))
    nearest = F.when(stored_first, F.col("target")).otherwise(F.col("t_new"))
    judged = judged.select(
        F.col("query_id").alias("row_id"),
        F.when(top >= merge, "merged-similar").when(top >= near, "near-duplicate-inserted").otherwise("inserted").alias("action"),
        F.when(top >= merge, nearest).otherwise(F.col("id")).alias("fact_id"),
    )
    judged = materialize(judged, "judged")
    # Later ones of a hash go where its first went.
    later = rows.where("stored IS NOT NULL OR row_id <> head").join(judged.select(F.col("row_id").alias("head"), F.col("fact_id").alias("went"), F.col("action").alias("first_action")), "head", "left")
    same = F.when(F.col("stored").isNull() & (F.col("first_action") == "merged-similar"), "merged-similar").otherwise("merged-exact")
    later = later.select("row_id", same.alias("action"), F.coalesce("stored", "went").alias("fact_id"))
    skipped = new.where("content IS NULL OR content = ''").select("row_id", F.lit("skipped").alias("action"), F.lit(None).cast("string").alias("fact_id"))
    outcomes = materialize(judged.unionByName(later).unionByName(skipped), "outcomes")
    added = new.join(outcomes.where("action IN ('inserted', 'near-duplicate-inserted')").select("row_id"), "row_id", "left_semi")
    fixed = {"created_at": F.lit(now), "updated_at": F.lit(now), "pinned": F.lit(False), "archived": F.lit(False), "edited": F.lit(False), "version": F.lit(0)}
    grown = added.select(*(F.col(c) if c in added.columns else fixed.get(c, F.lit(None)).cast(facts.schema[c].dataType).alias(c) for c in facts.columns))
    moved = outcomes.where("action IN ('merged-exact', 'merged-similar')").join(new.select("row_id", "source_turn_ids"), "row_id")
    each = moved.select("fact_id", "row_id", F.posexplode("source_turn_ids").alias("n", "source"))
    # Each source once before any are gathered, so a fact that many merge into holds no more than it has sources.
    each = each.groupBy("fact_id", "source").agg(F.min(F.struct("row_id", "n")).alias("at")).groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("s"))
    gained = moved.select("fact_id").distinct().join(each, "fact_id", "left").select(F.col("fact_id").alias("id"), F.coalesce(F.transform("s", lambda x: x["source"]), F.array().cast("array<string>")).alias("gained"))
    whole = facts.unionByName(grown).join(gained, "id", "left")
    sources = F.array_distinct(F.concat(F.coalesce("source_turn_ids", F.array().cast("array<string>")), "gained"))
    touched = F.col("gained").isNotNull()
    new_values = {"source_turn_ids": F.when(touched, sources).otherwise(F.col("source_turn_ids")), "updated_at": F.when(touched, F.lit(now)).otherwise(F.col("updated_at"))}
    after = whole.select(*(new_values.get(c, F.col(c)).alias(c) for c in facts.columns))
    return outcomes, after, vectors.select("row_id", "embedding").unionByName(added.select("row_id", "embedding"))


def delete_facts(facts: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, vectors) without the facts of gone (id); unknown ids change nothing."""
    dead = facts.join(gone.select("id"), "id", "left_semi").select("row_id")
    return facts.join(gone.select("id"), "id", "left_anti"), vectors.join(dead, "row_id", "left_anti")


def hide(rows: DataFrame, vectors: DataFrame, hidden: DataFrame) -> DataFrame:
    """vectors without those of the rows of hidden (id): a blocked turn or an archived fact stays but is never found."""
    return vectors.join(rows.join(hidden.select("id"), "id", "left_semi").select("row_id"), "row_id", "left_anti")


def run_distillation(
    turns: DataFrame, vectors: DataFrame, sessions: DataFrame, facts: DataFrame, fact_vectors: DataFrame, state: DataFrame, tool: str, now: str, embedder: Callable, limit: int | None = P.DISTILL_LIMIT, command: Callable[[str], str | None] | None = None
) -> dict[str, DataFrame]:
    """One run of distillation: outcomes, facts, vectors and state after it, and counters.

    Candidates that state (row_id, outcome) doesn't hold are summarized, embedded and added. outcomes has row_id,
    action, outcome and fact_id; outcome is promoted, merged or rejected, where nothing of a candidate is kept. A dry
    run reads outcomes and counters and writes nothing; applying means to write facts, vectors and state.
    """
    found = materialize(distill_candidates(turns, vectors, sessions, facts, tool, state, limit), "distilled")
    context = pair_context(turns.join(found.select("session_id").distinct(), "session_id", "left_semi")).select("row_id", "context")
    kept = summarize(found.join(context, "row_id"), command).select("row_id", F.col("kind").alias("k"), F.col("content").alias("c"))
    kept = materialize(found.select("row_id", "id", "project").join(kept, "row_id"), "summaries")
    base = facts.agg(F.max("row_id")).first()[0] or 0
    new = kept.select((F.lit(base + 1) + F.col("row_id")).alias("row_id"), F.concat(F.lit("fact:"), "id").alias("id"), F.col("k").alias("kind"), F.col("c").alias("content"), F.array("id").alias("source_turn_ids"), "project", F.lit("distill").alias("origin"))
    vectors_of = embedder(new.where("content <> ''").select("row_id", "content"), "content")
    outcomes, after, fact_vectors = add_facts(facts, fact_vectors, new.join(vectors_of, "row_id", "left"), now)
    outcome = F.when(F.col("action") == "skipped", "rejected").when(F.startswith("action", F.lit("merged")), "merged").otherwise("promoted")
    rows = outcomes.select((F.col("row_id") - base - 1).alias("row_id"), "action", outcome.alias("outcome"), "fact_id")
    counters = rows.agg(
        F.count("*").alias("examined"), F.count_if(F.col("outcome") == "promoted").alias("promoted"), F.count_if(F.col("outcome") == "merged").alias("merged"), F.count_if(F.col("outcome") == "rejected").alias("skipped"), F.count_if(F.col("action") == "near-duplicate-inserted").alias("near_duplicate")
    )
    return {"outcomes": rows, "facts": after, "vectors": fact_vectors, "state": state.select("row_id", "outcome").unionByName(rows.select("row_id", "outcome")), "counters": counters}


def recurrence(candidates: DataFrame, vectors: DataFrame, turns: DataFrame, floor: float = P.RECURRENCE_SIMILARITY, k: int = P.RECURRENCE_K) -> DataFrame:
    """row_id and sessions: of how many other sessions the k nearest turns from floor on are, the turn itself excepted."""
    own = turns.select("row_id", "session_id")
    asked = candidates.select(F.col("row_id").alias("query_id"), "embedding")
    near = knn(vectors, asked, k).where((F.col("row_id") != F.col("query_id")) & (F.col("similarity") >= floor))
    near = near.join(own, "row_id").join(own.select(F.col("row_id").alias("query_id"), F.col("session_id").alias("own")), "query_id")
    count = near.where("session_id <> own").groupBy("query_id").agg(F.count_distinct("session_id").alias("sessions"))
    return candidates.select("row_id").join(count.withColumnRenamed("query_id", "row_id"), "row_id", "left").select("row_id", F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"))


def uncited(turns: DataFrame, facts: DataFrame) -> DataFrame:
    """turns that no fact names as a source."""
    cited = facts.select(F.explode("source_turn_ids").alias("id")).where("id IS NOT NULL").distinct()
    return turns.join(cited, "id", "left_anti")


def distill_candidates(
    turns: DataFrame, vectors: DataFrame, sessions: DataFrame, facts: DataFrame, tool: str, done: DataFrame | None = None, limit: int | None = P.DISTILL_LIMIT, floor: float = P.RECURRENCE_SIMILARITY
) -> DataFrame:
    """row_id, id, session_id, role, content, project, kind, sessions, strong: turns worth keeping as facts.

    Embedded turns of stored sessions, of a fitting length, not processed (done: row_id), not about the search tool, not
    injected, not cited, of some kind; strong if an answer holds a decision or a gotcha, else recurring in two other
    sessions. limit takes the first by arrival, after all tests; None takes all.
    """
    rows = turns.where(F.length("content").between(P.DISTILL_MIN, P.DISTILL_MAX)).join(vectors, "row_id")
    rows = rows.join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id")
    if done is not None:
        rows = rows.join(done.select("row_id"), "row_id", "left_anti")
    rows = rows.where(~self_referential(F.col("content"), tool) & ~strip(F.col("content")).rlike(INJECTED_PREFIX))
    rows = uncited(rows, facts).withColumn("kind", kind_of(F.col("content"))).where("kind IS NOT NULL")
    strong = F.coalesce((F.col("role") == "assistant") & F.col("kind").isin("decision", "gotcha"), F.lit(False))
    # Each pass of the search reads the candidates again.
    rows = materialize(rows.withColumn("strong", strong), "candidates")
    rows = rows.join(recurrence(rows, vectors, turns, floor), "row_id")
    rows = rows.where(F.col("strong") | (F.col("sessions") >= P.RECURRENCE_SESSIONS)).select("row_id", "id", "session_id", "role", "content", "project", "kind", "sessions", "strong")
    return rows if limit is None else rows.orderBy("row_id").limit(limit)


def pair_context(turns: DataFrame) -> DataFrame:
    """turns with context: an answer with the start of its question, anything else with the start of its answer."""
    own = F.col("content")
    rows = beside(turns, F.when(F.col("role") == "assistant", F.substring(own, 1, 1200)), F.when(F.col("role") == "user", F.substring(own, 1, 400)))
    answer = F.concat(F.lit("Q: "), F.col("__before"), F.lit("\nA: "), own)
    question = F.concat(F.lit("Q: "), own, F.lit("\nA: "), F.col("__after"))
    context = F.when(F.col("role") == "assistant", F.coalesce(answer, own)).otherwise(F.coalesce(question, own))
    return rows.withColumn("context", context).drop("__after", "__before")


def parse_summary(raw: str) -> dict | None:
    """What a summarizer wrote: JSON, JSON inside the result of JSON, or the first span in braces."""

    def parse(text: str) -> dict | None:
        try:
            out = json.loads(text)
            return out if isinstance(out, dict) else None
        except ValueError:
            return None

    out = parse(raw.strip())
    if out and isinstance(out.get("result"), str):
        out = parse(out["result"].strip()) or out
    if out is None and (m := re.search(r"\{[\s\S]*\}", raw)):
        out = parse(m[0])
    return out


def summarize(candidates: DataFrame, command: Callable[[str], str | None] | None = None) -> DataFrame:
    """row_id, kind, content, extractive of candidates; content is empty where nothing is to be kept.

    command takes the context and returns what a summarizer writes, or None if it failed; without one, or where its
    output is no use, strong candidates give their first characters and others nothing.
    """
    extract = F.when(F.col("strong"), F.substring("content", 1, P.SUMMARY_CLIP)).otherwise("")
    if command is None:
        return candidates.select("row_id", "kind", extract.alias("content"), F.lit(True).alias("extractive"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                raw = command(r.context)
                got = parse_summary(raw) if raw else None
                if got and got.get("skip"):
                    rows.append((r.row_id, r.kind, "", False))
                elif got and got.get("content") and got.get("kind") in ("decision", "gotcha", "preference", "reference"):
                    rows.append((r.row_id, got["kind"], str(got["content"])[: P.FACT_CLIP], False))
                else:
                    rows.append((r.row_id, r.kind, r.content[: P.SUMMARY_CLIP] if r.strong else "", True))
            yield pd.DataFrame(rows, columns=["row_id", "kind", "content", "extractive"])

    return candidates.select("row_id", "kind", "content", "strong", "context").mapInPandas(run, "row_id long, kind string, content string, extractive boolean")


def latest_labels(labels: DataFrame) -> DataFrame:
    """fact_id, member, verdict, ts, version: each member's last verdict on a fact, the version counts the changes."""
    order = F.struct("ts", "seq")
    return labels.groupBy("fact_id", "member").agg(F.max_by("verdict", order).alias("verdict"), F.max("ts").alias("ts"), (F.count("*") - 1).alias("version"))


def apply_changes(facts: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """facts after changes (id, content, pinned, archived; null leaves a value as it is), at most one for each fact.

    A new content is clipped, hashed again and marks the fact as edited. Whatever changes raises the version by one and
    sets updated_at, so that the fact is sent again; merging sources doesn't, and isn't done here.
    """
    n = changes.select("id", F.col("content").alias("n_content"), F.col("pinned").alias("n_pinned"), F.col("archived").alias("n_archived"))
    rows = facts.join(n, "id", "left")
    text = clip(strip(F.col("n_content")), P.FACT_CLIP)
    edited = F.coalesce(text != "", F.lit(False))
    moved = edited | F.coalesce(F.col("n_pinned") != F.coalesce("pinned", F.lit(False)), F.lit(False)) | F.coalesce(F.col("n_archived") != F.coalesce("archived", F.lit(False)), F.lit(False))
    new = {
        "content": F.when(edited, text).otherwise(F.col("content")),
        "content_hash": F.when(edited, content_hash(text)).otherwise(F.col("content_hash")),
        "edited": F.when(edited, F.lit(True)).otherwise(F.col("edited")),
        "pinned": F.coalesce("n_pinned", "pinned"),
        "archived": F.coalesce("n_archived", "archived"),
        "version": F.when(moved, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")),
        "updated_at": F.when(moved, F.lit(now)).otherwise(F.col("updated_at")),
    }
    return rows.select(*(new[c].cast(facts.schema[c].dataType).alias(c) if c in new else F.col(c) for c in facts.columns))


def set_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels (fact_id, member, verdict, ts, version) after new ones (fact_id, member, verdict, ts), one for each pair.

    A first label has version 0, each later one raises it by one.
    """
    n = new.select("fact_id", "member", F.col("verdict").alias("n_verdict"), F.col("ts").alias("n_ts"))
    both = labels.join(n, ["fact_id", "member"], "full_outer")
    again = F.col("n_verdict").isNotNull() & F.col("verdict").isNotNull()
    version = F.when(again, F.col("version") + 1).otherwise(F.coalesce("version", F.lit(0)))
    return both.select("fact_id", "member", F.coalesce("n_verdict", "verdict").alias("verdict"), F.coalesce("n_ts", "ts").alias("ts"), version.cast("long").alias("version"))
