"""Queries of statistics, listings and the activity log; events stand for the log of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.text import instant
from mnemospark.operators.store import retained_log
from mnemospark.plans.base import FACTS_SQL, TURNS_SQL, stored_facts, stored_turns
from mnemospark.storage import table

#: The day that statistics look back from.
AS_OF = "2025-10-01"


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = stored_turns(spark, sf_dir), stored_facts(spark, sf_dir)
    one = lambda d, name, cond=None: d.agg(F.lit(name).alias("kind"), (F.count("*") if cond is None else F.count_if(cond)).alias("n"))
    parts = [
        one(table(spark, sf_dir, "sessions"), "sessions"),
        one(t, "turns"),
        one(table(spark, sf_dir, "vec_turns"), "embedded"),
        one(f, "facts", ~F.coalesce("archived", F.lit(False))),
        one(t, "redacted", F.col("redaction_count") > 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions").groupBy("source_agent").agg(F.count("*").alias("n"))


def turns_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.substring("ts", 1, 10)
    rows = stored_turns(spark, sf_dir).where(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & (day >= F.lit("2025-09-01")) & (day <= F.lit(AS_OF)))
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of searches: id, ts, source, top_score and n_injected of each event."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("source"), F.round("value", 4).alias("top_score"), F.when(F.col("value") > 50, F.col("event_id") % 4).otherwise(F.lit(0)).cast("long").alias("n_injected"), "user_id")


def hook_stats_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last seven days of the log, by source: searches, those that showed something, the average best score, the rate."""
    log = _log(spark, sf_dir)
    last = log.agg(F.max("ts")).first()[0]
    rows = log.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 7 DAYS"))
    showing = F.count_if(F.col("n_injected") > 0)
    return rows.groupBy("source").agg(
        F.count("*").alias("total"), showing.alias("injecting"), F.when(F.avg("top_score") != 0, F.round(F.avg("top_score"), 3)).alias("avg_top"), F.round(showing * 100 / F.count("*")).cast("long").alias("rate")
    )


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sessions with turns that were seen last, with the number of their turns."""
    n = stored_turns(spark, sf_dir).where("session_id IS NOT NULL").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("turns"))
    s = table(spark, sf_dir, "sessions").select("id", "project", "git_branch", "last_seen_at").join(n, "id")
    return s.orderBy(F.desc_nulls_last("last_seen_at"), "id").limit(10)


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and share of the busiest session, for every session, stored or not."""
    n = stored_turns(spark, sf_dir).where("session_id IS NOT NULL").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("turns"))
    most = n.agg(F.max("turns")).first()[0]
    s = table(spark, sf_dir, "sessions").select("id", "project").join(n, "id", "left")
    return s.select("id", "project", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"), F.round(F.coalesce("turns", F.lit(0)) / F.lit(most), 6).alias("bar"))


def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty sessions of the commonest project that were seen last, with the number of their turns."""
    s = table(spark, sf_dir, "sessions")
    top = s.where("project IS NOT NULL").groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(1).select("project")
    n = stored_turns(spark, sf_dir).where("session_id IS NOT NULL").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("turns"))
    page = s.join(F.broadcast(top), "project", "left_semi").join(n, "id", "left")
    return page.orderBy(F.desc_nulls_last("last_seen_at"), "id").limit(P.SESSION_PAGE).select("id", "project", "last_seen_at", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the session seen first, in order of arrival, embedded or not."""
    t = stored_turns(spark, sf_dir).where("session_id IS NOT NULL")
    one = t.agg(F.min_by("session_id", "row_id").alias("session_id"))
    v = table(spark, sf_dir, "vec_turns").select("row_id", F.lit(True).alias("e"))
    rows = t.join(F.broadcast(one), "session_id").join(v, "row_id", "left")
    return rows.select("row_id", "id", "role", "ts", F.coalesce("e", F.lit(False)).alias("embedded")).orderBy("row_id")


def facts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that aren't archived, pinned ones first, then the last changed; the first fifty."""
    f = stored_facts(spark, sf_dir).where(~F.coalesce("archived", F.lit(False)))
    return f.orderBy(F.desc_nulls_last("pinned"), F.desc_nulls_last("updated_at"), "row_id").limit(50).select("row_id", "id", "kind", "pinned", "updated_at")


def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored_facts(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("retry queue")))
    return f.select("row_id", "id", "project")


def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fact whether the first characters of its id name it: exact, unique or ambiguous."""
    f = stored_facts(spark, sf_dir).select("id", F.substring("id", 1, 5).alias("prefix"))
    n = f.groupBy("prefix").agg(F.count("*").alias("n"))
    return f.join(n, "prefix").select("id", F.when(F.col("id") == F.col("prefix"), "exact").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"))


def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_log(_log(spark, sf_dir), "event_id", 2000).select("event_id", "source")


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred searches of the log."""
    return _log(spark, sf_dir).orderBy(F.desc("event_id")).limit(100).select("event_id", "source", "top_score", "n_injected")


def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by origin and kind, with how many are pinned, archived, edited and cite a turn."""
    f = stored_facts(spark, sf_dir)
    return f.groupBy("origin", "kind").agg(F.count("*").alias("n"), F.count_if("pinned").alias("pinned"), F.count_if("archived").alias("archived"), F.count_if("edited").alias("edited"), F.count_if(F.size("source_turn_ids") > 0).alias("cited"))


def member_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored_facts(spark, sf_dir).where("origin_member IS NOT NULL")
    return f.groupBy(F.col("origin_member").alias("member")).agg(F.count("*").alias("facts"), F.count_distinct("origin_device").alias("devices")).orderBy(F.desc("facts"), "member")


def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between the first and last turn of each session, times compared as instants, and the longest pause."""
    t = stored_turns(spark, sf_dir).where("session_id IS NOT NULL").select("session_id", F.unix_micros(instant(F.col("ts"))).alias("at"), "row_id").where("at IS NOT NULL")
    # Pauses within an hour of a session, then those between its hours: no group holds a whole session.
    hour = F.floor(F.col("at") / 3_600_000_000).alias("hour")
    w = Window.partitionBy("session_id", "hour").orderBy("at", "row_id")
    gaps = t.select("*", hour).withColumn("gap", F.col("at") - F.lag("at").over(w))
    hours = gaps.groupBy("session_id", "hour").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("gap").alias("gap"), F.count("*").alias("n"))
    edge = F.col("first") - F.lag("last").over(Window.partitionBy("session_id").orderBy("hour"))
    hours = hours.withColumn("gap", F.greatest(F.coalesce("gap", F.lit(0)), F.coalesce(edge, F.lit(0))))
    return hours.groupBy("session_id").agg(((F.max("last") - F.min("first")) / 1e6).alias("seconds"), (F.max("gap") / 1e6).alias("pause"), F.sum("n").alias("turns"))


def session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by agent and role, with those whose session isn't stored."""
    s = table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), "source_agent")
    t = stored_turns(spark, sf_dir).join(s, "session_id", "left")
    return t.groupBy("source_agent", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("chars"))


_LOG = "l AS (SELECT event_id, ts, event_type AS source, round(value, 4) AS top_score, CASE WHEN value > 50 THEN event_id % 4 ELSE 0 END AS n_injected FROM events)"

QUERIES = {
    "table_counts": table_counts,
    "source_breakdown": source_breakdown,
    "turns_per_day": turns_per_day,
    "hook_stats_7d": hook_stats_7d,
    "recent_sessions": recent_sessions,
    "session_list": session_list,
    "session_page": session_page,
    "session_turns": session_turns,
    "facts_list": facts_list,
    "fact_search": fact_search,
    "id_prefix": id_prefix,
    "retention_sweep": retention_sweep,
    "activity_log": activity_log,
    "origin_counts": origin_counts,
    "member_list": member_list,
    "session_spans": session_spans,
    "session_join": session_join,
}
SQL = {
    "table_counts": f"WITH {TURNS_SQL}, {FACTS_SQL} SELECT 'sessions' AS kind, count(*) AS n FROM sessions UNION ALL SELECT 'turns', count(*) FROM t UNION ALL SELECT 'embedded', count(*) FROM vec_turns UNION ALL SELECT 'facts', count(*) FROM f WHERE NOT coalesce(archived, false) UNION ALL SELECT 'redacted', count(*) FROM t WHERE redaction_count > 0",
    "source_breakdown": "SELECT source_agent, count(*) AS n FROM sessions GROUP BY 1",
    "turns_per_day": f"WITH {TURNS_SQL} SELECT substring(ts, 1, 10) AS day, count(*) AS n FROM t WHERE regexp_matches(substring(ts, 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND substring(ts, 1, 10) BETWEEN '2025-09-01' AND '{AS_OF}' GROUP BY 1",
    "hook_stats_7d": f"WITH {_LOG} SELECT source, count(*) AS total, count_if(n_injected > 0)::BIGINT AS injecting, CASE WHEN avg(top_score) <> 0 THEN round(avg(top_score), 3) END AS avg_top, round(count_if(n_injected > 0) * 100.0::DOUBLE / count(*))::BIGINT AS rate FROM l WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAYS FROM l) GROUP BY 1",
    "recent_sessions": f"WITH {TURNS_SQL}, n AS (SELECT session_id AS id, count(*) AS turns FROM t WHERE session_id IS NOT NULL GROUP BY 1) SELECT id, project, git_branch, last_seen_at, turns FROM sessions JOIN n USING (id) ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 10",
    "session_list": f"WITH {TURNS_SQL}, n AS (SELECT session_id AS id, count(*) AS turns FROM t WHERE session_id IS NOT NULL GROUP BY 1) SELECT s.id, s.project, coalesce(n.turns, 0) AS turns, round(coalesce(n.turns, 0)::DOUBLE / (SELECT max(turns) FROM n), 6) AS bar FROM sessions s LEFT JOIN n USING (id)",
    "session_turns": f"WITH {TURNS_SQL} SELECT row_id, id, role, ts, row_id IN (SELECT row_id FROM vec_turns) AS embedded FROM t WHERE session_id = (SELECT arg_min(session_id, row_id) FROM t WHERE session_id IS NOT NULL)",
    "facts_list": f"WITH {FACTS_SQL} SELECT row_id, id, kind, pinned, updated_at FROM f WHERE NOT coalesce(archived, false) ORDER BY pinned DESC NULLS LAST, updated_at DESC NULLS LAST, row_id LIMIT 50",
    "fact_search": f"WITH {FACTS_SQL} SELECT row_id, id, project FROM f WHERE contains(lower(content), 'retry queue')",
    "id_prefix": f"WITH {FACTS_SQL}, p AS (SELECT id, substring(id, 1, 5) AS prefix FROM f) SELECT id, CASE WHEN id = prefix THEN 'exact' WHEN count(*) OVER (PARTITION BY prefix) = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM p WHERE id IS NOT NULL",
    "retention_sweep": f"WITH {_LOG} SELECT event_id, source FROM l WHERE event_id >= (SELECT max(event_id) FROM l) - 2000",
    "activity_log": f"WITH {_LOG} SELECT event_id, source, top_score, n_injected FROM l ORDER BY event_id DESC LIMIT 100",
    "origin_counts": f"WITH {FACTS_SQL} SELECT origin, kind, count(*) AS n, count_if(pinned)::BIGINT AS pinned, count_if(archived)::BIGINT AS archived, count_if(edited)::BIGINT AS edited, count_if(len(source_turn_ids) > 0)::BIGINT AS cited FROM f GROUP BY 1, 2",
    "member_list": f"WITH {FACTS_SQL} SELECT origin_member AS member, count(*) AS facts, count(DISTINCT origin_device) AS devices FROM f WHERE origin_member IS NOT NULL GROUP BY 1",
    "session_spans": f"""WITH {TURNS_SQL}, a AS (SELECT session_id, row_id, epoch_us(TRY_CAST(CASE WHEN regexp_matches(ts, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN ts ELSE ts || 'Z' END AS TIMESTAMPTZ)) AS us FROM t WHERE session_id IS NOT NULL AND regexp_matches(ts, '^[0-9]{{4}}-')),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY session_id ORDER BY us, row_id) AS gap FROM a WHERE us IS NOT NULL) SELECT session_id, (max(us) - min(us)) / 1e6::DOUBLE AS seconds, coalesce(max(gap), 0) / 1e6::DOUBLE AS pause, count(*) AS turns FROM g GROUP BY 1""",
    "session_join": f"WITH {TURNS_SQL} SELECT s.source_agent, t.role, count(*) AS n, sum(length(content))::BIGINT AS chars FROM t LEFT JOIN sessions s ON s.id = t.session_id GROUP BY 1, 2",
    "session_page": f"""WITH {TURNS_SQL}, p AS (SELECT project FROM sessions WHERE project IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, project LIMIT 1), n AS (SELECT session_id, count(*) AS turns FROM t WHERE session_id IS NOT NULL GROUP BY 1)
SELECT s.id, s.project, s.last_seen_at, coalesce(n.turns, 0) AS turns FROM sessions s JOIN p USING (project) LEFT JOIN n ON n.session_id = s.id ORDER BY s.last_seen_at DESC NULLS LAST, s.id LIMIT {P.SESSION_PAGE}""",
}
