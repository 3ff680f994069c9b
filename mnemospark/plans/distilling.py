"""Queries of fact curation and distillation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.embedding import embed
from mnemospark.functions.rules import content_hash, kind_of, self_markers
from mnemospark.operators import curation
from mnemospark.plans.base import FACTS_SQL, QUERY_STEP, TOOL, TURNS_SQL, knn_sql, stored_facts, stored_turns, vectors_sql
from mnemospark.storage import table

#: What is added to a turn's row_id where it stands for a new fact.
NEW = 10**12


def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_turns(spark, sf_dir).select("role", kind_of(F.col("content")).alias("kind"))
    strong = F.coalesce((F.col("role") == "assistant") & F.col("kind").isin("decision", "gotcha"), F.lit(False))
    return t.groupBy("role", "kind").agg(F.count("*").alias("n"), F.count_if(strong).alias("strong"))


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts").where("content IS NOT NULL")
    return f.groupBy(content_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("rows"), F.min("row_id").alias("first")).where("rows > 1")


def near_duplicate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth fact as a new one with the vector of its row, half of them reworded, against all other facts."""
    facts = stored_facts(spark, sf_dir)
    v = table(spark, sf_dir, "vec_facts")
    reworded = F.concat(F.col("content"), F.lit(" (new)"))
    new = facts.where(F.col("row_id") % QUERY_STEP == 0).join(v, "row_id").select(F.col("row_id").alias("query_id"), F.when(F.col("row_id") % (2 * QUERY_STEP) == 0, F.col("content")).otherwise(reworded).alias("content"), "embedding")
    return curation.near_class(new, facts, v)


def recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns")
    asked = t.where(F.col("row_id") % QUERY_STEP == 0).join(v, "row_id")
    return curation.recurrence(asked.select("row_id", "embedding"), v, t)


def cited_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.uncited(stored_turns(spark, sf_dir), stored_facts(spark, sf_dir)).select("row_id", "id")


def _candidates(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    """The candidates among all turns, as a first run finds them: nothing was processed before."""
    t, v = stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns")
    return curation.distill_candidates(t, v, table(spark, sf_dir, "sessions"), stored_facts(spark, sf_dir), TOOL, None, limit)


def distill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, None).select("row_id", "id", "project", "kind", "sessions", "strong")


def distill_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates of a run, at most P.DISTILL_LIMIT, with what the extractive summary keeps of them."""
    c = _candidates(spark, sf_dir, P.DISTILL_LIMIT)
    return curation.summarize(c).select("row_id", "kind", "content", "extractive")


def _new_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of some kind that has a vector, as a new fact with that vector."""
    t = stored_turns(spark, sf_dir).withColumn("kind", kind_of(F.col("content"))).where("kind IS NOT NULL AND id IS NOT NULL")
    sessions = table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), "project")
    rows = t.join(table(spark, sf_dir, "vec_turns"), "row_id").join(sessions, "session_id", "left")
    return rows.select((F.col("row_id") + NEW).alias("row_id"), F.concat(F.lit("fact:"), "id").alias("id"), "kind", "content", F.array("id").alias("source_turn_ids"), "project", "embedding")


def fact_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding them one after the other does to the stored facts."""
    return curation.add_facts(stored_facts(spark, sf_dir), table(spark, sf_dir, "vec_facts"), _new_facts(spark, sf_dir), "2025-10-01T00:00:00Z")[0]


def distill_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a whole run over all turns, without a summarizer and without a limit."""
    state = spark.createDataFrame([], "row_id long, outcome string")
    run = curation.run_distillation(
        stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns"), table(spark, sf_dir, "sessions"), stored_facts(spark, sf_dir), table(spark, sf_dir, "vec_facts"), state, TOOL, "2025-10-01T00:00:00Z", embed, None
    )
    return run["counters"]


def fact_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of facts and their vectors after every seventh fact was deleted."""
    f, v = stored_facts(spark, sf_dir), table(spark, sf_dir, "vec_facts")
    facts, vectors = curation.delete_facts(f, v, f.where("row_id % 7 = 0").select("id"))
    return facts.select(F.lit("fact").alias("kind"), "row_id").unionByName(vectors.select(F.lit("vector").alias("kind"), "row_id"))


def turn_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that stay after every ninth turn was blocked: turns stay, what finds them doesn't."""
    t, v = stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns")
    return curation.hide(t, v, t.where("row_id % 9 = 0").select("id")).select("row_id")


def fact_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of facts that aren't archived."""
    f, v = stored_facts(spark, sf_dir), table(spark, sf_dir, "vec_facts")
    return curation.hide(f, v, f.where("archived").select("id")).select("row_id")


def pair_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.pair_context(stored_turns(spark, sf_dir)).select("row_id", F.length("context").cast("long").alias("chars"), F.md5("context").alias("context"))


def label_net_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.operators.retrieval import label_net
    from mnemospark.plans.search import labels

    net = label_net(labels(spark, sf_dir))
    boost = F.lit(P.LABEL_WEIGHT) * F.greatest(F.lit(P.LABEL_MIN), F.least(F.lit(P.LABEL_MAX), F.col("net")))
    return net.select("fact_id", "net", F.round(boost, 6).alias("boost"))


def label_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.functions.text import instant

    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL")
    labels = w.select(F.col("factid").alias("fact_id"), F.col("device").alias("member"), F.when(F.col("pinned"), "useful").otherwise("noise").alias("verdict"), instant(F.col("updatedat")).alias("ts"), "seq")
    return curation.latest_labels(labels).select("fact_id", "member", "verdict", F.unix_micros("ts").alias("ts"), "version")


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the same hash merged: the sources of all in order of arrival, each once."""
    f = table(spark, sf_dir, "facts").where("content_hash IS NOT NULL")
    many = f.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1").select("content_hash")
    each = f.select("content_hash", "row_id", F.posexplode("source_turn_ids").alias("i", "source"))
    # Each source once, at its first place, before any are gathered: a repeated hash costs no more than its sources.
    first = each.groupBy("content_hash", "source").agg(F.min(F.struct("row_id", "i")).alias("at"))
    by = first.groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("r"))
    ids = F.transform("r", lambda x: x["source"])
    rows = many.join(by, "content_hash", "left")
    return rows.select("content_hash", F.coalesce(F.array_join(ids, ","), F.lit("")).alias("sources"), F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("n"))


def fact_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth fact gets a new content, others are pinned or archived or left alone."""
    f = stored_facts(spark, sf_dir)
    c = f.where("row_id % 3 <> 0").select(
        "id",
        F.when(F.col("row_id") % 10 == 0, F.concat(F.lit("  New: "), "content")).alias("content"),
        F.when(F.col("row_id") % 4 == 0, F.lit(True)).alias("pinned"),
        F.when(F.col("row_id") % 5 == 0, F.lit(True)).alias("archived"),
    )
    out = curation.apply_changes(f, c, "2025-10-01T00:00:00Z")
    return out.select("row_id", "content_hash", "edited", "pinned", "archived", F.col("version").cast("long").alias("version"), "updated_at")


def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the first half of the feed, then those of the second half as new ones."""
    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL")
    cut = (w.agg(F.max("seq")).first()[0] or 0) // 2
    rows = w.select(F.col("factid").alias("fact_id"), F.col("device").alias("member"), F.when(F.col("pinned"), "useful").otherwise("noise").alias("verdict"), F.col("updatedat").alias("ts"), "seq")
    last = lambda d: d.groupBy("fact_id", "member").agg(F.max_by("verdict", "seq").alias("verdict"), F.max_by("ts", "seq").alias("ts"))
    old = last(rows.where(F.col("seq") <= cut)).withColumn("version", F.lit(0))
    return curation.set_labels(old, last(rows.where(F.col("seq") > cut)))


_STRONG = "coalesce(role = 'assistant' AND kind IN ('decision', 'gotcha'), false)"
_SPACE = r"[ \t\n\x0B\f\r\x{00A0}]"
_KIND = r"""CASE WHEN regexp_matches(content, '(?i)\b(decided|decision|we(''ll| will) go with|went with|chose|instead of|rather than|settled on)\b') THEN 'decision'
  WHEN regexp_matches(content, '(?i)\b(gotcha|turns out|root cause|the (real )?(fix|problem|issue) (was|is)|beware|caveat|silently|doesn''t actually|subtle(ty)?)\b') THEN 'gotcha'
  WHEN regexp_matches(content, '(?i)\b(always|never|prefer|convention|from now on|by default|rule of thumb)\b') THEN 'preference'
  WHEN regexp_matches(content, '(?i)\b(the (command|url|endpoint|path|port|token|config|file) (is|lives)|located at|listens on|port [0-9]{2,5})\b') THEN 'reference' END"""
_HASH = rf"sha256(regexp_replace(lower(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g')), '{_SPACE}+', ' ', 'g'))"
_MARK = self_markers(TOOL)


def _recurrence(asked: str) -> str:
    return f"""q AS (SELECT vt.row_id AS query_id, vt.v FROM vt JOIN {asked} USING (row_id)), {knn_sql('vt', 'q', P.RECURRENCE_K)},
rc AS (SELECT k.query_id AS row_id, count(DISTINCT t.session_id) AS sessions FROM k JOIN t USING (row_id) JOIN t o ON o.row_id = k.query_id
  WHERE k.row_id <> k.query_id AND k.similarity >= {P.RECURRENCE_SIMILARITY}::DOUBLE AND t.session_id <> o.session_id GROUP BY 1)"""


_CAND = f"""WITH {TURNS_SQL}, {FACTS_SQL}, {vectors_sql('vec_turns', 'vt')},
cited AS (SELECT DISTINCT unnest(source_turn_ids) AS id FROM f),
d0 AS (SELECT t.*, s.project, {_KIND} AS kind FROM t JOIN (SELECT row_id FROM vec_turns) ve USING (row_id) JOIN sessions s ON s.id = t.session_id
  WHERE length(content) BETWEEN {P.DISTILL_MIN} AND {P.DISTILL_MAX}
    AND NOT (regexp_matches(content, '{_MARK}') OR len(regexp_extract_all(content, '(?i)\\b{TOOL}\\b')) >= 3)
    AND NOT regexp_matches(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^(Base directory for this skill|<command-|<system-reminder|<local-command)')),
d AS (SELECT *, {_STRONG} AS strong FROM d0 WHERE kind IS NOT NULL AND id NOT IN (SELECT id FROM cited WHERE id IS NOT NULL)),
{_recurrence('d')},
dc AS (SELECT d.*, coalesce(rc.sessions, 0) AS sessions FROM d LEFT JOIN rc USING (row_id) WHERE d.strong OR coalesce(rc.sessions, 0) >= {P.RECURRENCE_SESSIONS})"""

QUERIES = {
    "detect_kind": detect_kind,
    "content_hash_dedup": content_hash_dedup,
    "near_duplicate_class": near_duplicate_class,
    "recurrence": recurrence,
    "cited_antijoin": cited_antijoin,
    "distill_candidates": distill_candidates,
    "fact_add": fact_add,
    "distill_run": distill_run,
    "fact_delete": fact_delete,
    "fact_archive": fact_archive,
    "turn_block": turn_block,
    "distill_first": distill_first,
    "pair_context": pair_context,
    "label_net_boost": label_net_boost,
    "label_lww": label_lww,
    "fact_edit": fact_edit,
    "label_upsert": label_upsert,
    "source_union": source_union,
}
SQL = {
    "detect_kind": f"WITH {TURNS_SQL}, x AS (SELECT role, {_KIND} AS kind FROM t) SELECT role, kind, count(*) AS n, count_if({_STRONG})::BIGINT AS strong FROM x GROUP BY 1, 2",
    "content_hash_dedup": f"SELECT {_HASH} AS hash, count(*) AS rows, min(row_id) AS first FROM facts WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "near_duplicate_class": f"""WITH {FACTS_SQL}, {vectors_sql('vec_facts', 'vf')}, n AS (SELECT f.row_id AS query_id, CASE WHEN f.row_id % {2 * QUERY_STEP} = 0 THEN content ELSE content || ' (new)' END AS content FROM f JOIN (SELECT row_id FROM vec_facts) e USING (row_id) WHERE f.row_id % {QUERY_STEP} = 0),
q AS (SELECT vf.row_id AS query_id, vf.v FROM vf WHERE row_id IN (SELECT query_id FROM n)), {knn_sql('vf', 'q', 4, 'k0')}, k AS (SELECT query_id, row_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM k0 WHERE row_id <> query_id QUALIFY rank <= 3),
nh AS (SELECT query_id, sha256(regexp_replace(lower(substring(regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, {P.FACT_CLIP})), '{_SPACE}+', ' ', 'g')) AS h FROM n),
ex AS (SELECT nh.query_id, arg_min(f.id, f.row_id) AS exact FROM nh JOIN f ON f.content_hash = nh.h AND f.row_id <> nh.query_id GROUP BY 1),
cl AS (SELECT k.query_id, arg_min(st.id, k.rank) AS id, arg_min(k.similarity, k.rank) AS similarity FROM k JOIN f st USING (row_id) WHERE NOT coalesce(st.archived, false) AND k.similarity >= {P.NEAR_SIMILARITY}::DOUBLE GROUP BY 1)
SELECT nh.query_id, CASE WHEN ex.exact IS NOT NULL THEN 'merged-exact' WHEN cl.similarity >= {P.MERGE_SIMILARITY}::DOUBLE THEN 'merged-similar' WHEN cl.similarity >= {P.NEAR_SIMILARITY}::DOUBLE THEN 'near-duplicate-inserted' ELSE 'inserted' END AS action,
  coalesce(ex.exact, cl.id) AS fact_id FROM nh LEFT JOIN ex USING (query_id) LEFT JOIN cl USING (query_id)""",
    "fact_delete": f"WITH {FACTS_SQL} SELECT 'fact' AS kind, row_id FROM f WHERE row_id % 7 <> 0 UNION ALL SELECT 'vector', row_id FROM vec_facts WHERE row_id NOT IN (SELECT row_id FROM f WHERE row_id % 7 = 0)",
    "fact_archive": f"WITH {FACTS_SQL} SELECT row_id FROM vec_facts WHERE row_id NOT IN (SELECT row_id FROM f WHERE archived)",
    "turn_block": f"WITH {TURNS_SQL} SELECT row_id FROM vec_turns WHERE row_id NOT IN (SELECT row_id FROM t WHERE row_id % 9 = 0 AND id IS NOT NULL)",
    "recurrence": f"WITH {TURNS_SQL}, {vectors_sql('vec_turns', 'vt')}, asked AS (SELECT t.row_id FROM t JOIN (SELECT row_id FROM vec_turns) e USING (row_id) WHERE t.row_id % {QUERY_STEP} = 0), {_recurrence('asked')} SELECT asked.row_id, coalesce(rc.sessions, 0)::BIGINT AS sessions FROM asked LEFT JOIN rc USING (row_id)",
    "cited_antijoin": f"WITH {TURNS_SQL}, {FACTS_SQL}, c AS (SELECT DISTINCT unnest(source_turn_ids) AS id FROM f) SELECT row_id, id FROM t WHERE id IS NULL OR id NOT IN (SELECT id FROM c WHERE id IS NOT NULL)",
    "distill_candidates": f"{_CAND} SELECT row_id, id, project, kind, sessions::BIGINT AS sessions, strong FROM dc",
    "distill_first": f"{_CAND} SELECT row_id, kind, CASE WHEN strong THEN substring(content, 1, {P.SUMMARY_CLIP}) ELSE '' END AS content, true AS extractive FROM dc ORDER BY row_id LIMIT {P.DISTILL_LIMIT}",
    "pair_context": f"""WITH {TURNS_SQL}, p AS (SELECT *, first_value(CASE WHEN role = 'assistant' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
  last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t),
c AS (SELECT row_id, CASE WHEN role = 'assistant' THEN coalesce('Q: ' || substring(b, 1, 400) || chr(10) || 'A: ' || content, content) ELSE coalesce('Q: ' || content || chr(10) || 'A: ' || substring(a, 1, 1200), content) END AS context FROM p)
SELECT row_id, length(context) AS chars, md5(context) AS context FROM c""",
    "label_net_boost": f"SELECT factid AS fact_id, sum(CASE WHEN pinned THEN 1 ELSE -1 END)::BIGINT AS net, round({P.LABEL_WEIGHT}::DOUBLE * greatest({P.LABEL_MIN}, least({P.LABEL_MAX}, sum(CASE WHEN pinned THEN 1 ELSE -1 END))), 6) AS boost FROM wire_facts WHERE factid IS NOT NULL GROUP BY 1",
    "label_lww": """WITH l AS (SELECT factid AS fact_id, device AS member, CASE WHEN pinned THEN 'useful' ELSE 'noise' END AS verdict, epoch_us(CAST(CASE WHEN regexp_matches(updatedat, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN updatedat ELSE updatedat || 'Z' END AS TIMESTAMPTZ)) AS ts, seq FROM wire_facts WHERE factid IS NOT NULL)
SELECT fact_id, member, arg_max(verdict, (ts, seq)) AS verdict, max(ts) AS ts, count(*) - 1 AS version FROM l GROUP BY 1, 2""",
    "fact_edit": f"""WITH {FACTS_SQL}, c AS (SELECT id, CASE WHEN row_id % 10 = 0 THEN '  New: ' || content END AS nc, CASE WHEN row_id % 4 = 0 THEN true END AS np, CASE WHEN row_id % 5 = 0 THEN true END AS na FROM f WHERE row_id % 3 <> 0),
x AS (SELECT f.*, substring(regexp_replace(c.nc, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 1, {P.FACT_CLIP}) AS nc, c.np, c.na FROM f LEFT JOIN c USING (id)),
y AS (SELECT *, coalesce(nc <> '', false) AS e, coalesce(nc <> '', false) OR coalesce(np <> coalesce(pinned, false), false) OR coalesce(na <> coalesce(archived, false), false) AS m FROM x)
SELECT row_id, CASE WHEN e THEN sha256(regexp_replace(lower(nc), '{_SPACE}+', ' ', 'g')) ELSE content_hash END AS content_hash, CASE WHEN e THEN true ELSE edited END AS edited, coalesce(np, pinned) AS pinned, coalesce(na, archived) AS archived,
  (CASE WHEN m THEN coalesce(version, 0) + 1 ELSE version END)::BIGINT AS version, CASE WHEN m THEN '2025-10-01T00:00:00Z' ELSE updated_at END AS updated_at FROM y""",
    "label_upsert": """WITH r AS (SELECT factid AS fact_id, device AS member, CASE WHEN pinned THEN 'useful' ELSE 'noise' END AS verdict, updatedat AS ts, seq, seq > (SELECT max(seq) // 2 FROM wire_facts WHERE factid IS NOT NULL) AS late FROM wire_facts WHERE factid IS NOT NULL),
l AS (SELECT fact_id, member, late, arg_max(verdict, seq) AS verdict, arg_max(ts, seq) AS ts FROM r GROUP BY 1, 2, 3)
SELECT fact_id, member, arg_max(verdict, late) AS verdict, arg_max(ts, late) AS ts, count(*) - 1 AS version FROM l GROUP BY 1, 2""",
    "source_union": """WITH u AS (SELECT content_hash, row_id, unnest(source_turn_ids) AS id, generate_subscripts(source_turn_ids, 1) AS i FROM facts WHERE content_hash IS NOT NULL),
d AS (SELECT content_hash, id, min((row_id, i)) AS o FROM u GROUP BY 1, 2), g AS (SELECT content_hash FROM facts WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT g.content_hash, coalesce(string_agg(d.id, ',' ORDER BY d.o), '') AS sources, count(d.id) AS n FROM g LEFT JOIN d USING (content_hash) GROUP BY 1""",
}
