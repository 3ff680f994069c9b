"""Queries of search: every hundredth turn's vector asks the whole store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.render import snippet_list as snippet_markdown
from mnemospark.functions.rules import clip, self_markers
from mnemospark.operators import retrieval
from mnemospark.operators.knn import knn
from mnemospark.plans.base import FACTS_SQL, INJECT, QUERY_STEP, TOOL, TURNS_SQL, knn_sql, stored_facts, stored_turns, vectors_sql
from mnemospark.storage import table



def _vectors(spark: SparkSession, sf_dir: str, name: str = "vec_turns") -> DataFrame:
    return table(spark, sf_dir, name)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding, query, exclude_session_id, project: a third of the queries names its session's project."""
    v = table(spark, sf_dir, "vec_turns").where(F.col("row_id") % QUERY_STEP == 0)
    t = table(spark, sf_dir, "turns").where(F.col("row_id") % QUERY_STEP == 0).select("row_id", "content", "session_id")
    s = table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), F.col("project").alias("p"))
    rows = v.join(t, "row_id").join(s, "session_id", "left")
    project = F.when(F.col("row_id") % (3 * QUERY_STEP) == 0, F.col("p"))
    return rows.select(F.col("row_id").alias("query_id"), "embedding", F.col("content").alias("query"), F.col("session_id").alias("exclude_session_id"), project.alias("project"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_turns(spark, sf_dir).withColumn("content", F.concat("content", F.expr(INJECT)))


_Q = f"""{vectors_sql('vec_turns', 'vt')}, {vectors_sql('vec_facts', 'vf')}, {TURNS_SQL}, {FACTS_SQL},
s AS (SELECT id AS session_id, project FROM sessions),
q AS (SELECT v.row_id AS query_id, v.v, t0.content AS query, t0.session_id AS exclude_session_id, CASE WHEN v.row_id % {3 * QUERY_STEP} = 0 THEN s.project END AS project
  FROM vt v JOIN turns t0 USING (row_id) LEFT JOIN s ON s.session_id = t0.session_id WHERE v.row_id % {QUERY_STEP} = 0),
ti AS (SELECT * REPLACE (content || {INJECT} AS content) FROM t)"""
_MARK = self_markers(TOOL)


def _candidates_sql(pool: int) -> str:
    return f"""{knn_sql('vt', 'q', pool)},
c0 AS (SELECT k.query_id, k.row_id, ti.id AS turn_id, ti.session_id, ti.role, ti.content, ti.ts, s.project, k.similarity AS raw_score,
    NOT coalesce(regexp_matches(q.query, '(?i){TOOL}|memor(y|ies)|past session|userpromptsubmit|hook'), false)
      AND coalesce(regexp_matches(ti.content, '{_MARK}') OR len(regexp_extract_all(ti.content, '(?i)\\b{TOOL}\\b')) >= 3, false) AS self_penalized
  FROM k JOIN ti USING (row_id) JOIN s ON s.session_id = ti.session_id JOIN q ON q.query_id = k.query_id
  WHERE (q.exclude_session_id IS NULL OR ti.session_id <> q.exclude_session_id) AND (q.project IS NULL OR s.project = q.project)),
c AS (SELECT *, raw_score - CASE WHEN self_penalized THEN {P.SELF_PENALTY}::DOUBLE ELSE 0::DOUBLE END AS score FROM c0)"""


def _snippets_sql(source: str, limit: int, min_score: float, name: str = "sn") -> str:
    return f"""{name}1 AS (SELECT * FROM {source} WHERE score >= {min_score}::DOUBLE QUALIFY row_number() OVER (PARTITION BY query_id, session_id ORDER BY score DESC, row_id) = 1),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS position FROM {name}1 QUALIFY position <= {limit}),
{name} AS (SELECT x.query_id, x.row_id, x.turn_id, x.session_id, x.score, x.position, p.text FROM {name}2 x JOIN pt p ON p.row_id = x.row_id)"""


_PAIRED = f"""pt0 AS (SELECT *, first_value(CASE WHEN role = 'assistant' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
  last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ti),
pt AS (SELECT row_id, session_id, role, CASE WHEN role = 'user' THEN coalesce('Q: ' || content || chr(10) || 'A: ' || CASE WHEN length(a) > {P.PAIR_ANSWER_CLIP} THEN substring(a, 1, {P.PAIR_ANSWER_CLIP}) || '…' ELSE a END, content)
  ELSE coalesce('Q: ' || CASE WHEN length(b) > {P.PAIR_QUESTION_CLIP} THEN substring(b, 1, {P.PAIR_QUESTION_CLIP}) || '…' ELSE b END || chr(10) || 'A: ' || content, content) END AS text FROM pt0)"""

_FACTS = f"""{knn_sql('vf', 'q', P.fact_pool(P.LIMIT), 'kf')},
lab AS (SELECT factid AS fact_id, sum(CASE WHEN pinned THEN 1 ELSE -1 END)::BIGINT AS net FROM wire_facts WHERE factid IS NOT NULL GROUP BY 1),
mem AS (SELECT DISTINCT origin_member AS member_id, upper(origin_member) AS name FROM facts WHERE origin_member IS NOT NULL AND origin_member <> 'm_reader'),
fm AS (SELECT kf.query_id, kf.row_id, f.id AS fact_id, f.kind, f.content, f.source_turn_ids, m.name AS via, kf.similarity,
    round(kf.similarity + {P.FACT_BOOST}::DOUBLE + CASE WHEN coalesce(f.pinned, false) THEN {P.PIN_BOOST}::DOUBLE ELSE 0::DOUBLE END + {P.LABEL_WEIGHT}::DOUBLE * greatest({P.LABEL_MIN}, least({P.LABEL_MAX}, coalesce(lab.net, 0))), 9) AS score
  FROM kf JOIN f USING (row_id) JOIN q ON q.query_id = kf.query_id LEFT JOIN lab ON lab.fact_id = f.id LEFT JOIN mem m ON m.member_id = f.origin_member
  WHERE NOT coalesce(f.archived, false) AND (q.project IS NULL OR f.project = q.project))"""

MIN = 0.3


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on facts, as the operations of the feed stand for them: a pinning one is useful."""
    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL")
    return w.select(F.col("factid").alias("fact_id"), F.when(F.col("pinned"), "useful").otherwise("noise").alias("verdict"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of members; one of them left the team and has none."""
    m = table(spark, sf_dir, "facts").where("origin_member IS NOT NULL AND origin_member <> 'm_reader'")
    return m.select(F.col("origin_member").alias("member_id"), F.upper("origin_member").alias("name")).distinct()


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 turns nearest the first usable vector, the flagship single search."""
    v = _vectors(spark, sf_dir)
    one = v.where(F.size("embedding") == P.DIMS).orderBy("row_id").limit(1)
    return knn(v, one.select(F.col("row_id").alias("query_id"), "embedding"), P.turn_pool(4)).select("query_id", "row_id", F.round("similarity", 6).alias("similarity"), "rank")


def knn_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    q = v.where(F.col("row_id") % QUERY_STEP == 0).select(F.col("row_id").alias("query_id"), "embedding")
    return knn(v, q, 24).select("query_id", "row_id", F.round("similarity", 6).alias("similarity"), "rank")


def nearest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir, "vec_facts")
    q = v.where(F.col("row_id") % 50 == 0).select(F.col("row_id").alias("query_id"), "embedding")
    return knn(v, q, 3).select("query_id", "row_id", F.round("similarity", 6).alias("similarity"), "rank")


def _found(spark: SparkSession, sf_dir: str, limit: int = P.LIMIT) -> DataFrame:
    return retrieval.candidates(_queries(spark, sf_dir), _vectors(spark, sf_dir), _turns(spark, sf_dir), table(spark, sf_dir, "sessions"), TOOL, limit)


def candidates_penalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _found(spark, sf_dir)
    return c.select("query_id", "row_id", "turn_id", "session_id", "self_penalized", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"))


def knn_postfilter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each query that names a project keeps: the filter comes after the nearest rows are taken."""
    q = _queries(spark, sf_dir).where("project IS NOT NULL").select("query_id")
    n = _found(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("kept"))
    return q.join(n, "query_id", "left").select("query_id", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


def one_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieval.snippets(_found(spark, sf_dir), _turns(spark, sf_dir), P.LIMIT, MIN)
    return s.select("query_id", "position", "row_id", "session_id", F.round("score", 6).alias("score"), F.md5("text").alias("text"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.paired(_turns(spark, sf_dir)).select("row_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text"))


def fact_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    return m.select("query_id", "fact_id", "kind", "via", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fact_matches(_queries(spark, sf_dir), _vectors(spark, sf_dir, "vec_facts"), stored_facts(spark, sf_dir), labels(spark, sf_dir), members(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.merged(_found(spark, sf_dir), _matches(spark, sf_dir), _turns(spark, sf_dir), P.LIMIT, MIN)


def merged_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("query_id", "position", "source", "id", "session_id", F.round("score", 6).alias("score"), F.md5("text").alias("text"))


def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the merged ranking fits a prompt: pieces in order until the first that overflows."""
    rows = _merged(spark, sf_dir).where(F.col("position") <= P.HOOK_LIMIT)
    rows = rows.withColumn("piece", F.concat(F.lit("- "), F.when(F.col("source") == "fact", "* ").otherwise(""), clip(F.col("text"), P.HOOK_SNIPPET, True), F.lit("\n")))
    return retrieval.within_budget(rows, "piece", 700).select("query_id", "position", "source", "used", F.md5("piece").alias("piece"))


def snippet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best turn of each session as a list in Markdown, one for each query; how the list looks is fixed."""
    s = retrieval.snippets(_found(spark, sf_dir), _turns(spark, sf_dir), P.LIMIT, MIN)
    return snippet_markdown(s.withColumn("score", F.round("score", 6))).select("query_id", F.md5("markdown").alias("markdown"))


_MERGED = f"""{_Q}, {_candidates_sql(P.turn_pool(P.LIMIT))}, {_PAIRED}, {_FACTS},
fs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC, row_id) AS position FROM fm WHERE score >= {MIN - P.FACT_RELIEF}::DOUBLE QUALIFY position <= {P.LIMIT - 1}),
used AS (SELECT DISTINCT query_id, unnest(source_turn_ids) AS turn_id FROM fs),
c2 AS (SELECT c.* FROM c ANTI JOIN used USING (query_id, turn_id)),
{_snippets_sql('c2', P.LIMIT, MIN)},
m0 AS (SELECT query_id, 'fact' AS source, fact_id AS id, 'fact:' || fact_id AS session_id, content AS text, score, position FROM fs
  UNION ALL SELECT query_id, 'turn', turn_id, session_id, text, score, position FROM sn),
m AS (SELECT query_id, source, id, session_id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source = 'turn', position) AS p FROM m0 QUALIFY p <= {P.LIMIT})"""

QUERIES = {
    "knn_topk": knn_topk,
    "knn_topk_per_query": knn_topk_per_query,
    "nearest_facts": nearest_facts,
    "candidates_penalized": candidates_penalized,
    "knn_postfilter_project": knn_postfilter_project,
    "one_per_session": one_per_session,
    "qa_pairs": qa_pairs,
    "fact_scored": fact_scored,
    "merged_ranking": merged_ranking,
    "char_budget": char_budget,
    "snippet_list": snippet_list,
}
SQL = {
    "knn_topk": f"WITH {vectors_sql('vec_turns', 'vt')}, q AS (SELECT row_id AS query_id, v FROM vt ORDER BY row_id LIMIT 1), {knn_sql('vt', 'q', 24)} SELECT query_id, row_id, round(similarity, 6) AS similarity, rank FROM k",
    "knn_topk_per_query": f"WITH {vectors_sql('vec_turns', 'vt')}, q AS (SELECT row_id AS query_id, v FROM vt WHERE row_id % {QUERY_STEP} = 0), {knn_sql('vt', 'q', 24)} SELECT query_id, row_id, round(similarity, 6) AS similarity, rank FROM k",
    "nearest_facts": f"WITH {vectors_sql('vec_facts', 'vf')}, q AS (SELECT row_id AS query_id, v FROM vf WHERE row_id % 50 = 0), {knn_sql('vf', 'q', 3)} SELECT query_id, row_id, round(similarity, 6) AS similarity, rank FROM k",
    "candidates_penalized": f"WITH {_Q}, {_candidates_sql(30)} SELECT query_id, row_id, turn_id, session_id, self_penalized, round(raw_score, 6) AS raw_score, round(score, 6) AS score FROM c",
    "knn_postfilter_project": f"WITH {_Q}, {_candidates_sql(30)} SELECT q.query_id, count(c.row_id) AS kept FROM q LEFT JOIN c USING (query_id) WHERE q.project IS NOT NULL GROUP BY 1",
    "one_per_session": f"WITH {_Q}, {_candidates_sql(30)}, {_PAIRED}, {_snippets_sql('c', P.LIMIT, MIN)} SELECT query_id, position, row_id, session_id, round(score, 6) AS score, md5(text) AS text FROM sn",
    "qa_pairs": f"WITH {_Q}, {_PAIRED} SELECT row_id, length(text) AS chars, md5(text) AS text FROM pt",
    "fact_scored": f"WITH {_Q}, {_FACTS} SELECT query_id, fact_id, kind, via, round(similarity, 6) AS similarity, round(score, 6) AS score FROM fm",
    "merged_ranking": f"WITH {_MERGED} SELECT query_id, p AS position, source, id, session_id, round(score, 6) AS score, md5(text) AS text FROM m",
    "char_budget": f"""WITH {_MERGED}, pc AS (SELECT query_id, p AS position, source, '- ' || CASE WHEN source = 'fact' THEN '* ' ELSE '' END || CASE WHEN length(text) > {P.HOOK_SNIPPET} THEN substring(text, 1, {P.HOOK_SNIPPET}) || '…' ELSE text END || chr(10) AS piece FROM m WHERE p <= {P.HOOK_LIMIT})
SELECT query_id, position, source, used, md5(piece) AS piece FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY query_id ORDER BY position ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM pc) WHERE used <= 700""",
    "snippet_list": f"""WITH {_Q}, {_candidates_sql(30)}, {_PAIRED}, {_snippets_sql('c', P.LIMIT, MIN)}, x AS (SELECT sn.query_id, sn.position, '### ' || sn.position || '. ' || coalesce(c.role, '') || ' (' || coalesce(substring(c.ts, 1, 10), 'unknown date') || coalesce(' · ' || c.project, '') || ', score ' || printf('%.2f', round(sn.score, 6)) || ')' || chr(10) || coalesce(sn.text, '') AS piece
FROM sn JOIN c ON c.query_id = sn.query_id AND c.row_id = sn.row_id) SELECT query_id, md5(string_agg(piece, chr(10) || chr(10) ORDER BY position)) AS markdown FROM x GROUP BY 1""",
}
