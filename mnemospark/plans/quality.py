"""Queries of evaluation: each case asks with the vector of a turn it expects, which itself doesn't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.operators import evaluation
from mnemospark.operators.knn import knn
from mnemospark.plans.base import TURNS_SQL, knn_sql, stored_turns, vectors_sql
from mnemospark.storage import table

POOL = 30


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, the expected and forbidden ids, and asked_row: the row of the first expected turn that has one, or of a turn chosen by the case's number."""
    cases = table(spark, sf_dir, "eval_cases").where("id IS NOT NULL")
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    return cases.select(F.col("id").alias("case_id"), "expected_turn_ids", "expected_session_ids", "forbidden_turn_ids", "exclude_session_id", (number * 7 + 1).alias("asked_row"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    v = table(spark, sf_dir, "vec_turns")
    asked = cases.select(F.col("asked_row").alias("row_id"), "case_id").join(v, "row_id").select(F.col("row_id").alias("query_id"), "embedding")
    near = knn(v, asked, POOL).select(F.col("query_id").alias("asked_row"), "row_id", "similarity")
    turns = stored_turns(spark, sf_dir).select("row_id", F.col("id").alias("turn_id"), "session_id")
    rows = near.join(turns, "row_id").join(cases, "asked_row").where(F.col("exclude_session_id").isNull() | (F.col("session_id") != F.col("exclude_session_id")))
    w = Window.partitionBy("case_id").orderBy(F.desc("similarity"), "row_id")
    ranked = rows.select("case_id", F.row_number().over(w).cast("long").alias("rank"), "turn_id", "session_id", F.col("similarity").alias("score"))
    return evaluation.judged(_expected(spark, sf_dir), ranked)


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases, each also expecting the session of the row after the asked one, so that hits occur at every scale."""
    cases = _cases(spark, sf_dir)
    near = table(spark, sf_dir, "turns").select((F.col("row_id") - 1).alias("asked_row"), F.col("session_id").alias("near"))
    rows = cases.join(near, "asked_row", "left")
    return rows.withColumn("expected_session_ids", F.concat(F.coalesce("expected_session_ids", F.array().cast("array<string>")), F.filter(F.array("near"), lambda x: x.isNotNull()))).drop("near")


def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_at(_expected(spark, sf_dir), _items(spark, sf_dir), [1, 3, 5]).withColumn("hit_rate", F.round("hit_rate", 6))


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_reciprocal_rank(_expected(spark, sf_dir), _items(spark, sf_dir)).withColumn("mrr", F.round("mrr", 6))


_COLUMNS = ("injection_rate", "miss_rate", "precision", "noise_rate", "forbidden_rate", "case_hit_rate", "f05")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in _COLUMNS})


def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.sweep(_expected(spark, sf_dir), _items(spark, sf_dir), [0.75], 3))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.sweep(_expected(spark, sf_dir), _items(spark, sf_dir), evaluation.THRESHOLDS, 3))


def best_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.best(evaluation.sweep(_expected(spark, sf_dir), _items(spark, sf_dir), evaluation.THRESHOLDS, 3)))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.histogram(_items(spark, sf_dir))


def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(_expected(spark, sf_dir), _items(spark, sf_dir))


def fixture_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ordinal_ids(stored_turns(spark, sf_dir))


def seed_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turns that cases may be made of, all of them."""
    t = stored_turns(spark, sf_dir)
    return t.where((F.col("role") == "user") & F.length("content").between(P.SEED_MIN, P.SEED_MAX)).select("row_id")


def case_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of them, always the same."""
    return evaluation.sample(stored_turns(spark, sf_dir), 20).select("row_id", "id")


def expected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "eval_cases").where("id IS NOT NULL").withColumnRenamed("id", "case_id")
    return evaluation.expected_ids(cases).select("case_id", F.array_join("ids", ",").alias("ids"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation as Markdown."""
    queries = table(spark, sf_dir, "eval_cases").select(F.col("id").alias("case_id"), "query")
    found = evaluation.report(_expected(spark, sf_dir), _items(spark, sf_dir), queries)
    return spark.createDataFrame([(evaluation.render(found, True),)], "report string")


_BASE = f"""WITH {vectors_sql('vec_turns', 'vt')}, {TURNS_SQL},
c0 AS (SELECT id AS case_id, expected_turn_ids, expected_session_ids, forbidden_turn_ids, exclude_session_id, regexp_extract(id, '([0-9]+)$', 1)::BIGINT * 7 + 1 AS asked_row FROM eval_cases WHERE id IS NOT NULL),
c AS (SELECT c0.* REPLACE (coalesce(expected_session_ids, []) || CASE WHEN n.session_id IS NULL THEN [] ELSE [n.session_id] END AS expected_session_ids) FROM c0 LEFT JOIN turns n ON n.row_id = c0.asked_row + 1),
q AS (SELECT vt.row_id AS query_id, vt.v FROM c0 JOIN vt ON vt.row_id = c0.asked_row),
{knn_sql('vt', 'q', POOL)},
r AS (SELECT c.case_id, row_number() OVER (PARTITION BY c.case_id ORDER BY k.similarity DESC, k.row_id) AS rank, t.id AS turn_id, t.session_id, k.similarity AS score,
    coalesce(list_contains(c.expected_turn_ids, t.id), false) OR coalesce(list_contains(c.expected_session_ids, t.session_id), false) AS hit, coalesce(list_contains(c.forbidden_turn_ids, t.id), false) AS forbidden
  FROM k JOIN t USING (row_id) JOIN c ON c.asked_row = k.query_id WHERE c.exclude_session_id IS NULL OR t.session_id <> c.exclude_session_id),
fh AS (SELECT c.case_id, min(CASE WHEN r.hit THEN r.rank END) AS first FROM c LEFT JOIN r USING (case_id) GROUP BY 1)"""


def _sweep(thresholds: str, limit: int) -> str:
    return f"""{_BASE}, th AS (SELECT {thresholds} AS threshold),
sh AS (SELECT th.threshold, r.* FROM r JOIN th ON r.score >= th.threshold QUALIFY row_number() OVER (PARTITION BY th.threshold, r.case_id ORDER BY r.rank) <= {limit}),
bc AS (SELECT threshold, case_id, count(*) AS n, count_if(hit) AS h, count_if(forbidden) AS f FROM sh GROUP BY 1, 2),
tt AS (SELECT threshold, count(*) AS showing, count_if(h > 0) AS with_hit, sum(n) AS injected, sum(h) AS hits, sum(f) AS bad FROM bc GROUP BY 1),
ff AS (SELECT th.threshold, coalesce(showing, 0)::DOUBLE AS showing, coalesce(with_hit, 0)::DOUBLE AS with_hit, coalesce(injected, 0)::DOUBLE AS injected, coalesce(hits, 0)::DOUBLE AS hits, coalesce(bad, 0)::DOUBLE AS bad,
   greatest(1, (SELECT count(*) FROM c))::DOUBLE AS n FROM th LEFT JOIN tt USING (threshold)),
g AS (SELECT *, CASE WHEN injected > 0 THEN hits / injected ELSE 1.0::DOUBLE END AS p, with_hit / n AS w FROM ff),
sw AS (SELECT threshold, round(showing / n, 6) AS injection_rate, round(1 - showing / n, 6) AS miss_rate, round(p, 6) AS precision, round(1 - p, 6) AS noise_rate,
   round(CASE WHEN injected > 0 THEN bad / injected ELSE 0::DOUBLE END, 6) AS forbidden_rate, round(w, 6) AS case_hit_rate,
   CASE WHEN 0.25 * p + w > 0 THEN 1.25::DOUBLE * p * w / (0.25::DOUBLE * p + w) ELSE 0::DOUBLE END AS f05_raw, injected::BIGINT AS injected, hits::BIGINT AS hits FROM g)
"""


_OUT = "threshold, injection_rate, miss_rate, precision, noise_rate, forbidden_rate, case_hit_rate, round(f05_raw, 6) AS f05, injected, hits"
_STEPS = "unnest(range(50, 96)) / 100::DOUBLE"

QUERIES = {
    "hit_at_k": hit_at_k,
    "mrr": mrr,
    "operating_point": operating_point,
    "threshold_sweep": threshold_sweep,
    "best_f05": best_f05,
    "score_histogram": score_histogram,
    "eval_failures": eval_failures,
    "eval_report": eval_report,
    "fixture_ids": fixture_ids,
    "seed_band": seed_band,
    "case_sample": case_sample,
    "expected_ids": expected_ids,
}
SQL = {
    "hit_at_k": f"{_BASE} SELECT k::BIGINT AS k, round(avg(CASE WHEN first <= k THEN 1.0::DOUBLE ELSE 0::DOUBLE END), 6) AS hit_rate FROM fh, (SELECT unnest([1, 3, 5]) AS k) GROUP BY 1",
    "mrr": f"{_BASE} SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS cases FROM fh",
    "operating_point": f"{_sweep('0.75::DOUBLE', 3)} SELECT {_OUT} FROM sw",
    "threshold_sweep": f"{_sweep(_STEPS, 3)} SELECT {_OUT} FROM sw",
    "best_f05": f"{_sweep(_STEPS, 3)} SELECT {_OUT} FROM sw ORDER BY round(f05_raw, 12) DESC, threshold LIMIT 1",
    "score_histogram": f"""{_BASE}, b AS (SELECT greatest(0, least(9, floor((score - 0.5) / 0.05)))::BIGINT AS number, hit FROM r)
SELECT printf('%.2f-%.2f', 0.5 + n.number * 0.05, 0.55 + n.number * 0.05) AS bucket, count_if(b.hit)::BIGINT AS hits, count_if(NOT b.hit)::BIGINT AS misses FROM (SELECT unnest(range(10)) AS number) n LEFT JOIN b USING (number) GROUP BY n.number""",
    "eval_failures": f"""{_BASE} SELECT fh.case_id, coalesce((SELECT string_agg(coalesce(session_id, ''), ',' ORDER BY rank) FROM r WHERE r.case_id = fh.case_id AND rank <= 3), '') AS got FROM fh WHERE first IS NULL OR first > 3""",
    "fixture_ids": f"WITH {TURNS_SQL} SELECT row_id, 'fx:' || session_id || ':' || row_number() OVER (PARTITION BY session_id ORDER BY row_id) AS id FROM t WHERE session_id IS NOT NULL",
    "seed_band": f"WITH {TURNS_SQL} SELECT row_id FROM t WHERE role = 'user' AND length(content) BETWEEN {P.SEED_MIN} AND {P.SEED_MAX}",
    "expected_ids": """WITH u AS (SELECT id AS case_id, unnest(coalesce(expected_session_ids, []) || coalesce(expected_turn_ids, [])) AS x, generate_subscripts(coalesce(expected_session_ids, []) || coalesce(expected_turn_ids, []), 1) AS i FROM eval_cases WHERE id IS NOT NULL),
d AS (SELECT case_id, x, min(i) AS i FROM u GROUP BY 1, 2) SELECT e.id AS case_id, coalesce(string_agg(d.x, ',' ORDER BY d.i), '') AS ids FROM eval_cases e LEFT JOIN d ON d.case_id = e.id WHERE e.id IS NOT NULL GROUP BY 1""",
}
