"""Queries of the operators for training text, over the whole tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import ASSISTANT_ROLES, STAND_INS, USER_ROLES
from mnemospark.llm import conversations, endings, language, leakage, mixing, neardup, neighbours, pairs, secrets
from mnemospark.storage import materialize, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, content and source of turns and facts, one row a row."""
    turns = table(spark, sf_dir, "turns").select(F.lit("turns").alias("tbl"), "id", "content", F.col("session_id").alias("source"))
    facts = table(spark, sf_dir, "facts").select(F.lit("facts").alias("tbl"), "id", "content", F.col("origin").alias("source"))
    return turns.unionByName(facts).where("id IS NOT NULL")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id of cut contents. Repeated rows of an id have the same content, so only the rows found are made distinct."""
    found = endings.find_cut(_texts(spark, sf_dir), table(spark, sf_dir, "lang_samples"))
    return found.where("cut").select("tbl", "id").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source_agent of turns and each origin of facts: contents with text, how many are cut, the share."""
    found = endings.find_cut(_texts(spark, sf_dir), table(spark, sf_dir, "lang_samples"), ("source",))
    each = found.groupBy("tbl", "id").agg(F.max("cut").alias("cut"), F.min("source").alias("source"))
    agents = table(spark, sf_dir, "sessions").select(F.col("id").alias("source"), "source_agent", F.lit("turns").alias("tbl"))
    named = each.join(agents, ["tbl", "source"], "left").select(
        "tbl", "cut", F.when(F.col("tbl") == "turns", F.col("source_agent")).otherwise(F.col("source")).alias("source")
    )
    return named.groupBy("tbl", "source").agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut"), (F.count_if("cut") / F.count("*")).alias("share")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, defect of the sessions to be dropped."""
    ordered, others = conversations.order_turns(table(spark, sf_dir, "turns"))
    return conversations.session_defects(ordered, others, table(spark, sf_dir, "sessions")).where("defect IS NOT NULL")


def p2_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-to-leaf paths by explicit parents: row_id, thread, depth, state and leaf of every speaker's turn.

    A turn's parent is the one before it in time; rows divisible by 1000 name the one after them instead, so that the
    two make a cycle, and those divisible by 1001 a row that isn't there.
    """
    ordered, _ = conversations.order_turns(table(spark, sf_dir, "turns"))
    before = ordered.where("next_row IS NOT NULL").select(F.col("next_row").alias("row_id"), F.col("row_id").alias("before"))
    n = F.col("row_id")
    parent = F.when((n % 1000 == 0) & F.col("next_row").isNotNull(), F.col("next_row")).when(n % 1001 == 0, -n - 1).otherwise(F.col("before"))
    messages = materialize(ordered.select("row_id", "next_row").join(before, "row_id", "left").select("row_id", parent.alias("parent_id")), "parents")
    found = conversations.threads(messages, "row_id", "parent_id")
    answered = messages.select(F.col("parent_id").alias("row_id")).where("row_id IS NOT NULL").distinct().withColumn("answered", F.lit(True))
    return found.join(answered, "row_id", "left").select("row_id", "thread", F.col("depth").cast("long").alias("depth"), "state", F.col("answered").isNull().alias("leaf"))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that are kept, a row for each speaker's turn in order."""
    return conversations.conversations(table(spark, sf_dir, "turns"), table(spark, sf_dir, "sessions"))


def _repeated(spark: SparkSession, sf_dir: str, vectors: str, rows: str) -> DataFrame:
    """row_id of the vectors whose id has a vector with a smaller row_id: repeated rows of one id count once."""
    named = table(spark, sf_dir, vectors).select("row_id").join(table(spark, sf_dir, rows).where("id IS NOT NULL").select("row_id", "id"), "row_id")
    grouped = named.groupBy("id").agg(F.min("row_id").alias("first"), F.collect_list("row_id").alias("rows")).where(F.size("rows") > 1)
    return grouped.select("first", F.explode("rows").alias("row_id")).where("row_id <> first").select("row_id")


def _neighbours(spark: SparkSession, sf_dir: str, vectors: str, rows: str, floor: float | None) -> DataFrame:
    skip = materialize(_repeated(spark, sf_dir, vectors, rows), "repeated")
    return neighbours.nearest(table(spark, sf_dir, vectors), floor=floor, skip=skip).select(F.lit(vectors).alias("tbl"), "*")


def _all_neighbours(spark: SparkSession, sf_dir: str, floor: float | None) -> DataFrame:
    return _neighbours(spark, sf_dir, "vec_turns", "turns", floor).unionByName(_neighbours(spark, sf_dir, "vec_facts", "facts", floor))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_id, other, similarity: the ten most similar vectors of each, however far they are."""
    return _all_neighbours(spark, sf_dir, None)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_a < row_b, from a similarity of 0.6, of which at least one is among the ten most similar of the other."""
    rows = _all_neighbours(spark, sf_dir, 0.6)
    return rows.select("tbl", F.least("row_id", "other").alias("row_a"), F.greatest("row_id", "other").alias("row_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, defect of every pair with a defect."""
    return pairs.pair_defects(table(spark, sf_dir, "turns"), table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "sessions")).distinct()


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = secrets.find_secrets(table(spark, sf_dir, "turns").where("id IS NOT NULL"), ["content", "tool_summary"], ["id"])
    facts = secrets.find_secrets(table(spark, sf_dir, "facts").where("id IS NOT NULL"), ["content"], ["id"])
    return turns.select(F.lit("turns").alias("tbl"), "*").unionByName(facts.select(F.lit("facts").alias("tbl"), "*"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, field, secret: each credential of a field once."""
    return _secrets(spark, sf_dir).select("tbl", "id", "field", F.explode("secrets").alias("secret")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold credentials, with nothing but the credentials replaced."""
    rows = _secrets(spark, sf_dir).select("tbl", "id", "field", "redacted", F.size("secrets").alias("credentials"))
    return rows.dropDuplicates(["tbl", "id", "field"])


#: Problem 7's own case: shingles of three words, overlap of 0.6, texts of 40 words or more.
P7 = {"size": 3, "threshold": 0.6, "min_words": 40}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id_a, id_b of contents that are similar enough."""
    return neardup.similar_pairs(_texts(spark, sf_dir), **P7)


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content of 40 words or more with its class, number of links and group."""
    return neardup.duplicate_groups(_texts(spark, sf_dir), **P7)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_cases"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, case_id of documents with at least 24 words of a passage in a row."""
    return _leaks(spark, sf_dir).where("exact_windows > 0").select("doc_id", "case_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item: how many documents hold a part of it word for word, how many something similar."""
    found = _leaks(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("exact_windows") > 0).alias("documents"), F.count("*").alias("similar_documents"))
    items = table(spark, sf_dir, "eval_cases").where("id IS NOT NULL").select(F.col("id").alias("case_id")).distinct()
    return items.join(found, "case_id", "left").na.fill(0)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, repeats of the documents that are combined."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share of all tokens."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the sources' own shares, tempered to the entropy of the targets, for half as many tokens again as
    fit: both exponents are bisected."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), wanted_entropy="targets", stretch=1.5)[1]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang: the languages of documents whose label is missing, unusable, wrong or not the only one."""
    rows = _labelled(spark, sf_dir).where("label_state IN ('missing', 'unusable', 'wrong', 'mixed')")
    return rows.select("doc_id", F.explode("found_langs").alias("lang"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's segments with their language and confidence, beside the document's own."""
    rows = _labelled(spark, sf_dir).select("doc_id", "found_lang", "found_confidence", "label_state", F.explode_outer("found_segments").alias("s"))
    return rows.select("doc_id", "found_lang", "found_confidence", "label_state", "s.start", "s.end", F.col("s.lang").alias("segment_lang"), F.col("s.confidence").alias("segment_confidence"))


QUERIES = {
    "p1_found": p1_found,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_threads": p2_threads,
    "p2_conversations": p2_conversations,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_tempered": p9_tempered,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}
_TIME = """coalesce(CASE WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{1,2}:\\d{2}') THEN TRY_CAST(CASE WHEN regexp_matches(x, '([zZ]|UTC|GMT|[+-]\\d{2}:?\\d{2})$') THEN regexp_replace(regexp_replace(x, '\\s*(UTC|GMT)$', 'Z'), '([+-]\\d{2})(\\d{2})$', '\\1:\\2') ELSE x || 'Z' END AS TIMESTAMPTZ)
    WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(x || ' 00:00:00Z' AS TIMESTAMPTZ) END,
  CASE WHEN regexp_matches(x, '^\\d{10}(\\.\\d{1,6})?$') THEN to_timestamp(x::DOUBLE) WHEN regexp_matches(x, '^\\d{13}$') THEN to_timestamp(x::DOUBLE / 1000) END)"""
_STAND = ", ".join("'" + s.replace("'", "''") + "'" for s in STAND_INS)
_NO_TEXT = rf"""coalesce(NOT regexp_matches(content, '[\p{{L}}\p{{N}}]') OR (length(content) < 60 AND regexp_replace(lower(content), '^[\s\p{{Z}}\p{{Cf}}\[\](){{}}<>"''`*_.:;!-]+|[\s\p{{Z}}\p{{Cf}}\[\](){{}}<>"''`*_.:;!-]+$', '', 'g') IN ({_STAND})), true)"""
_ROLE = "lower(regexp_replace(role, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))"
_USERS, _ANSWERERS = (", ".join(f"'{r}'" for r in names) for names in (USER_ROLES, ASSISTANT_ROLES))
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

_ORDERED = f"""o AS (SELECT * FROM turns WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(id, 'row:' || row_id) ORDER BY row_id) = 1),
p AS (SELECT row_id, session_id, {_ROLE} AS r, {_NO_TEXT} AS blank, regexp_replace(ts, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS x FROM o),
t AS (SELECT row_id, session_id, blank, {_TIME} AS tm, CASE WHEN r IN ({_USERS}) THEN 'user' WHEN r IN ({_ANSWERERS}) THEN 'assistant' WHEN r IN ('', 'null', 'none', 'undefined', 'unknown', 'n/a', 'nan') THEN NULL ELSE r END AS who FROM p),
q AS (SELECT *, CASE WHEN tm IS NOT NULL AND who IN ('user', 'assistant') THEN row_number() OVER (PARTITION BY session_id, (tm IS NOT NULL AND who IN ('user', 'assistant')) ORDER BY tm, row_id) END AS n FROM t)"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_ORDERED},
s AS (SELECT session_id, bool_or(coalesce(who <> 'note', true)) AS other, bool_or(NOT blank AND (who IS NULL OR who IN ('user', 'assistant'))) AS content, bool_or(who IS NULL OR (who IN ('user', 'assistant') AND n IS NULL)) AS odd,
  min(CASE WHEN NOT blank AND who = 'assistant' THEN n END) AS a0, min(CASE WHEN NOT blank AND who = 'user' THEN n END) AS u0, max(CASE WHEN NOT blank AND who = 'assistant' THEN n END) AS a1, max(CASE WHEN NOT blank AND who = 'user' THEN n END) AS u1 FROM q GROUP BY 1),
j AS (SELECT coalesce(s.session_id, e.id) AS session_id, s.* EXCLUDE (session_id) FROM s FULL OUTER JOIN (SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL) e ON e.id = s.session_id),
d AS (SELECT session_id, CASE WHEN NOT coalesce(content, false) THEN 'empty' WHEN odd OR (a0 IS NOT NULL AND (u0 IS NULL OR a0 < u0)) THEN 'broken' WHEN u1 > coalesce(a1, -1) THEN 'missing_reply' END AS defect FROM j WHERE coalesce(other, true))
SELECT session_id, defect FROM d WHERE defect IS NOT NULL""",
    "p2_threads": f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT row_id, lag(row_id) OVER w AS b, lead(row_id) OVER w AS a FROM q WHERE n IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY n)),
m AS (SELECT row_id, CASE WHEN row_id % 1000 = 0 AND a IS NOT NULL THEN a WHEN row_id % 1001 = 0 THEN -row_id - 1 ELSE b END AS p FROM r),
s AS (SELECT row_id, row_id AS root, 0 AS depth, CASE WHEN p IS NULL THEN 'ok' ELSE 'orphan' END AS state FROM m WHERE p IS NULL OR p NOT IN (SELECT row_id FROM m)
  UNION ALL SELECT m.row_id, s.root, s.depth + 1, s.state FROM m JOIN s ON m.p = s.row_id)
SELECT m.row_id, s.root AS thread, s.depth::BIGINT AS depth, coalesce(s.state, 'cycle') AS state, NOT EXISTS (SELECT 1 FROM m c WHERE c.p = m.row_id) AS leaf FROM m LEFT JOIN s USING (row_id)""",
    "p7_found": f"""WITH d AS (SELECT DISTINCT 'turns' AS tbl, id, content FROM turns WHERE id IS NOT NULL AND content IS NOT NULL UNION SELECT DISTINCT 'facts', id, content FROM facts WHERE id IS NOT NULL AND content IS NOT NULL),
w AS (SELECT tbl, id, {_WORDS.format('content')} AS w FROM d), k AS (SELECT * FROM w WHERE len(w) >= 40),
s AS (SELECT DISTINCT tbl, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM k), n AS (SELECT tbl, id, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS same FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3)
SELECT c.tbl, id_a, id_b FROM c JOIN n a ON a.tbl = c.tbl AND a.id = id_a JOIN n b ON b.tbl = c.tbl AND b.id = id_b WHERE same >= 0.6 * (a.n + b.n - same) - 1e-9""",
    "p8_found": f"""WITH i AS (SELECT DISTINCT id AS case_id, {_WORDS.format('passage')} AS w FROM eval_cases WHERE id IS NOT NULL AND passage IS NOT NULL),
r AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 22), lambda k: hash(array_to_string(w[k:k + 23], ' ')))) AS h FROM i WHERE len(w) >= 24),
x AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
v AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 22), lambda k: hash(array_to_string(w[k:k + 23], ' ')))) AS h FROM x WHERE len(w) >= 24)
SELECT DISTINCT doc_id, case_id FROM v JOIN r USING (h)""",
}
