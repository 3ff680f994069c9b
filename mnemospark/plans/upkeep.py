"""Queries of ingest sinks and maintenance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions import rules
from mnemospark.functions.redaction import MIN_ENTROPY, NO_SECRET, RULES, redact
from mnemospark.operators import store
from mnemospark.plans.base import INJECT, TOOL, TURNS_SQL, stored_turns
from mnemospark.storage import table

ROOTS = [("/work", "work"), ("/work/kettle-outlet", "kettle"), ("c:/dev", "windows"), ("/home/dev/russet-queue", "russet")]
PRUNE = ["nettle", "/tmp", "HARBOR"]
SPACE = r"[ \t\n\x0B\f\r\x{00A0}]"


def derive_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions").select("id", "cwd", rules.project_of(F.col("cwd"), ROOTS).alias("label"))


def reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.reproject(table(spark, sf_dir, "sessions"), ROOTS, PRUNE).where("action <> 'keep'")
    return rows.groupBy("action", "from", "to").agg(F.count("*").alias("n"))


def prune_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table after the sessions in unwanted folders went."""
    s, t, v = table(spark, sf_dir, "sessions"), stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns")
    gone = store.reproject(s, ROOTS, PRUNE).where("action = 'prune'")
    a, b, c = store.cascade(s, t, v, gone)
    count = lambda d, n: d.agg(F.lit(n).alias("kind"), F.count("*").alias("n"))
    return count(a, "sessions").unionByName(count(b, "turns")).unionByName(count(c, "vectors"))


def low_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_turns(spark, sf_dir)
    return t.groupBy("role").agg(F.count("*").alias("n"), F.count_if(rules.low_signal(F.col("role"), F.col("content"))).alias("low"))


def prune_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.prune_noise(stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns")).select("row_id")


def embed_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_embed(stored_turns(spark, sf_dir), table(spark, sf_dir, "vec_turns")).select("row_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session lines as transcripts carry them: each turn's session with its stored values, by order of arrival, some without them."""
    t = table(spark, sf_dir, "turns").where("session_id IS NOT NULL").select("row_id", F.col("session_id").alias("id"), "ts")
    s = table(spark, sf_dir, "sessions").select("id", "source_agent", "project", "git_branch", "cwd")
    rows = t.join(s, "id", "left")
    odd = F.col("row_id") % 2 == 1
    return rows.select("id", "row_id", F.coalesce("source_agent", F.lit("codex")).alias("source_agent"), F.when(odd, F.col("project")).alias("project"), F.concat(F.lit("b"), (F.col("row_id") % 7).cast("string")).alias("git_branch"), F.when(odd, F.col("cwd")).alias("cwd"), "ts")


def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "sessions").where(F.length("id") % 2 == 0).where(F.substring("id", 1, 1) < "8")
    return store.upsert_sessions(stored, _lines(spark, sf_dir), "row_id")


def ensure_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "sessions")
    return store.ensure_sessions(stored, table(spark, sf_dir, "turns"), F.lit("codex")).select("id", "source_agent", "project")


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "turns")
    return store.insert_new(t.where("row_id % 2 = 0"), t.where("row_id % 2 = 1"), "row_id").select("row_id", "id")


def self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_turns(spark, sf_dir)
    text = F.concat("content", F.when(F.col("row_id") % 7 == 0, F.lit(" see the prompt-hook")).otherwise(""), F.expr(INJECT))
    return t.select("row_id", F.coalesce(rules.self_referential(text, TOOL), F.lit(False)).alias("about_tool"), F.coalesce(rules.asks_about_memory(text, TOOL), F.lit(False)).alias("about_memory"))


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are what an agent injected, with tags put before some of them."""
    tag = F.when(F.col("row_id") % 5 == 0, "<environment_context>").when(F.col("row_id") % 5 == 1, "  <system-reminder>").when(F.col("row_id") % 5 == 2, "<b>").otherwise("")
    text = F.concat(tag, "content")
    t = stored_turns(spark, sf_dir).where("content IS NOT NULL")
    return t.select("row_id", rules.injected_context(text).alias("context"), rules.strip(text).rlike(rules.INJECTED_PREFIX).alias("prefix"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_turns(spark, sf_dir).where("content IS NOT NULL")
    text = F.concat(F.lit(r"at C:\Users\Dev and C:/Users/Dev: "), "content")
    return t.select(
        "row_id",
        F.md5(rules.clip(F.col("content"), 100, True)).alias("clipped"),
        F.md5(rules.strip(F.col("content"))).alias("stripped"),
        F.md5(rules.spoken(F.col("content"))).alias("spoken"),
        F.md5(rules.neutral_paths(text, r"C:\Users\Dev")).alias("neutral"),
        rules.turn_id("codex", F.coalesce("session_id", F.lit("")), F.coalesce("role", F.lit("")), F.col("ts"), F.col("content")).alias("turn_id"),
        F.replace(F.substring("ts", 1, 16), F.lit("T"), F.lit(" ")).alias("minute"),
    )


def entropy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.functions.redaction import entropy_column

    f = table(spark, sf_dir, "facts").where("content_hash IS NOT NULL AND content_hash <> ''")
    return f.select("row_id", F.round(entropy_column(F.col("content_hash")), 6).alias("bits"), (entropy_column(F.col("content_hash")) > 3.8).alias("high"))


#: Rules without a group are plain replacements that SQL can repeat.
PLAIN = [r for r in RULES if not r.group]


def redact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_turns(spark, sf_dir).where("content IS NOT NULL").select("row_id", "content")
    return redact(t, "content", rules=PLAIN).select("row_id", F.md5("content").alias("text"), (F.size(F.split("content", r"\[REDACTED:")) - 1).cast("long").alias("marks"))


def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored_turns(spark, sf_dir).where("content IS NOT NULL").select("row_id", "content")
    return redact(t, "content", rules=PLAIN).select(F.explode("by_rule").alias("rule", "n")).groupBy("rule").agg(F.sum("n").cast("long").alias("n"))


def redact_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns whose vector must be made anew after stored text was redacted again, with their added-up counts."""
    t = stored_turns(spark, sf_dir)
    turns, work = store.redact_stored(t, table(spark, sf_dir, "vec_turns"))
    return work.join(turns.select("row_id", F.md5("content").alias("text")), "row_id")


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule, those with groups and checks too, on turns: the texts that change, and how many marks they have then."""
    t = stored_turns(spark, sf_dir).select("row_id", "content")
    marks = (F.size(F.split("content", r"\[REDACTED:")) - 1).cast("long")
    return redact(t, "content").where("redactions > 0").select("row_id", F.md5("content").alias("text"), marks.alias("marks"))


#: The rules with a group, as SQL has them: what stands before the group, the group, and what stands behind it.
GROUPED = {
    "aws-secret-key": (r"((?:aws|amazon)[\w\s]{0,20}?(?:secret|sk)[\w\s]{0,20}?['\"])([0-9A-Za-z/+=]{40})(['\"])", "gi"),
    "connection-string": (r"(\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)s?://[^\s:@'\"]{1,64}:)([^\s'\"]{4,})(@)", "g"),
}


def _all_rules() -> str:
    """CTEs that apply each rule to the result of the one before; the last is named done, with the original as o."""
    steps, last = ["r0 AS (SELECT row_id, content AS o, content AS c FROM t WHERE content IS NOT NULL)"], "r0"
    for i, r in enumerate(RULES, 1):
        mark = f"[REDACTED:{r.id}]"
        quote = lambda p: p.replace("'", "''")
        if r.id in GROUPED:
            pattern, flags = GROUPED[r.id]
            new = rf"regexp_replace(c, '{quote(pattern)}', '\1{mark}\3', '{flags}')"
        elif r.checked:
            # Each match beside its value, folded into the text one after the other.
            found = f"list_transform(list_zip(regexp_extract_all(c, '{quote(r.pattern)}', 0, 'i'), regexp_extract_all(c, '{quote(r.pattern)}', 1, 'i')), lambda x: x[1] || chr(1) || x[2])"
            value, match = "split_part(x, chr(1), 2)", "split_part(x, chr(1), 1)"
            bits = f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda ch: -((length({value}) - length(replace({value}, ch, ''))) / length({value})::DOUBLE) * log2((length({value}) - length(replace({value}, ch, ''))) / length({value})::DOUBLE)))"
            none = " AND ".join(f"NOT regexp_matches({value}, '{quote(p.pattern)}', '{'i' if p.flags & re.I else 'c'}')" for p in NO_SECRET)
            good = f"list_filter({found}, lambda x: {none} AND {bits} > {MIN_ENTROPY})"
            new = f"list_reduce({good}, lambda acc, x: replace(acc, {match}, replace({match}, {value}, '{mark}')), c)"
        else:
            new = f"regexp_replace(c, '{quote(r.pattern)}', '{mark}', 'g')"
        steps.append(f"r{i} AS (SELECT row_id, o, {new} AS c FROM {last})")
        last = f"r{i}"
    return ", ".join([*steps, f"done AS (SELECT row_id, o, c FROM {last})"])


def _nested() -> str:
    text = "content"
    for r in PLAIN:
        text = f"regexp_replace({text}, '{r.pattern}', '[REDACTED:{r.id}]', 'g')"
    return text


def _counts() -> str:
    parts, text = [], "content"
    for r in PLAIN:
        parts.append(f"SELECT '{r.id}' AS rule, sum(len(regexp_extract_all({text}, '{r.pattern}')))::BIGINT AS n FROM t WHERE content IS NOT NULL")
    return " UNION ALL ".join(parts)


_BASE = r"list_last(string_split_regex(regexp_replace(cwd, '[\\/]+$', ''), '[\\/]'))"
_NORM = r"lower(regexp_replace(regexp_replace(cwd, '[\\/]+', '/', 'g'), '/+$', ''))"
_LABEL = (
    "CASE WHEN cwd IS NULL OR cwd = '' THEN NULL "
    + " ".join(f"WHEN {_NORM} = '{r}' OR starts_with({_NORM}, '{r}/') THEN '{label}'" for r, label in sorted(ROOTS, key=lambda x: -len(x[0])))
    + f" ELSE nullif({_BASE}, '') END"
)
_JUNK = "(" + " OR ".join(f"contains(lower(coalesce(cwd, '')), '{p.lower()}')" for p in PRUNE) + ")"
_REPROJECT = f"rp AS (SELECT id, project AS \"from\", {_LABEL} AS \"to\", CASE WHEN {_JUNK} THEN 'prune' WHEN {_LABEL} IS DISTINCT FROM project THEN 'relabel' ELSE 'keep' END AS action FROM sessions)"
_STRIP = rf"regexp_replace(content, '^{SPACE}+|{SPACE}+$', '', 'g')"
_LOW = rf"(CASE WHEN role = 'user' THEN length({_STRIP}) < {P.LOW_USER} ELSE length({_STRIP}) < {P.LOW_OTHER} OR (length({_STRIP}) < {P.LOW_NARRATION} AND regexp_matches({_STRIP}, '(?i)^(perfect|great|good|done|fixed|updated|sure|ok(ay)?|yes[.,! \t\n]|now let me|let me|i''?ll|i will|i''?m going to|first,? i|next,? i)\b')) END)"
_TOOL = f"content || CASE WHEN row_id % 7 = 0 THEN ' see the prompt-hook' ELSE '' END || {INJECT}"

QUERIES = {
    "derive_project": derive_project,
    "reproject": reproject,
    "prune_sessions": prune_sessions,
    "low_signal": low_signal,
    "prune_noise": prune_noise,
    "embed_worklist": embed_worklist,
    "session_upsert": session_upsert,
    "ensure_session": ensure_session,
    "insert_or_ignore": insert_or_ignore,
    "self_reference": self_reference,
    "injected": injected,
    "text_functions": text_functions,
    "entropy_gate": entropy_gate,
    "redact_rules": redact_rules,
    "redact_counts": redact_counts,
    "redact_all": redact_all,
    "redact_backfill": redact_backfill,
}
SQL = {
    "derive_project": f"SELECT id, cwd, {_LABEL} AS label FROM sessions",
    "reproject": f'WITH {_REPROJECT} SELECT action, "from", "to", count(*) AS n FROM rp WHERE action <> \'keep\' GROUP BY 1, 2, 3',
    "prune_sessions": f"""WITH {_REPROJECT}, {TURNS_SQL}, g AS (SELECT id FROM rp WHERE action = 'prune'), dead AS (SELECT row_id FROM t WHERE session_id IN (SELECT id FROM g))
SELECT 'sessions' AS kind, count(*) AS n FROM sessions WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'turns', count(*) FROM t WHERE session_id IS NULL OR session_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'vectors', count(*) FROM vec_turns WHERE row_id NOT IN (SELECT row_id FROM dead)""",
    "low_signal": f"WITH {TURNS_SQL} SELECT role, count(*) AS n, count_if({_LOW})::BIGINT AS low FROM t GROUP BY 1",
    "prune_noise": f"WITH {TURNS_SQL} SELECT row_id FROM vec_turns WHERE row_id NOT IN (SELECT row_id FROM t WHERE {_LOW})",
    "embed_worklist": f"WITH {TURNS_SQL} SELECT row_id FROM t WHERE NOT {_LOW} AND row_id NOT IN (SELECT row_id FROM vec_turns)",
    "session_upsert": """WITH st AS (SELECT * FROM sessions WHERE length(id) % 2 = 0 AND substring(id, 1, 1) < '8'),
l AS (SELECT x.session_id AS id, x.row_id, coalesce(s.source_agent, 'codex') AS source_agent, CASE WHEN x.row_id % 2 = 1 THEN s.project END AS project, 'b' || (x.row_id % 7) AS git_branch, CASE WHEN x.row_id % 2 = 1 THEN s.cwd END AS cwd, x.ts
  FROM turns x LEFT JOIN sessions s ON s.id = x.session_id WHERE x.session_id IS NOT NULL), n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)
SELECT coalesce(st.id, n.id) AS id, coalesce(st.source_agent, n.source_agent) AS source_agent, coalesce(n.project, st.project) AS project, coalesce(n.git_branch, st.git_branch) AS git_branch, coalesce(n.cwd, st.cwd) AS cwd,
  CASE WHEN st.source_agent IS NULL THEN n.ts ELSE st.started_at END AS started_at, coalesce(n.ts, st.last_seen_at) AS last_seen_at, st.title FROM st FULL OUTER JOIN n ON st.id = n.id""",
    "ensure_session": "SELECT id, source_agent, project FROM sessions UNION ALL SELECT DISTINCT session_id, 'codex', NULL FROM turns WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT id FROM sessions)",
    "insert_or_ignore": "SELECT row_id, id FROM turns WHERE row_id % 2 = 1 AND (id IS NULL OR id NOT IN (SELECT id FROM turns WHERE row_id % 2 = 0 AND id IS NOT NULL)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1",
    "self_reference": f"""WITH {TURNS_SQL}, x AS (SELECT row_id, {_TOOL} AS c FROM t) SELECT row_id, coalesce(regexp_matches(c, '{rules.self_markers(TOOL)}') OR len(regexp_extract_all(c, '(?i)\\b{TOOL}\\b')) >= 3, false) AS about_tool,
coalesce(regexp_matches(c, '(?i){TOOL}|memor(y|ies)|past session|userpromptsubmit|hook'), false) AS about_memory FROM x""",
    "injected": f"""WITH {TURNS_SQL}, x AS (SELECT row_id, CASE row_id % 5 WHEN 0 THEN '<environment_context>' WHEN 1 THEN '  <system-reminder>' WHEN 2 THEN '<b>' ELSE '' END || content AS content FROM t WHERE content IS NOT NULL)
SELECT row_id, regexp_matches(content, '(?i)^<(environment_context|user_instructions|permissions|apps_instructions|ide_|turn_context|collaboration_mode)') OR (length(content) > 6000 AND starts_with(content, '<')) AS context,
regexp_matches({_STRIP}, '^(Base directory for this skill|<command-|<system-reminder|<local-command)') AS prefix FROM x""",
    "text_functions": rf"""WITH {TURNS_SQL} SELECT row_id, md5(CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '…' ELSE content END) AS clipped, md5({_STRIP}) AS stripped,
md5(trim(regexp_replace(regexp_replace(content, '[#*`_>|-]+', ' ', 'g'), '{SPACE}+', ' ', 'g'), ' ')) AS spoken, md5('at ~ and ~: ' || replace(replace(replace(content, 'C:\Users\Dev', '~'), 'C:/Users/Dev', '~'), 'C:\\Users\\Dev', '~')) AS neutral,
'codex:' || coalesce(session_id, '') || ':' || substring(sha1(coalesce(role, '') || chr(10) || coalesce(ts, '') || chr(10) || content), 1, 20) AS turn_id, replace(substring(ts, 1, 16), 'T', ' ') AS minute FROM t WHERE content IS NOT NULL""",
    "entropy_gate": """WITH c AS (SELECT row_id, unnest(string_split(content_hash, '')) AS ch FROM facts WHERE content_hash IS NOT NULL AND content_hash <> ''), n AS (SELECT row_id, ch, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2),
t AS (SELECT row_id, sum(n) AS total FROM n GROUP BY 1), e AS (SELECT n.row_id, -sum(n / total * log2(n / total)) AS bits FROM n JOIN t USING (row_id) GROUP BY 1) SELECT row_id, round(bits, 6) AS bits, bits > 3.8 AS high FROM e""",
    "redact_rules": f"WITH {TURNS_SQL}, x AS (SELECT row_id, {_nested()} AS c FROM t WHERE content IS NOT NULL) SELECT row_id, md5(c) AS text, (len(string_split(c, '[REDACTED:')) - 1)::BIGINT AS marks FROM x",
    "redact_counts": f"WITH {TURNS_SQL}, x AS ({_counts()}) SELECT rule, n FROM x WHERE n > 0",
    "redact_all": f"WITH {TURNS_SQL}, {_all_rules()} SELECT row_id, md5(c) AS text, (len(string_split(c, '[REDACTED:')) - 1)::BIGINT AS marks FROM done WHERE c <> o",
    "redact_backfill": f"WITH {TURNS_SQL}, {_all_rules()} SELECT row_id, md5(c) AS text FROM done WHERE c <> o AND row_id IN (SELECT row_id FROM vec_turns)",
}
