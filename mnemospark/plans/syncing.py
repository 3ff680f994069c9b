"""Queries of replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import instant
from mnemospark.operators import replication as R
from mnemospark.plans.base import FACTS_SQL, stored_facts
from mnemospark.storage import table


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL").select(F.col("factid").alias("fact_id"), "version", instant(F.col("updatedat")).alias("updated_at"), "device", "content", "archived")
    return R.newest(w, "fact_id", [F.col("version"), F.col("updated_at"), F.col("device")])


def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners of the feed merged into a local replica: the first operation received of every second fact, edited since."""
    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL")
    first = w.groupBy("factid").agg(F.min_by(F.struct("version", "updatedat", "device", "content"), "seq").alias("r")).where(F.substring("factid", -1, 1) < "8")
    edited = F.substring("factid", -1, 1) < "4"
    local = first.select(
        F.col("factid").alias("fact_id"),
        F.col("r.version").alias("version"),
        instant(F.col("r.updatedat")).alias("updated_at"),
        F.col("r.device").alias("device"),
        F.when(edited, F.concat(F.coalesce("r.content", F.lit("")), F.lit(" (edited)"))).otherwise(F.col("r.content")).alias("content"),
        F.when(edited, F.col("r.version") - 1).otherwise(F.col("r.version")).alias("synced_version"),
    )
    return R.merge(local, _winners(spark, sf_dir))


def pending_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending(stored_facts(spark, sf_dir)).select("row_id", R.op_id(F.lit("here"), F.col("id"), F.col("version")).alias("op_id"), F.when(F.coalesce("archived", F.lit(False)), "fact_archive").otherwise("fact_put").alias("kind"))


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored_facts(spark, sf_dir)
    due = F.coalesce((F.col("shared") > 0) & (F.col("version") > F.col("synced_version")), F.lit(False))
    return f.agg(F.count_if(F.col("shared") > 0).alias("shared"), F.count_if(due).alias("pending"))


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of sessions, a team for each first digit of their ids: linked by the hash of the record before, some broken on purpose."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "sessions").where("id IS NOT NULL").withColumn("team", F.substring("id", 1, 1))
    w = Window.partitionBy("team").orderBy("id")
    rows = s.select("team", F.row_number().over(w).cast("long").alias("n"), "id")
    rows = rows.withColumn("seq", F.when(F.col("n") % 9 == 0, F.col("n") + 1000000).otherwise(F.col("n")))
    rows = rows.withColumn("hash", R.record_hash(F.col("team"), F.col("n"), F.lit("member_add"), F.lit(""), F.col("id")))
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("team").orderBy("seq")), F.lit(R.GENESIS))
    rows = rows.withColumn("prev_hash", F.when(F.col("n") % 7 == 0, F.sha2(before, 256)).otherwise(before))
    return R.chain_links(rows.select("team", "seq", "prev_hash", "hash"))


def membership_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "wire_facts")
    kind = F.when(F.col("op_kind") == "fact_archive", "member_revoke").when(F.col("pinned"), "rotate").otherwise("member_add")
    return R.membership(w.select("seq", kind.alias("kind"), F.col("factid").alias("member")))


def op_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the log after a position, as a client asks for it."""
    return R.ops_since(table(spark, sf_dir, "wire_facts"), 500).select("seq", "op_id", "op_kind")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the operations of the feed stand for them: the last of each pair, those of some facts sent already."""
    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL AND device IS NOT NULL")
    by = w.groupBy(F.col("factid").alias("fact_id"), F.col("device").alias("member")).agg(F.max_by("pinned", "seq").alias("p"), F.max("seq").alias("ts"), (F.count("*") - 1).alias("version"))
    sent = F.when(F.substring("fact_id", -1, 1) < "8", F.col("version")).otherwise(F.col("version") - 1)
    return by.select("fact_id", "member", F.when(F.col("p"), "useful").otherwise("noise").alias("verdict"), "ts", "version", sent.alias("synced_version"))


def pending_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that each member still has to send."""
    rows = _labels(spark, sf_dir)
    one = rows.agg(F.min("member")).first()[0]
    return R.pending_labels(rows, one or "").select("fact_id", "member", "verdict", "version")


def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the first half of the feed after those of the second were received, some of them older on purpose."""
    w = table(spark, sf_dir, "wire_facts").where("factid IS NOT NULL AND device IS NOT NULL")
    cut = (w.agg(F.max("seq")).first()[0] or 0) // 2
    rows = w.select(F.col("factid").alias("fact_id"), F.col("device").alias("member"), F.when(F.col("pinned"), "useful").otherwise("noise").alias("verdict"), F.when(F.col("seq") % 3 == 0, F.col("seq") - cut).otherwise(F.col("seq")).alias("ts"), F.col("version"), "seq")
    old = rows.where(F.col("seq") <= cut).groupBy("fact_id", "member").agg(F.max_by(F.struct("verdict", "ts", "version"), "seq").alias("r")).select("fact_id", "member", "r.*")
    return R.merge_labels(old, rows.where(F.col("seq") > cut).drop("seq"))


_T = "CAST(CASE WHEN regexp_matches({0}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {0} ELSE {0} || 'Z' END AS TIMESTAMPTZ)"
_WIN = f"""r AS (SELECT factid AS fact_id, version, {_T.format('updatedat')} AS updated_at, device, content FROM wire_facts WHERE factid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY factid ORDER BY version DESC, updated_at DESC, device DESC, seq) = 1)"""

QUERIES = {
    "lww_merge": lww_merge,
    "pending_push": pending_push,
    "sync_counts": sync_counts,
    "chain_links": chain_links,
    "membership_fold": membership_fold,
    "op_page": op_page,
    "pending_labels": pending_labels,
    "label_merge": label_merge,
}
SQL = {
    "lww_merge": f"""WITH {_WIN},
l0 AS (SELECT factid AS fact_id, version, {_T.format('updatedat')} AS updated_at, device, content, right(factid, 1) < '4' AS edited FROM wire_facts WHERE factid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY factid ORDER BY seq) = 1),
l AS (SELECT fact_id, version, updated_at, device, CASE WHEN edited THEN coalesce(content, '') || ' (edited)' ELSE content END AS content, CASE WHEN edited THEN version - 1 ELSE version END AS synced_version FROM l0 WHERE right(fact_id, 1) < '8'),
b AS (SELECT coalesce(l.fact_id, r.fact_id) AS fact_id, CASE WHEN r.fact_id IS NULL THEN 'local' WHEN l.fact_id IS NULL THEN 'applied' WHEN NOT coalesce((r.version, r.updated_at, r.device) > (l.version, l.updated_at, l.device), false) THEN 'stale'
   WHEN l.version > l.synced_version AND coalesce(l.content, '') <> coalesce(r.content, '') THEN 'conflict' ELSE 'applied' END AS action, l.version AS lv, r.version AS rv, l.device AS ld, r.device AS rd, l.content AS lc, r.content AS rc FROM l FULL OUTER JOIN r ON l.fact_id = r.fact_id)
SELECT fact_id, action, CASE WHEN action IN ('applied', 'conflict') THEN rv ELSE lv END AS version, CASE WHEN action IN ('applied', 'conflict') THEN rd ELSE ld END AS device, CASE WHEN action IN ('applied', 'conflict') THEN rc ELSE lc END AS content,
  CASE WHEN action = 'conflict' THEN substring('[conflict] ' || lc, 1, 500) END AS copy FROM b""",
    "pending_push": f"WITH {FACTS_SQL} SELECT row_id, 'here:' || id || ':' || version AS op_id, CASE WHEN coalesce(archived, false) THEN 'fact_archive' ELSE 'fact_put' END AS kind FROM f WHERE shared > 0 AND version > synced_version",
    "sync_counts": f"WITH {FACTS_SQL} SELECT count_if(shared > 0)::BIGINT AS shared, count_if(shared > 0 AND version > synced_version)::BIGINT AS pending FROM f",
    "chain_links": f"""WITH a AS (SELECT substring(id, 1, 1) AS team, row_number() OVER (PARTITION BY substring(id, 1, 1) ORDER BY id) AS n, id FROM sessions WHERE id IS NOT NULL),
b AS (SELECT *, CASE WHEN n % 9 = 0 THEN n + 1000000 ELSE n END AS seq, sha256(team || '|rec|' || n || '|member_add||' || id) AS hash FROM a),
c AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY team ORDER BY seq), '{R.GENESIS}') AS before FROM b),
d AS (SELECT *, CASE WHEN n % 7 = 0 THEN sha256(before) ELSE before END AS prev_hash FROM c)
SELECT team, seq, CASE WHEN seq <> coalesce(lag(seq) OVER (PARTITION BY team ORDER BY seq), 0) + 1 THEN 'gap' WHEN prev_hash <> coalesce(lag(hash) OVER (PARTITION BY team ORDER BY seq), '{R.GENESIS}') THEN 'fork' ELSE 'ok' END AS state FROM d""",
    "membership_fold": """WITH k AS (SELECT seq, CASE WHEN op_kind = 'fact_archive' THEN 'member_revoke' WHEN pinned THEN 'rotate' ELSE 'member_add' END AS kind, factid AS member FROM wire_facts)
SELECT member, CASE WHEN arg_max(kind, seq) = 'member_revoke' THEN 'revoked' ELSE 'active' END AS status, min(seq) AS since FROM k WHERE kind <> 'rotate' AND member IS NOT NULL GROUP BY 1""",
    "op_page": "SELECT seq, op_id, op_kind FROM wire_facts WHERE seq > 500 ORDER BY seq, op_id LIMIT 500",
    "pending_labels": """WITH l AS (SELECT factid AS fact_id, device AS member, arg_max(pinned, seq) AS p, count(*) - 1 AS version FROM wire_facts WHERE factid IS NOT NULL AND device IS NOT NULL GROUP BY 1, 2)
SELECT fact_id, member, CASE WHEN p THEN 'useful' ELSE 'noise' END AS verdict, version FROM l WHERE member = (SELECT min(device) FROM wire_facts WHERE factid IS NOT NULL) AND version > CASE WHEN right(fact_id, 1) < '8' THEN version ELSE version - 1 END""",
    "label_merge": """WITH c AS (SELECT max(seq) // 2 AS cut FROM wire_facts WHERE factid IS NOT NULL AND device IS NOT NULL),
r AS (SELECT factid AS fact_id, device AS member, CASE WHEN pinned THEN 'useful' ELSE 'noise' END AS verdict, CASE WHEN seq % 3 = 0 THEN seq - cut ELSE seq END AS ts, version, seq, seq > cut AS late FROM wire_facts, c WHERE factid IS NOT NULL AND device IS NOT NULL),
o AS (SELECT * FROM r WHERE NOT late QUALIFY row_number() OVER (PARTITION BY fact_id, member ORDER BY seq DESC) = 1), n AS (SELECT * FROM r WHERE late QUALIFY row_number() OVER (PARTITION BY fact_id, member ORDER BY ts DESC, version DESC, verdict DESC) = 1)
SELECT coalesce(o.fact_id, n.fact_id) AS fact_id, coalesce(o.member, n.member) AS member, CASE WHEN o.fact_id IS NULL OR n.ts > o.ts THEN n.verdict ELSE o.verdict END AS verdict, CASE WHEN o.fact_id IS NULL OR n.ts > o.ts THEN n.ts ELSE o.ts END AS ts, CASE WHEN o.fact_id IS NULL OR n.ts > o.ts THEN n.version ELSE o.version END AS version
FROM o FULL OUTER JOIN n ON o.fact_id = n.fact_id AND o.member = n.member""",
}
