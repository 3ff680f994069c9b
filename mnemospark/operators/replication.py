"""Replicated logs of facts: merging by last writer, pending operations, sealing, hash chains, membership."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.rules import neutral_paths


def newest(ops: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The winning operation of each key: the greatest in order; equal ones are the same operation delivered again."""
    row = F.struct(*(F.col(c) for c in ops.columns))
    return ops.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """fact_id and action of merging remote winners into local facts.

    local and remote have fact_id, version, updated_at (an instant), device, content; local also synced_version. The
    stamp (version, time, device) decides, an exact tie keeps local: stale. applied overwrites or inserts; conflict is
    applied where local has edits that were never synced and another content, which are kept as a copy.
    """
    l, r = local.alias("l"), remote.alias("r")
    both = l.join(r, F.col("l.fact_id") == F.col("r.fact_id"), "full_outer")
    stamp = lambda x: F.struct(F.col(f"{x}.version"), F.col(f"{x}.updated_at"), F.col(f"{x}.device"))
    wins = stamp("r") > stamp("l")
    edited = (F.col("l.version") > F.col("l.synced_version")) & (F.coalesce("l.content", F.lit("")) != F.coalesce("r.content", F.lit("")))
    action = (
        F.when(F.col("r.fact_id").isNull(), "local")
        .when(F.col("l.fact_id").isNull(), "applied")
        .when(~F.coalesce(wins, F.lit(False)), "stale")
        .when(F.coalesce(edited, F.lit(False)), "conflict")
        .otherwise("applied")
    )
    taken = action.isin("applied", "conflict")
    return both.select(
        F.coalesce("l.fact_id", "r.fact_id").alias("fact_id"),
        action.alias("action"),
        *(F.when(taken, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in ("version", "device", "content")),
        F.when(action == "conflict", F.substring(F.concat(F.lit("[conflict] "), F.col("l.content")), 1, 500)).alias("copy"),
    )


def pending(facts: DataFrame) -> DataFrame:
    """Facts that are shared and have a version that wasn't sent."""
    return facts.where((F.col("shared") > 0) & (F.col("version") > F.col("synced_version")))


def outgoing(facts: DataFrame, device: str, home: str, gate: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(ops, blocked) of pending facts: op_id, kind, wire (JSON); a fact whose content fails the gate isn't sent.

    gate is true where content holds a credential; facts with shared = 2 pass anyway.
    """
    rows = pending(facts).withColumn("content", neutral_paths(F.col("content"), home))
    bad = F.coalesce(gate, F.lit(False)) & (F.col("shared") != 2) if gate is not None else F.lit(False)
    wire = F.to_json(
        F.struct(
            F.col("id").alias("factId"), F.col("kind").alias("factKind"), "content", "project", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"), "pinned", "archived", "version", F.lit(device).alias("device")
        ),
        {"ignoreNullFields": "false"},
    )
    kind = F.when(F.coalesce("archived", F.lit(False)), "fact_archive").otherwise("fact_put")
    ops = rows.where(~bad).select(op_id(F.lit(device), F.col("id"), F.col("version")).alias("op_id"), kind.alias("kind"), wire.alias("wire"))
    return ops, rows.where(bad).select("id")


def op_id(device: Column, fact: Column, version: Column) -> Column:
    return F.concat(device, F.lit(":"), fact, F.lit(":"), version.cast("string"))


def seal(text: Column, key: Column, team: Column, op: Column, nonce: Column | None = None) -> Column:
    """AES-256-GCM of text, bound to team and operation: 12 bytes of nonce, the ciphertext, 16 bytes of tag."""
    aad = F.concat(team, F.lit("|"), op)
    return F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), nonce if nonce is not None else F.lit("").cast("binary"), aad)


def unseal(blob: Column, key: Column, team: Column, op: Column) -> Column:
    """The text of a sealed operation, null if key, team or operation aren't the ones it was sealed with."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(team, F.lit("|"), op)).cast("string")


def hkdf(secret: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    key, out, block = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest(), b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def canonical(body: dict) -> str:
    """A flat object as JSON with its keys in order and no spaces."""
    return json.dumps({k: body[k] for k in sorted(body)}, separators=(",", ":"), ensure_ascii=False)


def record_hash(team: Column, seq: Column, kind: Column, prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", team, F.lit("rec"), seq.cast("string"), kind, prev, body), 256)


GENESIS = "0" * 64


def chain_links(records: DataFrame, head: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """seq and state (ok, gap or fork) of records (team, seq, prev_hash, hash) after a known head.

    A chain is one sequence, and its records are few: they are changes of membership.
    """
    w = Window.partitionBy("team").orderBy("seq")
    before, expected = F.coalesce(F.lag("seq").over(w), F.lit(head[0])), F.coalesce(F.lag("hash").over(w), F.lit(head[1]))
    state = F.when(F.col("seq") != before + 1, "gap").when(F.col("prev_hash") != expected, "fork").otherwise("ok")
    return records.select("team", "seq", state.alias("state"))


def membership(records: DataFrame) -> DataFrame:
    """member and status after the records (seq, kind, member): genesis and member_add make active, member_revoke revoked."""
    rows = records.where("kind IN ('genesis', 'member_add', 'member_revoke') AND member IS NOT NULL")
    last = rows.groupBy("member").agg(F.max_by("kind", "seq").alias("kind"), F.min("seq").alias("since"))
    return last.select("member", F.when(F.col("kind") == "member_revoke", "revoked").otherwise("active").alias("status"), "since")


def pending_labels(labels: DataFrame, member: str) -> DataFrame:
    """The member's own labels (fact_id, member, verdict, ts, version, synced_version) with a version that wasn't sent."""
    return labels.where((F.col("member") == member) & (F.col("version") > F.coalesce("synced_version", F.lit(-1))))


def mark_synced(rows: DataFrame, sent: DataFrame, key: str = "id") -> DataFrame:
    """rows with synced_version set to the version that was sent (key, version), unless a later one was sent before."""
    s = sent.groupBy(F.col(key).alias("__key")).agg(F.max("version").alias("__sent"))
    both = rows.join(s, F.col(key) == F.col("__key"), "left")
    synced = F.greatest(F.col("synced_version"), F.col("__sent")).cast(rows.schema["synced_version"].dataType)
    return both.select(*((synced if c == "synced_version" else F.col(c)).alias(c) for c in rows.columns))


def merge_labels(stored: DataFrame, received: DataFrame) -> DataFrame:
    """stored labels (fact_id, member, verdict, ts, version) after received ones: of a pair only a strictly newer one counts."""
    key = ["fact_id", "member"]
    rest = [c for c in stored.columns if c not in key]
    last = received.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ts", "version", "verdict")).alias("r"))
    both = stored.select(*key, F.struct(*rest).alias("s")).join(last, key, "full_outer")
    newer = F.col("s").isNull() | F.coalesce(F.col("r.ts") > F.col("s.ts"), F.lit(False))
    return both.select(*key, F.when(newer, F.col("r")).otherwise(F.col("s")).alias("x")).select(*key, "x.*").select(*stored.columns)


def ops_since(ops: DataFrame, after: int, limit: int = 500) -> DataFrame:
    """One page of a log: the first operations after a position, in order. An empty page ends a pull."""
    return ops.where(F.col("seq") > after).orderBy("seq", "op_id").limit(limit)


def pull(local: DataFrame, ops: DataFrame, device: str, cursor: int) -> tuple[DataFrame, int]:
    """(changes, cursor) of applying operations (seq, fact_id, version, updated_at, device, content) beyond a cursor.

    The device's own operations and those that couldn't be opened (without a fact_id) change nothing, but the cursor
    passes them. changes is merge() with copy, the text kept of an edit that lost, at most P.FACT_CLIP characters.
    """
    fresh = ops.where(F.col("seq") > cursor)
    last = fresh.agg(F.max("seq")).first()[0]
    foreign = fresh.where(F.col("fact_id").isNotNull() & ~F.coalesce(F.col("device") == device, F.lit(False))).drop("seq")
    won = newest(foreign, "fact_id", [F.col("version"), F.col("updated_at"), F.col("device")])
    return merge(local, won), int(cursor if last is None else last)
