"""Transcript lines of agents as sessions and turns.

Each format is a function from lines (path, offset, line) to rows with path, offset, session_id, session (a struct or
null) and turn (a struct or null). A line that isn't JSON, or isn't what the format knows, gives no row; nothing raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.rules import injected_context, project_of, strip, turn_id

Roots = list[tuple[str, str]]


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    """The text at path, null if something else is there."""
    return F.when(F.schema_of_variant(_part(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _blocks(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str, kind: str | None) -> Column:
    """Content that is text or an array of blocks, as one text: the blocks of a kind, or all that have text, by lines."""
    blocks = F.filter(_blocks(v, path), lambda b: _string(b, "$.text").isNotNull() & (F.lit(True) if kind is None else F.coalesce(_string(b, "$.type") == kind, F.lit(False))))
    joined = F.array_join(F.transform(blocks, lambda b: _string(b, "$.text")), "\n")
    return strip(F.coalesce(_string(v, path), joined))


_SESSION = "struct<id:string,project:string,git_branch:string,cwd:string,ts:string>"
_TURN = "struct<id:string,session_id:string,role:string,content:string,tool_summary:string,ts:string>"


def _rows(lines: DataFrame, session_id: Column, session: Column, turn: Column) -> DataFrame:
    out = lines.select("path", "offset", session_id.alias("session_id"), session.cast(_SESSION).alias("session"), turn.cast(_TURN).alias("turn"))
    return out.where("session_id IS NOT NULL AND (session IS NOT NULL OR turn IS NOT NULL)")


def message_lines(lines: DataFrame, roots: Roots = ()) -> DataFrame:
    """One JSON object a line with sessionId, type, uuid, timestamp, cwd, gitBranch and message.content."""
    v = F.col("__v")
    rows = lines.withColumn("__v", F.try_parse_json(strip(F.col("line")))).where("__v IS NOT NULL")
    sid, ts, cwd, branch = (_string(v, p) for p in ("$.sessionId", "$.timestamp", "$.cwd", "$.gitBranch"))
    sid = F.when(sid != "", sid)
    known = F.coalesce(cwd != "", F.lit(False)) | F.coalesce(branch != "", F.lit(False))
    session = F.when(known, F.struct(sid.alias("id"), project_of(cwd, list(roots)).alias("project"), branch.alias("git_branch"), cwd.alias("cwd"), ts.alias("ts")))
    kind, uid = _string(v, "$.type"), _string(v, "$.uuid")
    text = _texts(v, "$.message.content", "text")
    tools = F.filter(_blocks(v, "$.message.content"), lambda b: (_string(b, "$.type") == "tool_use") & _string(b, "$.name").isNotNull())
    names = F.array_join(F.transform(tools, lambda b: _string(b, "$.name")), ", ")
    turn = F.when(
        kind.isin("user", "assistant") & (uid != "") & (text != ""),
        F.struct(uid.alias("id"), sid.alias("session_id"), kind.alias("role"), F.substring(text, 1, P.CONTENT_CLIP).alias("content"), F.when(names != "", names).alias("tool_summary"), ts.alias("ts")),
    )
    return _rows(rows, sid, session, turn)


#: The session's id is in the name of a rollout file only.
ROLLOUT = r"(?i)rollout-.*-([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$"


def rollout_lines(lines: DataFrame, roots: Roots = ()) -> DataFrame:
    """Lines of {timestamp, type, payload}: session_meta gives the session, messages of the two speakers the turns.

    Files of another name are skipped; so are developer messages, events, reasoning, calls and what the agent injects
    as if the user had written it. A turn's id is made of its whole text, before it is clipped.
    """
    v = F.col("__v")
    sid = F.lower(F.regexp_extract("path", ROLLOUT, 1))
    rows = lines.withColumn("__v", F.try_parse_json(strip(F.col("line")))).where(F.col("__v").isNotNull() & (sid != ""))
    kind, ts, cwd, branch = (_string(v, p) for p in ("$.type", "$.timestamp", "$.payload.cwd", "$.payload.git.branch"))
    when = F.coalesce(_string(v, "$.payload.timestamp"), ts)
    session = F.when(kind == "session_meta", F.struct(sid.alias("id"), project_of(cwd, list(roots)).alias("project"), branch.alias("git_branch"), cwd.alias("cwd"), when.alias("ts")))
    role, text = _string(v, "$.payload.role"), _texts(v, "$.payload.content", None)
    said = (kind == "response_item") & (_string(v, "$.payload.type") == "message") & role.isin("user", "assistant") & (text != "") & ~((role == "user") & injected_context(text))
    turn = F.when(
        said,
        F.struct(turn_id("codex", sid, role, ts, text).alias("id"), sid.alias("session_id"), role.alias("role"), F.substring(text, 1, P.CONTENT_CLIP).alias("content"), F.lit(None).alias("tool_summary"), ts.alias("ts")),
    )
    return _rows(rows, sid, session, turn)


def meetings(notes: DataFrame) -> DataFrame:
    """Meeting notes (id, title, ts, content) as rows like those of lines: one session and one note each; blank ones are skipped."""
    sid = F.concat(F.lit("granola:"), F.col("id"))
    text = strip(F.substring("content", 1, P.CONTENT_CLIP))
    rows = notes.where(F.col("id").isNotNull() & (text != "")).withColumn("__sid", sid)
    session = F.struct(F.col("__sid").alias("id"), F.lit("granola").alias("project"), F.lit(None).alias("git_branch"), F.lit(None).alias("cwd"), F.col("ts").alias("ts"))
    turn = F.struct(F.col("__sid").alias("id"), F.col("__sid").alias("session_id"), F.lit("note").alias("role"), text.alias("content"), F.lit(None).alias("tool_summary"), F.col("ts").alias("ts"))
    return rows.select(F.lit(None).cast("string").alias("path"), F.monotonically_increasing_id().alias("offset"), F.col("__sid").alias("session_id"), session.cast(_SESSION).alias("session"), turn.cast(_TURN).alias("turn"), "title")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """id, title, ts, content of meeting notes in files that hold one JSON array each; notes of another form are left out."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema("id string, title string, ts string, content string").json(path).where("id IS NOT NULL")


@dataclass(frozen=True)
class Adapter:
    """name, the files it reads below a folder, how it parses lines, and whether it is on unless configured."""

    name: str
    glob: str
    parse: Callable[[DataFrame, Roots], DataFrame]
    always: bool = False


ADAPTERS = {a.name: a for a in (Adapter("claude-code", "*.jsonl", message_lines, True), Adapter("codex", "rollout-*.jsonl", rollout_lines))}


def enabled(configured: dict[str, bool], folders: dict[str, bool]) -> list[Adapter]:
    """The adapters to use: what is configured wins, else those that are always on or whose folder exists."""
    return [a for a in ADAPTERS.values() if configured.get(a.name, a.always or folders.get(a.name, False))]


def read_lines(spark: SparkSession, folder: str, glob: str, modified_after: str | None = None) -> DataFrame:
    """path, offset and line of all files below folder; modified_after limits a catch-up.

    offset is the start of the read split that a line is in and its place among the rows that were read with it. Large
    files are read in several splits; offsets of a file compare in the order of its lines, however it was split.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    text = reader.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return text.select("path", F.struct("block", F.monotonically_increasing_id().alias("place")).alias("offset"), "line")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSONL file; a broken line is an error that names it.

    A case needs an id, a query and an expectation. The lines are checked on the cluster, only the first bad one comes
    to the driver.
    """
    schema = "id string, query string, expected_session_ids array<string>, expected_turn_ids array<string>, forbidden_turn_ids array<string>, exclude_session_id string, notes string, source string"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where(strip(F.col("line")) != "")
    rows = rows.select((F.col("n") + 1).alias("n"), F.try_parse_json("line").alias("v"), F.from_json("line", schema).alias("c"))
    size = lambda c: F.coalesce(F.size(f"c.{c}"), F.lit(0))
    wrong = (
        F.when(F.col("v").isNull(), "bad JSON")
        .when(F.coalesce(F.col("c.id"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.col("c.query"), F.lit("")) == "", "no query")
        .when(size("expected_session_ids") + size("expected_turn_ids") <= 0, "no expectation")
    )
    bad = rows.select("n", wrong.alias("wrong")).where("wrong IS NOT NULL").orderBy("n").first()
    if bad:
        raise ValueError(f"line {bad['n']}: {bad['wrong']}")
    return rows.select("c.*")
