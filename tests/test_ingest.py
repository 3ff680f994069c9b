import json
import os

from mnemospark.sources.tail import TailReader, complete_until
from mnemospark.sources.transcripts import enabled, meetings, message_lines, read_cases, rollout_lines
from mnemospark.streaming.ingest import Store, ingest, watch

UUID = "0AA11111-2222-3333-4444-555555555555"


def lines(spark, rows, path="/x/a.jsonl"):
    return spark.createDataFrame([(path, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "path string, offset long, line string")


MESSAGES = [
    {"sessionId": "s1", "type": "user", "uuid": "u1", "timestamp": "2025-01-01T00:00:00Z", "cwd": "C:\\dev\\proj", "gitBranch": "main", "message": {"content": "  please explain the failing build to me  "}},
    {"sessionId": "s1", "type": "assistant", "uuid": "a1", "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "Read"}, {"type": "text", "text": "two"}, {"type": "tool_use", "name": "Edit"}]}},
    {"sessionId": "s1", "type": "assistant", "uuid": "a2", "message": {"content": [{"type": "tool_use", "name": "Read"}]}},
    {"sessionId": 7, "type": "user", "uuid": "u2", "message": {"content": "x"}},
    {"type": "user", "uuid": "u3", "message": {"content": "x"}},
    "not json",
    "",
    {"sessionId": "s2", "type": "summary", "cwd": "/home/x/other"},
]


def test_message_lines(spark):
    got = message_lines(lines(spark, MESSAGES), [("c:/dev", "root")]).orderBy("offset").collect()
    assert [r.offset for r in got] == [0, 1, 7]
    assert got[0].session.project == "root" and got[0].turn.content == "please explain the failing build to me"
    assert (got[1].turn.content, got[1].turn.tool_summary, got[1].session) == ("one\ntwo", "Read, Edit", None)
    assert (got[2].session.project, got[2].turn) == ("other", None)


def test_rollout_lines(spark):
    rows = [
        {"timestamp": "t0", "type": "session_meta", "payload": {"cwd": "/w/p", "git": {"branch": "b"}, "timestamp": "t00"}},
        {"timestamp": "t1", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context>x"}]}},
        {"timestamp": "t2", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}]}},
        {"timestamp": "t3", "type": "response_item", "payload": {"type": "message", "role": "developer", "content": "no"}},
        {"timestamp": "t4", "type": "event_msg", "payload": {"type": "user_message", "message": "hello"}},
        {"timestamp": "t5", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": "hi"}},
    ]
    got = rollout_lines(lines(spark, rows, f"/x/rollout-2025-{UUID}.jsonl")).orderBy("offset").collect()
    assert [r.offset for r in got] == [0, 2, 5] and got[0].session.ts == "t00" and got[0].session_id == UUID.lower()
    assert got[1].turn.id.startswith(f"codex:{UUID.lower()}:") and len(got[1].turn.id.rsplit(":", 1)[1]) == 20
    assert rollout_lines(lines(spark, rows, "/x/other.jsonl")).count() == 0


def test_meetings_and_registry(spark):
    notes = spark.createDataFrame([("m1", "T", "t", " text "), ("m2", None, None, "  "), (None, None, None, "x")], "id string, title string, ts string, content string")
    got = meetings(notes).collect()
    assert len(got) == 1 and got[0].turn.role == "note" and got[0].turn.id == "granola:m1"
    assert [a.name for a in enabled({}, {})] == ["claude-code"]
    assert [a.name for a in enabled({"claude-code": False}, {"codex": True})] == ["codex"]


def test_tail_reads_growth_once(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\npart")
    reader = TailReader(str(tmp_path), "*.jsonl")
    first = reader.latestOffset()
    read = lambda a, b: [x[2] for p in reader.partitions(a, b) for x in reader.read(p)]
    assert read({}, first) == ["one", "two"]
    f.write_bytes(b"one\ntwo\npartial\nmore\n")
    second = reader.latestOffset()
    assert read(first, second) == ["partial", "more"] and read(second, second) == []
    f.write_bytes(b"new\n")
    assert read(second, reader.latestOffset()) == ["new"]
    f.write_bytes(b"x" * 200_000)
    assert complete_until(str(f)) == 0


def test_stream_into_store(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    os.makedirs(folder)
    log = folder / "s.jsonl"
    log.write_text("".join(json.dumps(m) + "\n" for m in MESSAGES[:2]))
    go = lambda: watch(spark, str(folder), store, f"file://{tmp_path}/cp").awaitTermination()
    go()
    assert store.read("turns").count() == 2 and store.read("vectors").count() == 1  # the short answer isn't embedded
    secret = "np" + "m_" + "a1B2" * 9
    with log.open("a") as f:
        f.write(json.dumps({"sessionId": "s1", "type": "user", "uuid": "u9", "message": {"content": f"the key is {secret} and it leaks"}}) + "\n")
        f.write(json.dumps(MESSAGES[0]) + "\n")  # repeated: ignored
    go()
    turns = store.read("turns").orderBy("row_id").collect()
    assert [t.id for t in turns] == ["u1", "a1", "u9"] and secret not in turns[2].content and turns[2].redaction_count == 1
    s = store.read("sessions").collect()
    assert len(s) == 1 and s[0].source_agent == "claude-code" and s[0].git_branch == "main"
    assert ingest(store, message_lines(lines(spark, MESSAGES)), "claude-code", 0) == {"turns": 0, "embedded": 0}  # an old batch again


def test_cases_reader(spark, tmp_path):
    good = {"id": "a", "query": "q", "expected_turn_ids": ["t"]}
    (tmp_path / "ok.jsonl").write_text(json.dumps(good) + "\n\n")
    assert read_cases(spark, f"file://{tmp_path}/ok.jsonl").count() == 1
    for bad, why in [("{", "bad JSON"), ({"query": "q", "expected_turn_ids": ["t"]}, "no id"), ({"id": "a", "expected_turn_ids": ["t"]}, "no query"), ({"id": "a", "query": "q"}, "no expectation")]:
        (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n" + (bad if isinstance(bad, str) else json.dumps(bad)) + "\n")
        try:
            read_cases(spark, f"file://{tmp_path}/bad.jsonl")
        except ValueError as e:
            assert str(e) == f"line 2: {why}"
        else:
            raise AssertionError(why)


def test_offsets_follow_the_lines_of_files_read_in_many_splits(spark, tmp_path):
    from mnemospark.sources.transcripts import read_lines

    for name, n in [("a", 3000), ("b", 17), ("c", 5000)]:
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{i:05d} {'x' * (i % 50)}\n" for i in range(n)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_lines(spark, str(tmp_path), "*.jsonl").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert len({(r.path, r.offset.block) for r in rows}) > 10
    for name, n in [("a", 3000), ("b", 17), ("c", 5000)]:
        mine = sorted((r.offset, r.line) for r in rows if r.path.endswith(f"/{name}.jsonl"))
        assert [int(line[:5]) for _, line in mine] == list(range(n))


def test_notes_and_files_changed_lately(spark, tmp_path):
    import os
    import time
    from datetime import datetime

    from mnemospark.streaming.ingest import Store, catch_up, ingest_notes

    (tmp_path / "notes.json").write_text(json.dumps([{"id": "m1", "title": "Plan", "ts": "2025-01-01", "content": " we decided to split the queue in two and to keep the older one for a week "}, {"id": "m2", "content": "  "}, {"title": "no id", "content": "x"}], indent=1))
    notes = Store(spark, f"file://{tmp_path}/a")
    assert ingest_notes(notes, str(tmp_path / "notes.json"))["turns"] == 1
    assert [(r.id, r.title) for r in notes.read("sessions").collect()] == [("granola:m1", "Plan")] and notes.read("turns").first()["role"] == "note"
    assert ingest_notes(notes, str(tmp_path / "notes.json"))["turns"] == 0
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, age in [("new", 1), ("old", 9)]:
        path = logs / f"{name}.jsonl"
        path.write_text(json.dumps({"sessionId": name, "type": "user", "uuid": name, "message": {"content": "hello there, can you look at this?"}, "timestamp": "2025-01-01T00:00:00Z"}) + "\n")
        at = time.time() - age * 86400
        os.utime(path, (at, at))
    live = Store(spark, f"file://{tmp_path}/b")
    assert catch_up(spark, str(logs), live, datetime.fromtimestamp(time.time()))["turns"] == 1
    assert [r.id for r in live.read("turns").collect()] == ["new"]
