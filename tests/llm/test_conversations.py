import random

import pytest
from language_samples import DE, EN, SAMPLES
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import conversations as C
from mnemospark.llm import pairs

TURNS = "row_id long, id string, session_id string, role string, content string, ts string"


def walk(parents):
    out = {}
    for i in parents:
        path, at = [], i
        while at is not None and at in parents and at not in path:
            path.append(at)
            at = parents[at]
        if at is not None and at in path:
            out[i] = (None, None, "cycle")
        else:
            out[i] = (path[-1], len(path) - 1, "ok" if at is None else "orphan")
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 25)), min_size=1, max_size=20))
def test_pointer_jumping_equals_walking(spark, parents):
    nodes = dict(enumerate(parents))
    df = spark.createDataFrame([(i, p, 1) for i, p in nodes.items()], "id long, parent long, weight int")
    got = {r.id: (r.root, r.depth, r.state) for r in C.pointer_jump(df, 8).collect()}
    assert got == walk(nodes)


def test_long_chain_and_threads(spark):
    n = 400
    rows = [(f"m{i}", f"m{i - 1}" if i else None, "keep", "x") for i in range(n)] + [("m5", "m4", "keep", "x"), (None, "m1", "keep", "x"), ("lost", "gone", "keep", "x")]
    df = spark.createDataFrame(rows, "id string, parent_id string, thread string, other string")
    got = C.threads(df).collect()
    by = {r.id: r for r in got}
    assert by["m399"].depth == 399 and by["m399"].thread == "m0" and by["lost"].state == "orphan" and len(got) == len(rows) and by[None].thread is None
    assert C.threads(df.limit(0)).count() == 0


def brute(turns, sessions):
    seen, by = set(), {}
    for r in sorted(turns):
        if r[1] in seen or r[2] is None:
            continue
        seen.add(r[1])
        role = {"user": "user", "Human": "user", "assistant": "assistant", "model": "assistant", "note": "note", "": None, None: None}[r[3]]
        blank = r[4] is None or not any(c.isalnum() for c in r[4]) or r[4] == "null"
        at = r[5] if r[5] and r[5][0] == "2" else None
        by.setdefault(r[2], []).append((role, blank, at, r[0]))
    out = {}
    for s in set(by) | set(sessions):
        rows = by.get(s, [])
        if rows and all(r[0] == "note" for r in rows):
            continue
        out[s] = None
        speak = sorted((r for r in rows if r[0] in ("user", "assistant")), key=lambda r: (r[2] or "", r[3]))
        full = [r for r in speak if not r[1]]
        if not any(not r[1] and (r[0] is None or r[0] in ("user", "assistant")) for r in rows):
            out[s] = "empty"
        elif any(r[0] is None for r in rows) or any(r[2] is None for r in speak) or (full and full[0][0] == "assistant"):
            out[s] = "broken"
        elif "assistant" not in [r[0] for r in full][max(i for i, r in enumerate(full) if r[0] == "user") :]:
            out[s] = "missing_reply"
    return out


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_defects_equal_brute_force(spark, ranges):
    rng = random.Random(ranges)
    turns = []
    for i in range(500):
        s = "hot" if rng.random() < 0.4 else f"s{rng.randrange(60)}"
        role = rng.choice(["user", "Human", "assistant", "model"] * 6 + ["note", "", None])
        ts = f"2025-01-0{rng.randrange(1, 9)}T{rng.randrange(10, 24)}:00:00Z" if rng.random() < 0.97 else rng.choice([None, "", "Invalid Date"])
        turns.append((i, f"t{i}", s if rng.random() < 0.99 else None, role, rng.choice(["hello there", "yes", "", "null", None]) if rng.random() < 0.4 else "text", ts))
    turns += [(1000 + i, t[1], *t[2:]) for i, t in enumerate(turns[:40])]
    df = spark.createDataFrame(turns, TURNS).selectExpr("*", "'x' AS root", "1 AS position", "2 AS head")
    sessions = spark.createDataFrame([("none",), ("hot",), (None,)], "id string")
    ordered, others = C.order_turns(df, ranges)
    got = {r.session_id: r.defect for r in C.session_defects(ordered, others, sessions).collect()}
    assert got == brute(turns, ["none", "hot"])
    places = ordered.where("session_id = 'hot'").orderBy("position").collect()
    assert [p.position for p in places] == list(range(len(places))) and len({p.root for p in places}) == 1
    assert [p.next_row for p in places] == [p.row_id for p in places[1:]] + [None]
    kept = C.conversations(df, sessions)
    assert {r.session_id for r in kept.collect()} <= {s for s, d in got.items() if d is None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    ordered, others = C.order_turns(empty)
    assert C.session_defects(ordered, others).count() == 0 and C.conversations(empty).count() == 0


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I can't help with that request.", "Das darf ich leider nicht ausführen.", "Je dois refuser cette demande.", "Lo siento, pero no puedo ayudarte con eso.", "Lamento, mas não posso ajudar com isso.", "Het spijt me, maar daar kan ik je niet mee helpen.", "Извините, но я не могу с этим помочь.", "Вынужден отклонить этот запрос.", "That falls outside what I am allowed to do, so I will stop here. I must decline."],
)
def test_refusals(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize(
    "text",
    ["We won't need the lock file.", "We can't drop shard_map until build 77.", "I refuse to believe that this lock is needed.", "No puedo reproducirlo aquí.", "Ich kann das nicht reproduzieren.", "Das kann ich nicht bestätigen, der Test läuft grün.", "Je ne peux pas reproduire l'erreur.",
     "Ik kan dat niet reproduceren.", "Не могу воспроизвести ошибку.", "Não consigo reproduzir o erro.", "We could not run the test before the merge.", "No podemos borrar la tabla hasta que pare la cola.", "I can't help with that request, but the queue was full since the last restart."],
)
def test_negations_about_the_matter_are_no_refusals(text):
    assert not pairs.is_refusal(text) and not pairs.is_refusal(text + " ")


@pytest.mark.parametrize(
    "text, lang",
    [("I can't do that for you.", "en"), ("I am unable to assist with this, sorry. Please try another way.", "en"), ("Dabei kann ich dir nicht weiterhelfen.", "de"), ("Je ne peux pas faire cela.", "fr"), ("No puedo hacer eso.", "es"), ("Não posso fazer isso.", "pt"), ("Ik kan je daar niet bij helpen.", "nl"), ("Я не буду выполнять этот запрос.", "ru")],
)
def test_refusals_in_other_words(text, lang):
    assert pairs.is_refusal(text, lang) and pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["Sorry about the confusion; here is what happens. The queue was full.", "I can't reproduce the error locally, but the cause is visible. The lock was never freed.", "The build can't find the file.", "No.", "", "Es tut mir leid für die Verwirrung, so hängt es zusammen."])
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


def test_copies():
    q = "Why does the gate throw an error when the daemon port restarts?"
    assert pairs.is_copy(q, q) and pairs.is_copy(q, "You asked: " + q) and pairs.is_copy(q, "> " + q.replace("daemon", "server"))
    assert not pairs.is_copy(q, q + " Because the lock file is read before the port is free, and nobody waits for it to be written.")
    still = "Does the write path in harbor_reader still depend on the lock file?"
    assert not pairs.is_copy(still, still + " No, only on the cursor.")
    assert not pairs.is_copy(still, "The write path in harbor_reader still depends on the lock file, yes, since build 12.")
    assert not pairs.is_copy("Can I run make harbor:reader twice?", "You can run make harbor:reader twice.")
    assert pairs.is_copy(still, still.upper()) and pairs.is_copy(still, "Your question was: " + still[:-1] + ".")
    assert not pairs.is_copy(q, "The lock file is read too early.") and not pairs.is_copy("", "x")


def test_pair_defects(spark):
    samples = spark.createDataFrame(SAMPLES, "sample_id long, lang string, text string")
    rows, n = [], 0

    def say(session, role, content):
        nonlocal n
        n += 1
        rows.append((n, f"t{n}", session, role, content, f"2025-01-01T10:{n // 60:02d}:{n % 60:02d}Z"))
        return f"t{n}"

    for i in range(40):
        say(f"fill{i}", "user", EN[i % 4])
        say(f"fill{i}", "assistant", EN[(i + 1) % 4])
    want = set()
    for k, (answer, defect) in enumerate([("", "empty_answer"), (None, "empty_answer"), ("I must decline this request.", "refusal"), (EN[0], "copied_question"), (DE[1] + " " + DE[2], "other_language"), ("See:\n```\nx = [", "truncated_answer"), ("Fine, the value was renamed.", None)]):
        say(f"s{k}", "user", EN[0])
        i = say(f"s{k}", "assistant", answer)
        say(f"s{k}", "tool", "between")
        if defect:
            want.add((i, defect))
    df = spark.createDataFrame(rows + rows[-3:], TURNS).selectExpr("*", "'x' AS answer", "1 AS tbl")
    got = {(r.answer_id, r.defect) for r in pairs.pair_defects(df, samples).collect()}
    assert got == want
    assert pairs.pair_defects(df.limit(0), samples).count() == 0
