import random

from language_samples import SAMPLES

from mnemospark.llm import endings

SENTENCES = ["the queue waits {n} ms before the next step is touched again", "we decided to keep gate_{n} because the older path lost {n} rows", "nobody has touched lib/x_{n}.py since the build was changed", "it took {n} seconds to rebuild the index from scratch", "please note that the value was renamed in revision {n}"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(SENTENCES).format(n=rng.randrange(9999)).capitalize() + "." for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_signs_and_blocks():
    for text, want in [("a b… (message clipped)", ("a b", 3)), ("so it goes [...]", ("so it goes", 3)), ("wait...", ("wait", 1)), ("predic…", ("predic", 2)), ("x\n<output cut, 12 chars omitted>", ("x", 3)), ("done.", ("done.", 0)), ("", ("", 0))]:
        assert endings.strip_sign(text) == want, text
    assert endings.inside_block("a\n```py\nx = 1") and not endings.inside_block("a\n```py\nx = 1\n```") and not endings.inside_block("a\n```")
    assert endings.inside_block("-----BEGIN PUBLIC KEY-----\nabc") and not endings.inside_block("-----BEGIN X-----\nabc\n-----END X-----")
    for text in ("Done. ✅", "all good!", "```\ncode\n```", "- key: 12", 'sha = "abc"', "    indented code", "![x](data:y)"):
        assert endings.question(text)[1] is False, text


def test_held_out_accuracy():
    texts = corpus(1500)
    model = endings.fit(texts[:1200])
    held = texts[1200:]
    model.thresholds = endings.thresholds(endings.case_scores(held, ["turns"] * len(held), ["en"] * len(held), model))
    assert ("en", "turns") in model.thresholds
    rng = random.Random(3)
    whole = [t.rstrip(".") for t in corpus(200, 9)]
    cut = []
    for t in corpus(200, 11):
        at = rng.randrange(10, len(t) - 2)
        while t[at - 1] in ". 0123456789_" or t[at] in ".0123456789_" or t[at - 4 : at].endswith(("again", "rows")):
            at -= 1
        cut.append(t[:at])
    limit = model.thresholds[("", "")]
    odds = lambda ts: model.log_odds([endings._TAIL.sub("", endings.symbols(t)) for t in ts])
    assert (odds(whole) >= limit).mean() >= 0.9 and (odds(cut) < limit).mean() >= 0.9


def test_counts_are_the_same_however_the_texts_are_divided(spark):
    texts = corpus(300, 4) + ["", "é" * 70, "a `b c` d\n```\nx\n```\nso it goes on", "\ud800 odd."]
    whole = endings.fit(texts)
    df = spark.createDataFrame([(t, 1 / 3) for t in texts if "\ud800" not in t] * 3, "content string, weight double").repartition(5)
    far = endings.count_contexts(df, whole.vocabulary)
    near = endings.EndCounts(whole.vocabulary)
    near.add([t for t in texts if "\ud800" not in t])
    near = near.model()
    assert far.prior == near.prior and all((a[k] == b[k]).all() for a, b in zip(far.tables, near.tables, strict=True) for k in range(3))
    empty = endings.count_contexts(df.limit(0), set())
    assert empty.prior == 0.5 and len(empty.log_odds(["x"])) == 1


def test_contexts_by_hand():
    counts = endings.EndCounts({"go", "on"})
    counts.add(["go on. go on"])
    counts.count()
    bucket = lambda c: endings._bucket(endings._hash_tails([c], len(c)))[0]
    i = endings.ORDERS.index(2)
    assert (counts.total[i][bucket("on")], counts.ends[i][bucket("on")]) == (2, 3)  # one sentence, one text without a mark
    assert counts.ends[i][bucket("go")] == 0 and counts.total[i][bucket("go")] == 2


def test_limits_are_lengths_where_texts_pile_up(spark):
    rows = [("facts", f"i{k}", f"{k:03d}" * (40 + k % 50)) for k in range(400)] + [("facts", f"l{k}", f"{k:02d}" * 250) for k in range(30)] + [("facts", f"c{k}", "copy" * 99) for k in range(50)] + [("turns", f"t{k}", "z" * 500) for k in range(5)] + [("turns", "n", None)]
    assert endings.limits(endings.contents(spark.createDataFrame(rows, "tbl string, id string, content string"))) == {("facts", 500)}


def test_frame(spark):
    samples = spark.createDataFrame([(i, lang, t) for i, lang, t in SAMPLES], "sample_id long, lang string, text string")
    texts = corpus(400)
    rows = [("turns", f"t{i}", t, "a") for i, t in enumerate(texts)]
    rows += [("turns", "cut", texts[0][:-9] + " and the ol", "a"), ("turns", "cut", texts[0][:-9] + " and the ol", "a"), ("facts", "block", "see\n```\nx = [1,", None), ("turns", "blank", " ", "a"), ("turns", "none", None, "a"), ("turns", "empty", "", "a"), ("facts", "long", "x " * 50_000 + "end.", "b")]
    df = spark.createDataFrame(rows, "tbl string, id string, content string, source string").selectExpr("*", "1 AS cut")
    got = endings.find_cut(df, samples, ("source",)).collect()
    by = {r.id: r.cut for r in got}
    assert by["cut"] and by["block"] and not by["long"] and {"blank", "none", "empty"}.isdisjoint(by)
    assert sum(by[f"t{i}"] for i in range(400)) == 0 and sum(r.id == "cut" for r in got) == 2
    assert endings.find_cut(df.limit(0), samples).count() == 0
