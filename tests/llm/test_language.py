from collections import Counter

import numpy as np
import pytest
from language_samples import DE, EN, RU, SAMPLES
from pyspark.sql import functions as F

from mnemospark.llm import charlm, endings, language
from mnemospark.llm.prose import SentenceWords, prose_words, sentences


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES + [(9, None, "x"), (10, "en", None)], "sample_id long, lang string, text string")


def test_probabilities_add_up():
    model = charlm.train_calibrated([(lang, t) for _, lang, t in SAMPLES])
    # Every character of the alphabet after a context, and the end: with the uniform base they add up to at most 1.
    words = [f"{c}" for c in "abcdefghijklmnopqrstuvwxyzäöüß"]
    first = charlm.np.exp(model.score(words)).sum(0)
    assert (first <= 1 + 1e-6).all() and (first > 0).all()


def test_sentences_leave_out_code_and_quotes():
    text = "# Head line\nThe first one. And `some code` here!\n```\nnot this one.\n```\n    log line here.\n- A list item with \"eine Phrase auf Deutsch\" ends."
    got = [(s, c) for _, _, s, c in sentences(text)]
    assert [c for _, c in got] == [True, True, True] and "code" not in got[1][0] and "Phrase" not in got[2][0]
    assert all(text[a:b].startswith(s[0]) for a, b, s, _ in sentences(text))
    assert prose_words("Both gate_1 and FooBar see x/y.z, the list's 12 ends.") == ["both", "and", "see", "the", "list's", "ends"]


def test_labels(spark, samples):
    mixed = f"{EN[0]} {EN[1]}\n\n{DE[0]} {DE[1]}"
    docs = [
        (1, EN[0], "en"), (2, DE[0], "de-AT"), (3, DE[1], "German"), (4, DE[2], "en"), (5, EN[2], None), (6, RU[0], "und"), (7, mixed, "en"), (8, "", "en"), (9, None, None), (10, "```\ncode only\n```", "xx"), (11, EN[3] * 300, "EN"), (11, EN[3] * 300, "EN"),
    ]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, found_lang string, __h int")
    rows = language.label_languages(df, samples).collect()
    state = {r.doc_id: r.label_state for r in rows}
    assert state == {1: "right", 2: "right", 3: "right", 4: "wrong", 5: "missing", 6: "unusable", 7: "mixed", 8: "unchecked", 9: "missing", 10: "unusable", 11: "right"}
    by = {r.doc_id: r for r in rows}
    assert by[7].found_langs == ["de", "en"] and [s.lang for s in by[7].found_segments] == ["en", "de"]
    assert mixed[by[7].found_segments[1].start :].startswith("Die") and all(0 <= s.confidence <= 1 for s in by[7].found_segments)
    assert (by[8].found_lang, by[8].found_langs) == (None, []) and by[6].found_lang == "ru" and len(rows) == 12
    assert language.label_languages(df.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        language.label_languages(df, samples.limit(0))


def test_held_out_accuracy():
    right = total = 0
    for k in range(4):
        part = [(lang, t) for i, lang, t in SAMPLES if i != k]
        model = charlm.train_calibrated(part)
        for i, lang, t in SAMPLES:
            if i == k:
                ws = [w for _, _, s, _ in sentences(t) for w in prose_words(s)]
                right += model.languages[charlm.cross_entropy(model, ws).argmin()] == lang
                total += 1
    assert right / total >= 0.9


def test_label_names():
    for raw, want in [("EN", "en"), ("en_US", "en"), (" pt-BR ", "pt"), ("Français", "fr"), ("mul", None), ("", None), (None, None), ("und", None)]:
        assert language.label_code(raw) == want


def test_bounded_sample_is_bounded(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("x"))
    got = language._bounded(df, ["x"], 50)
    assert len(got) == 50 and got == language._bounded(df.repartition(7), ["x"], 50)


def _name(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "qz"


def _grams(model, words):
    codes, _, predicted = charlm._codes(words, model.order)
    return charlm._keys(codes, model.order)[predicted]


def _same(a, b):
    return a.languages == b.languages and all(np.array_equal(x, y) for p, q in zip(a.grams + a.histories, b.grams + b.histories, strict=True) for x, y in zip(p, q, strict=True))


def test_every_text_of_the_corpus_adapts_the_models(spark, samples, monkeypatch):
    names = [_name(7 * i) for i in range(3500)]
    corpus = spark.createDataFrame([(f"{EN[i % 4]} The {w} came back.",) for i, w in enumerate(names)] + [(None,), ("",)], "text string")
    model = language.train(samples, corpus.repartition(3))
    assert np.isin(_grams(model, names), model.grams[-1][0]).all()
    assert not np.isin(_grams(model, ["xkcdvw"]), model.grams[-1][0]).all()
    monkeypatch.setattr(charlm.LanguageVotes, "LIMIT", 50)
    monkeypatch.setattr(charlm.LanguageVotes, "TOKENS", 100)
    monkeypatch.setattr(charlm, "WORDS_AT_ONCE", 91)
    assert _same(model, language.train(samples, corpus.repartition(7)))


def test_every_text_adapts_the_models_of_cuts_and_pairs(spark, samples):
    names = [_name(11 * i) for i in range(3300)]
    rows = [("turns", str(i), f"{EN[i % 4]} The {w} came back.") for i, w in enumerate(names)]
    _, languages = endings.train(spark.createDataFrame(rows, "tbl string, id string, content string").repartition(5), samples)
    assert np.isin(_grams(languages, names), languages.grams[-1][0]).all()


def test_words_are_counted_beside_the_languages(spark, samples):
    rows = [(lang, t) for _, lang, t in SAMPLES]
    corpus = spark.createDataFrame([(t,) for t in [EN[0]] * 3 + [DE[0], "```\ncode\n```"]], "content string").repartition(3)
    _, counted = language.adapt(charlm.train_calibrated(rows), rows, corpus, lambda texts: Counter(w for t in texts for w in t.split()), 3)
    assert counted == {w: n for w, n in Counter(w for t in [EN[0]] * 3 + [DE[0], "```\ncode\n```"] for w in t.split()).items() if n >= 3}
    plain = charlm.train_calibrated(rows)
    assert language.adapt(plain, rows, corpus.where("content LIKE '`%'"))[0] is plain


def test_codes_of_tokens_are_the_words_of_sentences():
    odd = ["", " . a b.", "- ... x y. z", "a. . b.", "1. foo! bar", "…", ".) x", "a .b c.", "\x1c a\x0bb. c", "# h\nx y", '"q" a. "b c" d?', "İX a’b.", "* one.\n    code. x\ntwo `b. c` three! four"]
    reader = SentenceWords()
    for text in odd + [t for _, _, t in SAMPLES]:
        codes, found, begins = reader.codes(text), [[]], True
        for code in codes:
            if code >> 2:
                found[-1].append(reader.words[code >> 2])
            begins = bool(code & (1 if begins else 2))
            if begins:
                found.append([])
        assert [x for x in found if x] == [w for _, _, s, _ in sentences(text) if (w := prose_words(s))], text
