"""What is worked out in one pass over the texts is the same as in a pass of its own."""

from collections import Counter

import pytest
from language_samples import DE, EN, RU, SAMPLES
from pyspark.sql import functions as F

from mnemospark.functions.text import is_blank
from mnemospark.llm import charlm, endings, language, pairs

ROWS = [(lang, t) for _, lang, t in SAMPLES]
TEXTS = [*EN, *DE, *RU, *(f"{EN[i % 4]} The {chr(97 + i % 26)}{chr(97 + i // 26)}x came back; {i} `odd {i}` ones." for i in range(400)), "", "- one\n2. two three four five.", "```\ncode\n```", "    indented\nQuite a few words \"dans une phrase\" here. [truncated]"]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "sample_id long, lang string, text string")


def test_each_text_is_read_once_to_adapt_the_models(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    texts = spark.createDataFrame([(t,) for t in TEXTS], "content string").repartition(3)
    model = charlm.train_calibrated(ROWS)
    adapted, counted = language.adapt(model, ROWS, texts.select(read.asNondeterministic()("content").alias("content")), endings.word_counts, 0, endings.token_words)
    assert adapted is not model and reads.value == len(TEXTS)
    assert counted == endings.word_counts(TEXTS)


@pytest.mark.parametrize("tokens", [50, 500_000])
def test_packed_words_count_as_the_texts_do(monkeypatch, tokens):
    monkeypatch.setattr(charlm.LanguageVotes, "TOKENS", tokens)
    model = charlm.train_calibrated(ROWS)
    first = charlm.LanguageVotes(model, True)
    assert not list(first.add(TEXTS)) and max(len(w.split()) for w, _ in first.packed) > (256 if tokens > 50 else 5)
    for turn in (True, False):
        read, again = charlm.LanguageVotes(model, turn), charlm.LanguageVotes(model, turn)
        got = [*read.add(TEXTS), *read.take()]
        more = [x for part in first.packed for x in again.add_packed(*part)]
        assert Counter({x[:2]: x[2] for x in got}) == Counter({x[:2]: x[2] for x in [*more, *again.take()]}) and got
        assert read.sentences == again.sentences


def test_the_pass_over_the_turns_calibrates_as_training_does(spark, samples):
    rows = [(i, None if i % 7 == 0 else f"t{i}", ("user", "Assistant", "tool", None)[i % 4], f"{t} {i}" + " [truncated]" * (i % 50 == 0)) for i, t in enumerate(TEXTS * 4)]
    turns = spark.createDataFrame(rows, "row_id long, id string, role string, content string").repartition(4)
    texts = turns.select("row_id", "id", "content", F.lit("turns").alias("tbl"))
    model, languages = endings.train(texts, samples)
    found = pairs.traits(turns, model, languages).cache()
    assert endings.summed_thresholds(found.where("step IS NOT NULL").withColumn("tbl", F.lit("turns"))) == model.thresholds
    each = {r.row_id: r for r in found.where("step IS NULL").collect()}
    assert set(each) == {i for i, _, role, _ in rows if role in ("user", "Assistant")}
    asked = [(i, t) for i, _, role, t in rows if role == "Assistant"]
    cut, odds = endings.judge([t for _, t in asked], ["turns"] * len(asked), model, charlm.TextScores(languages))
    assert [each[i].odds for i, _ in asked] == odds and any(x is not None for x in odds)
    for (i, _), is_cut, x in zip(asked, cut, odds, strict=True):
        lower = model.thresholds.get((each[i].lang, "turns"), model.thresholds[("", "")])
        assert (each[i].cut if x is None else x < lower) == is_cut


def test_blank_texts_are_told_by_more_than_their_first_characters(spark):
    rows = [("-" * 40 + "a", False), ("-" * 40, True), ("a" + "-" * 40, False), (None, True), ("", True), (" n/a " + " " * 40, True), (" n/a " + " " * 60, False)]
    got = spark.createDataFrame(rows, "t string, blank boolean").where(is_blank(F.col("t")) != F.col("blank")).collect()
    assert not got
