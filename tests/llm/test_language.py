import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.common import crc_of_id
from textloom.llm.language import Settings, fit, identify, label_texts, posteriors, train

WORDS = {"en": ["the", "house", "running", "with", "thing"], "fr": ["été", "maison", "les", "chaîne", "nous"], "de": ["straße", "nicht", "haus", "über", "sch"]}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return fit(sorted((text(y, 60, i), y) for i in range(60) for y in WORDS), Settings(buckets=1 << 14, epochs=8, batch=32))


def test_posteriors_equal_enumeration(model):
    rng = np.random.default_rng(1)
    emit = rng.normal(size=(9, 3)).astype(np.float32)
    before = np.array([0, 4, 4, 5, 9])
    got = posteriors(model, emit, before)
    for a, b in zip(before, before[1:]):
        mass = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            if path:
                s = model.start[path[0]] + sum(emit[a + i, y] for i, y in enumerate(path)) + sum(model.step[x, y] for x, y in zip(path, path[1:]))
                for i, y in enumerate(path):
                    mass[i, y] += np.exp(s)
        if b > a:
            assert np.allclose(got[a:b], mass / mass.sum(axis=1, keepdims=True), atol=1e-4)


def test_code_switching(model):
    mixed = text("en", 20, 5) + " " + text("de", 12, 6)
    lang, score, runs = label_texts(model, pa.array([mixed, "", None, "123 -- !", "Été", "日本", text("fr", 5000, 3)]))
    assert lang[0] == "en" and 0.5 < score[0] < 0.75
    assert runs[0].as_py() == [{"words": 20, "lang": "en"}, {"words": 12, "lang": "de"}]
    assert lang[1:4] == ["und"] * 3 and score[1:4] == [0.0] * 3 and lang[4] == "fr" and lang[5] != "und" and lang[6] == "fr"


def test_queries_and_held_out_accuracy(spark):
    rows = [(i, text(y, 30, i), y, "x") for i, y in enumerate(list(WORDS) * 60)] + [(500, None, "en", "x"), (501, "", None, "x"), (3, text("en", 30, 3), "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(df, train(df.where(crc_of_id() % 5 != 0))).withColumn("held", crc_of_id() % 5 == 0).collect()
    assert len(got) == len(rows)
    truth = dict((r[0], r[2]) for r in rows[:180])
    held = [r for r in got if r.held and r.doc_id in truth and r.doc_id != 3]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (500, 501)} == {"und"}
    again = {(r.doc_id, r.lang_pred, r.score) for r in identify(df.repartition(7), train(df.repartition(3).where(crc_of_id() % 5 != 0))).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in got}
    assert identify(df.limit(0), train(df)).count() == 0
    assert {r.lang_pred for r in identify(df, train(df.limit(0))).collect()} == {"und"}
