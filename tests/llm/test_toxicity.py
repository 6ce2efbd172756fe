import itertools
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.common import crc_of_id
from textloom.llm.toxicity import Settings, rate_of, score_texts, segments, train


def brute(scores):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a : b + 1]), a - b, -a, a, b) for a, b in itertools.combinations_with_replacement(range(len(scores)), 2)), key=lambda x: (x[0], x[1], x[2]))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    return [*brute(scores[:a]), (best[0], a, b), *((s, x + b + 1, y + b + 1) for s, x, y in brute(scores[b + 1 :]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.randoms())
def test_segments_equal_brute_force(kinds, rnd):
    # Distinct irrational-like scores avoid ties, whose extents the definition leaves open.
    scores = [-0.31 if k < 2 else rnd.uniform(0.1, 2) * (1 if k == 2 else 0.3) for k in kinds]
    at = np.array([i for i, k in enumerate(kinds) if k >= 2], int)
    got = segments(np.array([scores[i] for i in at]), at, -0.31)
    want = brute(scores)
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_segments_of_a_long_text():
    """100,000 positive tokens under negative drift: linear, so well under the minutes that a quadratic scan takes."""
    r = np.random.default_rng(1)
    began = time.process_time()
    got = segments(r.uniform(0.1, 1, 100_000), np.arange(100_000) * 3, -0.4)
    assert time.process_time() - began < 5 and len(got) > 50_000
    assert all(x[2] < y[1] for x, y in itertools.pairwise(got))


def test_rate():
    assert abs(rate_of(np.array([0.2, 0.8]), np.array([np.log(0.5 / 0.2), np.log(0.5 / 0.8)])) - 1) < 1e-6


def table(spark, n=240):
    r = random.Random(3)
    rows = []
    for i in range(n):
        words = [r.choice(["river", "stone", "walk", "blue", "kind", "grün"]) for _ in range(r.randint(5, 60))]
        if i % 3 == 0:
            words[r.randrange(len(words)) :] = ["Dolt", "nitwit"]
        rows.append((i, " ".join(words), "clash", 1.0))
    return spark.createDataFrame([*rows, (9000, None, "x", 0.0), (9001, "", "x", 0.0), (9002, "grün Dolt, é nitwit!", None, 0.0), (1, rows[1][1], "x", 0.0)], "doc_id long, text string, spans string, score double")


def test_held_out(spark):
    df = table(spark)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = train(df, labels.where(crc_of_id() % 4 != 2))
    got = score_texts(df, model).withColumn("held", crc_of_id() % 4 == 2).collect()
    assert len(got) == 244
    held = [r for r in got if r.held and r.doc_id < 240]
    assert len(held) > 30 and all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in held)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.3 and by[9000].spans == []
    assert [(s.start, s.end) for s in by[9002].spans] == [(5, 19)]
    again = {(r.doc_id, r.score) for r in score_texts(df.repartition(5), train(df.repartition(3), labels.where(crc_of_id() % 4 != 2))).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert score_texts(df.limit(0), model).count() == 0
    assert {r.score for r in score_texts(df, train(df, labels.limit(0))).collect()} == {0.0}
    assert Settings().per_class > 0
