import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm.neighbours import Settings, best, nearest


def brute(rows, asked, k=20):
    keep = {}
    d = Counter(len(v) for _, v in rows if v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v))
    d = max(d, key=lambda x: (d[x], x), default=0)
    for i, v in rows:
        if i is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v):
            keep.setdefault(i, [float(np.float32(x)) for x in v])
    ids = sorted(keep)
    out = {}
    for q in ids:
        if q in asked:
            s = sorted((-float(np.dot(keep[q], keep[i])), i) for i in ids if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def rows_of(n, d, seed):
    r = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(n, d)).astype(np.float32))]


def test_best():
    o, x, s = np.array([1, 1, 1, 2, 2]), np.array([5, 5, 6, 7, 8]), np.array([1.0, 1.0, 2.0, 3.0, 3.0])
    at = best(o, x, s, 2)
    assert list(zip(o[at].tolist(), x[at].tolist())) == [(1, 6), (1, 5), (2, 7), (2, 8)]


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rows = rows_of(1500, 12, 3)
    if scaled:
        rows = [(i, [x * (1 + i % 7) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = result(nearest(df, df.where("vec_id % 20 = 0")))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    v = dict(rows)
    assert all(abs(s - np.dot(v[q], v[i])) < 1e-4 * max(1, abs(s)) for q in got for i, s in got[q])


def test_copies_and_odd_rows(spark):
    rows = rows_of(130, 6, 4)
    r = random.Random(1)
    rows = [(i, rows[7][1] if r.random() < 0.5 else v) for i, v in rows]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0]), (20, rows[20][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    got, want = result(nearest(df, df.where("vec_id % 20 = 0"))), brute(rows, set(range(0, 400, 20)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q]))
    few = df.where("vec_id < 5")
    assert [i for i, _ in result(nearest(few, few.where("vec_id = 0")))[0]] == [i for i, _ in brute(rows[:5], {0})[0]]
    assert nearest(df.limit(0), df).count() == 0
    assert nearest(df.where("vec_id = 0"), df).count() == 0


def test_narrow_beam_is_widened(spark):
    rows = rows_of(700, 12, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})

    def found(least):
        got = result(nearest(df, df.where("vec_id % 20 = 0"), settings=Settings(degree=8, joined=6, beam=20, block=64, entries=2, least=least)))
        return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])

    narrow, widened = found(0.0), found(0.93)
    assert narrow < 0.9 <= widened


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("clustered", [False, True])
def test_shards_are_searched_without_a_row_for_each_pair(spark, clustered):
    """Rows in shuffles follow rows and results, not the pairs that graph and search compare; small far clusters are found."""
    rows = rows_of(2000, 12, 8)
    if clustered:
        middle = [v for _, v in rows_of(50, 12, 9)]
        rows = [(i, [float(np.float32(20 * a + 0.1 * b)) for a, b in zip(middle[i % 50], v)]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    before = shuffled(spark)
    got = result(nearest(df, df.where("vec_id % 20 = 0"), settings=Settings(few=500)))
    assert shuffled(spark) - before < 100_000  # 100 queries, 4 shards, 21 results: 8,400 a search; each row a few times
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
