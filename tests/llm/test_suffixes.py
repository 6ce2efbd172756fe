import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import suffixes
from textloom.llm.anchors import anchors, sliding_min
from textloom.llm.suffixes import Trie, deep_shallow, remove_repeats


def brute(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - window + 1):
            if count[r[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        kept = bytes(b for b, g in zip(r, gone[1:-1]) if not g)
        out.append((d, len(r), len(r) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), kept))
    return sorted(out, key=repr)


def corpus(seed, window):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randint(window // 5, window)) for _ in range(4)]
    out = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            parts.append(r.choice([s, s[a:], s[:a], text(r.randint(1, window // 3)), s[:a] + "X" + s[a + 1 :]]))
        out.append((i, "".join(parts)))
    out += [(100, None), (101, ""), (102, "z" * (window * 2)), (103, "ab" * window), (104, "ab" * window + "q"), out[5], out[5], (105, "y" * (window - 1)), (106, "y" * (window - 1)), (107, "w" * (window + 1))]
    return out


@pytest.mark.parametrize("window,gram,crowd,most", [(60, 40, 50_000, 64), (60, 24, 4, 64), (60, 24, 4, 2), (60, 40, 50_000, 1), (61, 61, 2, 1), (400, 256, 50_000, 3)])
def test_equals_brute_force(spark, window, gram, crowd, most):
    rows = corpus(window + gram, window)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, kept string, t int")
    got = remove_repeats(df, window=window, gram=gram, crowd=crowd, most=most)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr)
    assert got == brute(rows, window)
    assert any(x[2] for x in got) and any(0 < x[2] < x[1] for x in got)


def test_crowd_in_parts(spark):
    """One anchor's occurrences in small Arrow batches: the last part, below the crowd, holds the copy of a row in the first."""
    window, gram, crowd = 60, 40, 4
    r = random.Random(5)
    side = lambda: bytes(r.choice(b"abcdefgh") for _ in range(window - gram))
    contexts = [(side(), side()) for _ in range(6)]
    rows = [(None, None, 7, t, 100, 20, 0, 0, *contexts[t % 6]) for t in range(7)]
    hoods = spark.createDataFrame(rows, suffixes.HOODS).coalesce(1)
    found = set()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffixes, "bounded", lambda df: df)  # keeps the batches small
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        try:
            while not hoods.isEmpty():
                got = suffixes.matched(hoods, window, gram, crowd).collect()
                found |= {x.t for x in got if x.lo is not None}
                hoods = spark.createDataFrame([tuple(x) for x in got if x.lo is None], suffixes.HOODS)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {0, 6}


def test_common_periodic_passage(spark):
    """Many texts share runs of one short period: their anchors are thinned out and dealt under longer names."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    rows = [(i, f"{word()} {'ha ' * r.randint(20, 60)}{word()} {word()}" if i % 3 else " ".join(word() for _ in range(20))) for i in range(300)]
    rows += [(1000, "ha " * 40_000), (1001, "q" + "ha " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = remove_repeats(df, window=60, gram=24, most=8).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=repr) == brute(rows, 60)


@pytest.mark.parametrize("both", [False, True])
def test_copies_around_crowded_passages(spark, both):
    """Copies of a text in two Arrow batches, around a passage that is crowded in the first, or in both."""
    window, r = 60, random.Random(11)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passages = [text(44) for _ in range(20)]
    copied = [text(12) + p + text(12) for p in passages]
    crowd = lambda: [text(12) + p + text(12) for p in passages for _ in range(6)]
    first, second = copied + crowd(), copied + (crowd() if both else [])
    rows = list(enumerate([*first, *second]))
    parts = spark.sparkContext.parallelize([rows[: len(first)], rows[len(first) :]], 2).flatMap(lambda x: x)
    got = remove_repeats(spark.createDataFrame(parts, "doc_id long, text string"), window=window, gram=24, most=2).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=repr) == brute(rows, window)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=48).map(lambda b: bytes(x % 3 for x in b))), max_size=40))
def test_order(rows):
    rows = [(g, b"\1" * (len(b) % 3 * 16) + b) for g, b in rows]
    text = np.frombuffer(b"".join(b.ljust(80, b"\0") for _, b in rows), np.uint8).reshape(len(rows), 80)
    group = np.array([g for g, _ in rows], np.int64)
    order = deep_shallow(group, text)
    assert [(group[i], text[i].tobytes()) for i in order] == sorted((g, b.ljust(80, b"\0")) for g, b in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=30))
def test_trie(texts):
    trie = Trie(6, [0])
    for i in range(1, len(texts)):
        trie = trie.insert(i, texts)
    assert [texts[i] for i in trie.ordered()] == sorted(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 12))
def test_anchors(values, w):
    x = np.array(values, np.uint64)
    if len(x) >= w:
        assert sliding_min(x, w).tolist() == [min(values[i : i + w]) for i in range(len(x) - w + 1)]
    want = {j for i in range(len(x) - w + 1) for j in range(i, i + w) if values[j] == min(values[i : i + w])}
    assert set(anchors(x, w).tolist()) == want
