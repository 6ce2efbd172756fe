import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm.graph import components
from textloom.llm.simhash import fingerprints, link_cell, links, manhattan, near_duplicates, segment_counts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text):
    words = [w for w in (text or "").translate(LOW).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(n)) for n in (1, 2, 3, 4, 30, 900, 900, 1500)]
    out = ["", None, " \t\n", "é\xa0É x", "Á B\x0bC\x0cd"]
    for t in base:
        for k in range(12):
            w = t.split()
            if k:
                w[r.randrange(len(w))] = f"edit{k}"
            out.append((r.choice([" ", "\n", " \t"])).join(w) if k % 3 else " ".join(w).upper())
    return out + out[:7]


def test_fingerprints():
    t = texts()
    assert fingerprints(pa.array(t, pa.string())).tolist() == [simhash(x) for x in t]


def test_components_equal_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([(i + 10, x, 1) for i, x in enumerate(t)], "doc_id long, text string, f int")
    fp = {i + 10: simhash(x) for i, x in enumerate(t)}
    want = groups([(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    for most in (4096, 3):
        got = {r.doc_id: (r.f % 2**64, r.component_id) for r in near_duplicates(df, most=most).collect()}
        assert got == {k: (fp[k], want[k]) for k in fp}
    assert len(set(want.values())) < len(set(fp.values()))
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 5])
def test_links_of_dense_and_random_fingerprints(spark, most):
    r = random.Random(most)
    values = {r.getrandbits(64) for _ in range(300)}
    for c in [0, 2**64 - 1, *list(values)[:6]]:
        for _ in range(60):
            values.add(c ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))}))
    values = sorted(values)
    want = groups([(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 3], values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = components(links(spark.createDataFrame([(v,) for v in signed], "f long"), most=most)).collect()
    got = groups([(x.node % 2**64, x.root % 2**64) for x in found], values)
    assert got == want


def test_manhattan():
    r = random.Random(1)
    v = np.array([r.getrandbits(64) for _ in range(400)] + [0, 2**64 - 1], np.uint64)
    v = np.concatenate([v, v ^ np.uint64(0x8000000000000101)])
    counts = [[(int(x) >> i & 3).bit_count() for i in range(0, 64, 2)] for x in v]
    packed = segment_counts(v)
    for i in range(0, len(v), 37):
        want = [sum(abs(a - b) for a, b in zip(c, counts[i])) for c in counts]
        assert manhattan(packed, packed[i]).tolist() == want
        assert all(w <= (int(x) ^ int(v[i])).bit_count() for w, x in zip(want, v))


def test_crowded_on_every_grid(spark):
    """Many neighbours of one point crowd the cells of both grids of counts; the cells of exact bits hold them."""
    r = random.Random(2)
    center = r.getrandbits(64)
    values = sorted({center ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(0, 60, 5) for j in range(0, 64, 3) for k in range(0, 64, 5)} | {r.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "f long")
    want = groups([], values)
    near = [v for v in values if (v ^ center).bit_count() <= 3]
    got = groups([(x.node % 2**64, x.root % 2**64) for x in components(links(df, most=40)).collect()], values)
    assert len({got[v] for v in near}) == 1 and all(got[v] == want[v] for v in values if v not in set(near))


def test_link_cell_is_a_forest():
    x = np.unique(np.array([5 ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(40)], np.uint64))
    assert len(link_cell(x, 3)) == len(x) - 1


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def test_frequent_and_rare_fingerprints(spark):
    """Hot fingerprints are joined apart from the others: every row comes back once either way."""
    r = random.Random(8)
    rare = [" ".join(f"w{r.randrange(10**6)}" for _ in range(6)) for _ in range(1500)]
    t = ["one very common text of many copies"] * 700 + [None] * 40 + rare
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(t)], "doc_id long, text string").repartition(5)
    fp = {i + 1: simhash(x) for i, x in enumerate(t)}
    distinct = sorted(set(fp.values()))
    bits = np.array(distinct, np.uint64)
    close = [(a, distinct[j]) for i, a in enumerate(distinct) for j in (np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= 3) + i + 1).tolist()]
    root = groups(close, distinct)
    least = {}
    for k in sorted(fp):
        least.setdefault(root[fp[k]], k)
    got = [(x.doc_id, x.f % 2**64, x.component_id) for x in near_duplicates(df).collect()]
    assert sorted(got) == [(k, f, least[root[f]]) for k, f in sorted(fp.items())]
