import random

from textloom.llm.mixing import fly, land, mix


def fill(sizes, weights, limit):
    """Targets by resharing the excess, as the contract words it."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full, out = float(sum(sizes.values())), set(), {}
    while True:
        left = total - sum(limit * sizes[n] for n in full)
        free = [n for n in names if n not in full]
        out = {n: limit * sizes[n] for n in full} | {n: left * w[n] / sum(w[m] for m in free) for n in free}
        above = {n for n in free if out[n] > limit * sizes[n] + 1e-9}
        if not above:
            return out
        full |= above


def test_flight_keeps_both_totals():
    r = random.Random(2)
    size = [float(r.randint(0, 500)) for _ in range(800)]
    p = fly(size, [0.37] * 800, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(s * x for s, x in zip(size, p)) - 0.37 * sum(size)) < 1e-3 and abs(sum(p) - 0.37 * 800) < 4
    q = land(size, p)
    assert set(q) <= {0.0, 1.0} and abs(sum(s * x for s, x in zip(size, q)) - 0.37 * sum(size)) <= 500


def test_inclusion_probabilities():
    size = [float(x) for x in (5, 9, 2, 7, 7, 4, 11, 90)]
    n = 4000
    hits = [0.0] * 8
    for s in range(n):
        for i, x in enumerate(fly(size, [0.3] * 8, random.Random(s))):
            hits[i] += x / n
    assert all(abs(h - 0.3) < 0.04 for h in hits)


def test_long_documents_are_settled_first():
    r = random.Random(4)
    size = [20_000.0, 9000.0, 9000.0, 3000.0, 0.0, *(float(r.randint(20, 400)) for _ in range(300))]
    for seed in range(20):
        p = fly(size, [0.41] * len(size), random.Random(seed))
        assert all(size[i] <= 60 for i, x in enumerate(p) if 0 < x < 1) and sum(0 < x < 1 for x in p) <= 2
        assert abs(sum(s * x for s, x in zip(size, p)) - 0.41 * sum(size)) < 1e-3
        q = land(size, p)
        assert abs(sum(s * x for s, x in zip(size, q)) - 0.41 * sum(size)) <= 30
    for size in ([7.0], [7.0, 7.0], [500.0] + [60.0] * 9, [60.0] * 9 + [5.0], []):
        p = fly(size, [0.5] * len(size), random.Random(1))
        assert sum(0 < x < 1 for x in p) <= 2 and abs(sum(s * x for s, x in zip(size, p)) - 0.5 * sum(size)) < 1e-6


def test_sources_meet_their_targets(spark):
    """On the tables at hand no source misses its target by over a hundredth, nor by over a tenth of a percent in larger ones."""
    for sf, most in (("sf0.01", 0.01), ("sf0.1", 0.001)):
        rows = mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).groupBy("source", "target").agg({"taken": "sum"}).collect()
        assert len(rows) > 3 and all(abs(x["sum(taken)"] - x.target) <= most * x.target for x in rows)


def test_mix(spark):
    r = random.Random(5)
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else r.choice(["a", "b", None, "tiny" if i < 60 else "é"])
        rows.append((i, None if i % 97 == 0 else " \t".join(["w"] * r.randint(0, 60)), s, "clash"))
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mix(df, chunk=64, keep=("text",)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes, (1, 2, 3), 3.0)
    took = {}
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and x.size == len((x.text or "").split())
        assert x.taken == x.size * x.copies and 0 <= x.copies <= 3
        took[x.source] = took.get(x.source, 0) + x.taken
    assert all(abs(took[s] - want[s]) <= 60 for s in want)
    key = lambda rows: sorted((x.doc_id, x.taken) for x in rows)
    assert key(mix(df.repartition(7), chunk=64).collect()) == key(got)
    assert mix(df.limit(0)).count() == 0
    assert [x.taken for x in mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()] == [0, 0]
