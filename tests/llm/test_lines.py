import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from textloom.llm.lines import PerfectHash, Shard, _pack, drop_common_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=40, documents=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and d is not None:
                held.setdefault(key(x), set()).add(d)
    common = {k: max(v) for k, v in held.items() if len(v) >= documents}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n))
    assert sorted(PerfectHash.build(keys).index(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("fits,shard_keys,most", [(1 << 30, 50_000, 1 << 30), (1 << 30, 7, 1), (0, 50_000, 1 << 30), (0, 7, 1 << 30), (0, 7, 40)])
def test_equals_brute_force(spark, fits, shard_keys, most):
    r = random.Random(8)
    pool = [f"Common line {i} " + "é" * r.randint(15, 40) + r.choice(["", " ", " x"]) for i in range(30)] + ["short"]
    rows = []
    for i in range(300):
        lines = [r.choice(["", "\t ", "  "]) + r.choice([str.upper, str, str.lower])(r.choice(pool)) + r.choice(["", "\r", " \x0b"]) for _ in range(r.randint(0, 5))]
        rows.append((i * 7 - 50, "\n".join([*lines, f"own line of document {i} " * 3, ""][r.randint(0, 1) :])))
    rows += [(9999, None), (9998, ""), (9997, "\n\n"), rows[3], rows[3], (9996, (pool[0] + "\n") * 2000), (-1, pool[1]), (None, pool[1] + "\nx\n" + pool[2]), (None, pool[1] + "\nx\n" + pool[2]), (None, None), (None, "".join(pool))]
    rows += [(20_000 + i, f"only the row without an id is last here, {'y' * 40}") for i in range(5)] + [(None, f"only the row without an id is last here, {'y' * 40}")]
    rows += [(8000 + i, "a line of three documents and of three rows without an id") for i in range(3)] + [(None, "a line of three documents and of three rows without an id")] * 3
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], "doc_id long, text string, n_lines string, h int")
    got = drop_common_lines(df, keep=("h",), fits=fits, shard_keys=shard_keys, most=most).collect()
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.text.encode()).hexdigest()) for x in got), key=repr) == brute(rows)
    assert sum(x.n_dropped for x in got) > 50 and {x.h for x in got} == {5}
    assert drop_common_lines(df.limit(0), fits=fits).count() == 0


def test_colliding_keys():
    pdf = pd.DataFrame({"shard": 0, "h": [5, 5, 6], "f": [1, 2, 3], "n": [7, 8, 9], "last": [10, 20, 30]})
    shard = Shard([tuple(x) for x in _pack(pdf)[["sizes", "bits", "prints", "counts", "lasts"]].itertuples(index=False)])
    count, last = shard.lookup(np.array([5, 5, 6, 5, 9]), np.array([1, 2, 3, 4, 1]))
    assert count.tolist() == [7, 8, 9, 0, 0] and last.tolist() == [10, 20, 30, 0, 0]
