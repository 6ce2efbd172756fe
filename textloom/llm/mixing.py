"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its weighted share of all words, capped at `limit` times its own size, the excess going to
the others by weight. A document of a source with target ratio r is taken floor(r) times, and once more with
probability r - floor(r). Which documents those are is drawn by the cube method: inclusion probabilities move
along the null space of two balancing constraints (words, and documents where there is room) until they are 0 or 1. Each chunk of a
source's documents makes its own flight, largest document first, and leaves a small document undecided (and at most one
without words); the undecided ones of many chunks fly again together, until a source has one chunk, whose last
document lands so that the words taken come closest to the target.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in order;
repeated rows are units of their own; an empty table gives an empty table; draws depend on the rows' values alone,
so reruns and other partitionings agree. Other columns are carried if named in `keep`.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Documents of one flight.
CHUNK = 1024
#: Chunks whose undecided documents meet in one flight of the next level.
JOINED = CHUNK // 4
EDGE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size). One row a source: the windows see only those.

    The level that fills all targets is the largest of (words left) / (weight left) that no later source's cap cuts.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by = by.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(every)).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    return by.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def reach(q: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """How far q can move along u, and against it, until one of it is 0 or 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - q) / u, np.where(u < 0, q / -u, np.inf)).min()
        down = np.where(u > 0, q / u, np.where(u < 0, (1 - q) / -u, np.inf)).min()
    return up, down


def fly(size: list[float], p: list[float], rng: random.Random) -> list[float]:
    """The flight: probabilities after it; at most one of a document with words is not 0 or 1.

    Each step means to decide on the largest document left: it moves along the null space while all others make up
    for it, each a little, in words and documents. Where they can't do both, they do so in words alone. So what is
    left for the landing is a small document.
    """
    out = np.array(p, float)
    open_ = np.flatnonzero((out > 0) & (out < 1))
    open_ = open_[np.argsort(-np.asarray(size, float)[open_], kind="stable")]
    s, q = np.asarray(size, float)[open_], out[open_]
    while len(q) > 1:
        w = q[1:] * (1 - q[1:])
        u = np.ones(len(q))
        if s[0] == s[-1]:
            u[1:] = -w / w.sum()
            up, down = reach(q, u)
        else:
            # Weights (a + b * size) * w, whose sum is 1 and whose words are those of the first.
            x, y = s[1:] - s[1:].mean(), s[0] - s[1:].mean()
            m0, m1, m2 = w.sum(), (w * x).sum(), (w * x * x).sum()
            det = m0 * m2 - m1 * m1
            up = down = 0.0
            if det > 1e-9 * m0 * m2:
                u[1:] = -((m2 - m1 * y) + (m0 * y - m1) * x) * w / det
                up, down = reach(q, u)
            if up < 1 - q[0] or down < q[0]:
                total = (w * s[1:]).sum()
                if not total:  # the others have no words
                    out[open_[0]] = q[0]
                    open_, s, q = open_[1:], s[1:], q[1:]
                    continue
                u[1:] = -w * (s[0] / total)
                up, down = reach(q, u)
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        q = np.where(q < EDGE, 0.0, np.where(q > 1 - EDGE, 1.0, q))
        left = (q > 0) & (q < 1)
        out[open_[~left]] = q[~left]
        open_, s, q = open_[left], s[left], q[left]
    out[open_] = q
    return out.tolist()


def land(size: list[float], p: list[float]) -> list[float]:
    """The landing: of all ways to round the few that are left, the one whose words are closest to what is due."""
    open_ = [i for i, v in enumerate(p) if 0 < v < 1]
    due = sum(size[i] * p[i] for i in open_)
    docs = sum(p[i] for i in open_)
    ways = ((abs(sum(size[i] for j, i in enumerate(open_) if w >> j & 1) - due), abs(w.bit_count() - docs), w) for w in range(1 << len(open_)))
    best = min(ways)[2]
    out = list(p)
    for j, i in enumerate(open_):
        out[i] = float(best >> j & 1)
    return out


def mix(df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, text: str = "text", key: str = "doc_id", source: str = "source", chunk: int = CHUNK, keep: tuple[str, ...] = (), seed: int = 1) -> DataFrame:
    """(kept columns, key, size, source, source_size, target, copies, taken) of every row."""
    sizes = cut(
        df.select(
            F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), F.col(key).cast("long").alias("k"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    # A row a source: Spark broadcasts that side where its measured size allows it, and splits hot sources otherwise.
    of = targets(sizes, weights, limit)
    due = cut(of.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rows = sizes.alias("d").join(due.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.source_size", "s.n_docs", "s.target", F.floor("ratio").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"))
    largest = due.agg(F.max("n_docs")).first()[0] or 0
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / chunk)).cast("long")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("k", "size", F.lit(seed)), chunks))
    level, whole = 0, None
    n = max(1, -(-largest // chunk))
    joined = max(2, chunk // 4)
    while True:
        last = n == 1
        flown = rows.groupBy("source", "chunk").applyInPandas(_flight(seed, level, last), rows.schema)
        if last:
            decided = flown if whole is None else whole.unionByName(flown)
            break
        flown = cut(flown)
        done = flown.where("p = 0 or p = 1")
        whole = done if whole is None else whole.unionByName(done)
        rows = flown.where("p > 0 and p < 1").withColumn("chunk", F.floor(F.col("chunk") / joined))
        n, level = -(-n // joined), level + 1
    copies = (F.col("base") + F.col("p")).cast("int")
    kept = [F.col(f"kept.{c}") for c in keep]
    return decided.select(*kept, F.col("k").alias(key), "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _flight(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pd.DataFrame({"h": (pdf["k"].fillna(-1).astype("int64") * 0x5851F42D4C957F2D + seed), "k": pdf["k"], "s": pdf["size"], "p": pdf["p"]}).sort_values(["h", "k", "s", "p"], kind="stable").index
        pdf = pdf.loc[order]
        name = pdf["source"].iloc[0]
        rng = random.Random(f"{seed}/{level}/{'' if name is None else 's' + str(name)}/{pdf['chunk'].iloc[0]}")
        size = [float(x) for x in pdf["size"]]
        p = fly(size, [0.0 if x < EDGE else 1.0 if x > 1 - EDGE else x for x in pdf["p"].tolist()], rng)
        return pdf.assign(p=land(size, p) if last else p)

    return run


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
