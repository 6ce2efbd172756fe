"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are lower-cased runs of letters. A bounded sample of labelled texts names the units (whole tokens and
prefixes) whose use differs between the classes (log-odds ratio with a Dirichlet prior, by its z-score); the
counts behind the scores' prior and the background come from all texts. A token's score is the log-odds of its
best unit; tokens without one share one small negative score.
A linear-time scan finds all maximal scoring segments of a text. Under the background, segment scores follow an
extreme-value law (its rate solves sum p exp(rate * s) = 1), which turns a text's segments into an expected number
of chance segments as good; a logistic curve fitted on the sample maps that evidence to a probability.

Bounds: `Settings.per_class` texts of each class are sampled; the table of units holds units of that sample only.

Defined results: a null or empty text, or one without letters, has no segment and gets the probability of no
evidence; equal texts get equal scores; without labelled rows of both classes every score is 0; other columns of
the input are not read. Spans are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, coded_words, crc_of_id, each_batch, folded, letter_words, raw_text, table


@dataclass(frozen=True)
class Settings:
    #: Expected number of sampled texts of each class.
    per_class: int = 2000
    #: Weight of the Dirichlet prior in texts (naming units), and in tokens (scores).
    prior: float = 10.0
    tokens: float = 1000.0
    #: Least z-score of a unit that gets a score of its own.
    z: float = 3.0
    #: Least log-odds ratio of such a unit between texts of the two classes.
    ratio: float = 2.5
    #: Segments whose expected number by chance in a text is above this don't count.
    chance: float = 1.0


@dataclass(frozen=True)
class Model:
    ranks: dict[bytes, float]
    scores: dict[bytes, float]
    other: float
    rate: float
    curve: tuple[float, ...]


NONE = Model({}, {}, -1.0, 1.0, ())


def segments(score: np.ndarray, at: np.ndarray, other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first token, last token).

    `score` are the scores of the tokens at the ascending positions `at`; tokens between them score `other` < 0.
    Each candidate keeps the sum before it and after it; a candidate joins back to the nearest one that began lower,
    unless that one also ended higher. Candidates link to the nearest lower one, so that a search never looks twice at
    those between: the scan is linear.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, link
    total, next_at = 0.0, 0
    for s, i in zip(score.tolist(), at.tolist(), strict=True):
        total += other * (i - next_at)
        next_at = i + 1
        low, total = total, total + s
        if s <= 0:
            continue
        first, k = i, len(stack) - 1
        while True:
            while k >= 0 and stack[k][0] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= total:
                stack.append((low, total, first, i, k))
                break
            low, _, first, _, link = stack[k]
            del stack[k:]
            k = link
    return [(r - l, a, b) for l, r, a, b, _ in stack]


def rate_of(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum p exp(rate * s) = 1; the scores' mean must be negative and one of them positive."""
    top = 1.0
    f = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum() - 1)
    while f(top) < 0 and top < 1e6:
        top *= 2
    low = 0.0
    for _ in range(80):
        mid = (low + top) / 2
        low, top = (mid, top) if f(mid) < 0 else (low, mid)
    return (low + top) / 2


def evidence(found: list[tuple[float, int, int]], tokens: int, rate: float, chance: float) -> tuple[list[float], list[tuple[float, int, int]]]:
    """Features of a text and its significant segments: -log of the expected number by chance of the best one and of
    all together, and the number of significant segments."""
    size = math.log(max(1, tokens))
    kept = [x for x in found if math.exp(min(50.0, size - rate * x[0])) <= chance]
    best = max((rate * x[0] - size for x in found), default=-10.0)
    gains = sorted((rate * x[0] - size for x in kept), reverse=True)
    # r segments of summed score: the sum statistic divides by r! for their order.
    both = sum(gains) + math.lgamma(len(gains) + 1) if gains else 0.0
    return [max(best, -10.0), min(both, 60.0), math.log1p(len(kept))], kept


def solve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, slightly ridged."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def probability(curve: tuple[float, ...], features: list[float]) -> float:
    if not curve:
        return 0.0
    v = curve[0] + sum(a * b for a, b in zip(curve[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


#: Lengths in bytes of the prefixes that stand beside a whole token.
PREFIXES = range(4, 11)


def units_of(word: bytes) -> list[bytes]:
    """The whole token and its prefixes, so that inflected forms of one stem share evidence."""
    return [word + b"$", *(word[:k] + b"*" for k in PREFIXES if k < len(word))]


def best_unit(word: bytes, ranks: dict[bytes, float]) -> bytes | None:
    """The token's unit with the strongest evidence, if it has any."""
    found = [(ranks[u], u) for u in units_of(word) if u in ranks]
    return max(found)[1] if found else None


def scored(column: pa.Array, model: Model) -> list[tuple[list[tuple[float, int, int]], int, np.ndarray, np.ndarray]]:
    """Per text: its segments, its number of tokens, and starts and ends of its tokens in bytes of the text."""
    data, offsets = raw_text(column)
    low = folded(data)
    starts, ends, before = letter_words(low, offsets)
    code, distinct = coded_words(low, starts, ends)
    best = (best_unit(w, model.ranks) for w in distinct.to_pylist()) if model.ranks else ()
    value = np.fromiter((np.nan if u is None else model.scores[u] for u in best), float)
    value = value[code] if len(value) else np.full(len(code), np.nan)
    hits = np.flatnonzero(~np.isnan(value))
    cut = np.searchsorted(hits, before)
    out = []
    for i in range(len(offsets) - 1):
        own = hits[cut[i] : cut[i + 1]]
        a, b = before[i], before[i + 1]
        found = segments(value[own], own - a, model.other) if len(own) else []
        out.append((found, int(b - a), starts[a:b] - offsets[i], ends[a:b] - offsets[i]))
    return out


COUNTS = pa.schema([("unit", pa.binary()), ("y", pa.int32()), ("n", pa.int64())])


def texts_with(df: DataFrame) -> DataFrame:
    """(unit, y, n): in how many texts of (t, y) each unit occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            sums: dict[tuple[bytes, int], int] = {}
            data, offsets = raw_text(b.column(0))
            low = folded(data)
            starts, ends, before = letter_words(low, offsets)
            code, distinct = coded_words(low, starts, ends)
            units = [units_of(w) for w in distinct.to_pylist()]
            for i, y in enumerate(b.column(1).to_pylist()):
                for u in {u for c in np.unique(code[before[i] : before[i + 1]]).tolist() for u in units[c]}:
                    sums[u, y] = sums.get((u, y), 0) + 1
            yield pa.RecordBatch.from_pydict({"unit": [u for u, _ in sums], "y": [y for _, y in sums], "n": list(sums.values())}, schema=COUNTS)

    return bounded(df).select("t", "y").mapInArrow(run, "unit binary, y int, n long").groupBy("unit", "y").agg(F.sum("n").alias("n"))


def tokens_with(df: DataFrame, ranks) -> dict[tuple[bytes | None, int], int]:
    """Tokens of (t, y) by their best unit; None stands for all tokens without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bytes | None, int], int] = {}
        known = ranks.value
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(0))
            low = folded(data)
            starts, ends, before = letter_words(low, offsets)
            code, distinct = coded_words(low, starts, ends)
            best = [best_unit(w, known) for w in distinct.to_pylist()]
            own = [i for i, u in enumerate(best) if u is not None]
            of = np.repeat(b.column(1).to_numpy(zero_copy_only=False), np.diff(before))
            for y in np.unique(of).tolist():
                n = np.bincount(code[of == y], minlength=len(best))
                sums[None, y] = sums.get((None, y), 0) + int(n.sum() - n[own].sum())
                for i in own:
                    if n[i]:
                        sums[best[i], y] = sums.get((best[i], y), 0) + int(n[i])
        yield pa.RecordBatch.from_pydict({"unit": [u for u, _ in sums], "y": [y for _, y in sums], "n": list(sums.values())}, schema=COUNTS)

    rows = bounded(df).select("t", "y").mapInArrow(run, "unit binary, y int, n long").groupBy("unit", "y").agg(F.sum("n").alias("n")).collect()
    return {(None if r["unit"] is None else bytes(r["unit"]), r["y"]): r["n"] for r in rows}


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows given; background counts come from all rows of df."""
    spark = df.sparkSession
    y = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return NONE
    coin = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for v, n in sorted(sizes.items()) for x in (v, min(1 << 30, (settings.per_class << 30) // n + 1))))
    picked = y.where(coin < share[F.col("y")])
    # The sample is bounded by per_class, so its ids are too.
    sample = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null").join(F.broadcast(picked), "k")
    # One of equal texts, so that copies don't count as independent evidence.
    sample = sample.groupBy("t").agg(F.min("k").alias("k"), F.max("y").alias("y"))

    # The sample alone: units that occur in texts of one class more than in those of the other.
    m0, m1 = (sample.where(F.col("y") == v).count() for v in (0, 1))
    rows = texts_with(sample).groupBy("unit").pivot("y", [0, 1]).agg(F.sum("n")).na.fill(0).toDF("unit", "c0", "c1")
    a = 0.5 + F.lit(settings.prior) * (F.col("c0") + F.col("c1")) / F.lit(m0 + m1)
    odds = lambda c, n: F.log((F.col(c) + a) / (F.lit(n + settings.prior + 1) - F.col(c) - a))
    ratio = odds("c1", m1) - odds("c0", m0)
    z = ratio / F.sqrt(1 / (F.col("c1") + a) + 1 / (F.col("c0") + a))
    ranks = {bytes(r["unit"]): r["z"] for r in rows.select("unit", z.alias("z")).where((F.col("z") > settings.z) & (ratio > settings.ratio)).collect()}
    if not ranks:
        return NONE

    # All texts: token counts behind the prior and the background. The sample: token counts of each class.
    shared = spark.sparkContext.broadcast(ranks)
    whole = tokens_with(df.select(F.col(text).cast("string").alias("t"), F.lit(0).alias("y")), shared)
    of_class = tokens_with(sample, shared)
    total = sum(whole.values())
    n0, n1 = (sum(n for (_, v), n in of_class.items() if v == w) for w in (0, 1))
    weight = settings.tokens

    def shares(unit: bytes | None) -> tuple[float, float]:
        """Smoothed shares of the unit among tokens of clean and of toxic texts."""
        a = 0.5 + weight * whole.get((unit, 0), 0) / total
        return tuple((of_class.get((unit, v), 0) + a) / (n + weight + 1) for v, n in ((0, n0), (1, n1)))

    odds_of = {u: math.log(p1 / p0) for u in sorted(ranks) for p0, p1 in [shares(u)]}
    scores = {u: v for u, v in odds_of.items() if v > 0}
    ranks = {u: v for u, v in ranks.items() if u in scores}
    if not scores:
        return NONE
    # The background of the extreme-value law is clean text.
    share_of = np.array([shares(u)[0] for u in scores])
    share_of *= min(1.0, 0.5 / share_of.sum())
    values = np.array(list(scores.values()))
    p0, p1 = shares(None)
    other = min(-1e-4, math.log(p1 / p0))
    drift = float((share_of * values).sum())
    if drift + (1 - share_of.sum()) * other >= 0:  # the law asks for a negative drift
        other = -1.01 * drift / (1 - share_of.sum()) - 1e-6
    rate = rate_of(np.append(share_of, 1 - share_of.sum()), np.append(values, other))
    model = Model(ranks, scores, other, rate, ())
    got = score_texts(sample, model, "t", "k", ("y",), settings).select("k", "y", "features").collect()
    got.sort(key=lambda r: (r["k"], r["y"]))
    truth = np.array([r["y"] for r in got], float)
    weights = solve(np.array([r["features"] for r in got]), truth)
    # The sample takes classes alike; give the curve the classes' true shares.
    shift = math.log(sizes[1] / sizes[0]) - math.log(max(1.0, truth.sum()) / max(1.0, (1 - truth).sum()))
    return Model(ranks, scores, other, rate, (weights[0] + shift, *weights[1:]))


def score_texts(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), settings: Settings = Settings()) -> DataFrame:
    """(kept columns, key, score, features, spans array<struct<start, end, score>>): probability and significant passages."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in each_batch(batches):
            column = b.column(b.num_columns - 1)
            data, offsets = raw_text(column)
            probs, feats, spans = [], [], []
            for i, (found, n, starts, ends) in enumerate(scored(column, m)):
                f, kept = evidence(found, n, m.rate, settings.chance)
                probs.append(probability(m.curve, f))
                feats.append(f)
                chars = None
                if kept:
                    own = data[offsets[i] : offsets[i + 1]]
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                spans.append([{"start": int(chars[starts[x]]), "end": int(chars[ends[y]]), "score": round(s, 9)} for s, x, y in kept])
            more = [pa.array(probs, pa.float64()), pa.array(feats, pa.list_(pa.float64())), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "score", "features", "spans"])

    src = bounded(df).select(*keep, F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("\x00text"))
    kept = ", ".join(f"`{n}` {t}" for n, t in src.dtypes[:-1])
    return src.mapInArrow(run, f"{kept}, score double, features array<double>, spans array<struct<start:int,end:int,score:double>>")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(crc_of_id() % 4 != 2))
    score = F.round("score", 9)
    return score_texts(docs, model).select(
        "doc_id", (crc_of_id() % 4 == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans")
    )
