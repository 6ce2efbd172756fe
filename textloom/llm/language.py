"""Language ID: a linear-chain conditional random field over the words of a text.

Words are runs of letters. A word's emission scores come from hashed features: its byte n-grams, those that
touch its edges (affixes), and the word itself (lexicon). Transition weights are learned on sequences spliced
from pieces of several labelled texts, as code-switched text would be. Forward-backward gives every word of a
text its language; the text takes the language with the largest share of the posterior mass.

The field is fitted on a bounded sample of labelled rows (`Settings.per_label` texts of each of at most
`Settings.labels` labels); prediction reads every word of every text, however long.

Defined results: `und` with score 0 for a null text or one without a letter; ties go to the label that sorts
first; equal texts get equal predictions, repeated rows one each; no labelled row at all gives `und` throughout, an
empty table an empty one; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, coded_words, crc_of_id, each_batch, folded, letter_words, raw_text, spread, table


@dataclass(frozen=True)
class Settings:
    #: Expected number of sampled texts of each label, the most labels learned (the most frequent ones; one that few rows
    #: carry by mistake is no language), and the longest text that the sample takes, in characters.
    per_label: int = 300
    labels: int = 256
    longest: int = 20_000
    buckets: int = 1 << 17
    length: int = 32
    batch: int = 256
    epochs: int = 3
    rate: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray


def features(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word and their offsets (n + 1)."""
    data, offsets = raw_text(words)
    n = len(offsets) - 1
    size = np.diff(offsets)
    edge = offsets + 2 * np.arange(n + 1)
    framed = np.zeros(edge[-1], np.uint8)
    framed[edge[:-1]] = ord("^")
    framed[edge[1:] - 1] = ord("$")
    framed[spread(edge[:-1] + 1, size)] = data
    wide = framed.astype(np.uint64)
    parts, owner = [], []
    word = np.repeat(np.arange(n), size + 2)
    code = wide + np.uint64(1)
    for k in range(1, 5):
        if k > 1:
            if len(wide) < k:
                break
            code = code[: len(wide) - k + 1] * np.uint64(257) + wide[k - 1 :] + np.uint64(1)
            ok = np.flatnonzero(word[: len(code)] == word[k - 1 :])
        else:
            ok = np.flatnonzero((framed != ord("^")) & (framed != ord("$")))
        parts.append(code[ok] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        owner.append(word[ok])
    # The whole word: a polynomial over its bytes.
    power = np.uint64(0x100000001B3) ** (np.arange(len(wide), dtype=np.uint64) - np.repeat(edge[:-1], size + 2).astype(np.uint64))
    if n:
        parts.append(np.add.reduceat(wide * power, edge[:-1]))
        owner.append(np.arange(n))
    code, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (parts, owner))
    code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    code = (code >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(owner.astype(np.int64), kind="stable")
    return code[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner.astype(np.int64), minlength=n))]).astype(np.int64)


def emissions(model: Model, words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros((0, len(model.labels)), np.float32)
    code, offsets = features(words, len(model.weights))
    return np.add.reduceat(model.weights[code], offsets[:-1], axis=0)


def texts_of(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, word starts, word ends and words before each text."""
    data, offsets = raw_text(pa.array(rows, pa.string()))
    return folded(data), *letter_words(data, offsets)


def fit(rows: list[tuple[str, str]], settings: Settings = Settings()) -> Model:
    """The field learned from (text, label) rows by Adagrad on the conditional likelihood."""
    labels = tuple(sorted({y for _, y in rows}))
    k, rng = len(labels), np.random.default_rng(settings.seed)
    weights = np.zeros((settings.buckets, k), np.float32)
    start, step = np.zeros(k, np.float32), np.eye(k, dtype=np.float32)
    if not rows:
        return Model(labels, weights, start, step)
    data, begin, end, before = texts_of([t for t, _ in rows])
    word, distinct = coded_words(data, begin, end)
    label = np.repeat([labels.index(y) for _, y in rows], np.diff(before))
    code, offsets = features(distinct, settings.buckets)
    counts = np.diff(offsets)
    size = settings.length
    sums = [np.full(x.shape, 1e-6, np.float32) for x in (weights, start, step)]
    if len(word) < size:
        return Model(labels, weights, start, step)
    cells = max(1, len(word) // size)
    for _ in range(settings.epochs):
        for _ in range(max(1, cells // settings.batch)):
            # Splice: each sequence is a piece of one text, then from a random word on a piece of another.
            a, b = (rng.integers(0, len(word) - size + 1, settings.batch) for _ in range(2))
            turn = np.where(rng.random(settings.batch) < 0.3, rng.integers(1, size, settings.batch), size)
            t = np.arange(size)
            at = np.where(t[None] < turn[:, None], a[:, None], b[:, None]) + t[None]
            w, y = word[at], label[at]
            used, local = np.unique(w, return_inverse=True)
            local = local.reshape(w.shape)
            feat = code[spread(offsets[used], counts[used])]
            lens = counts[used]
            emit = np.add.reduceat(weights[feat], np.cumsum(lens) - lens, axis=0)
            e = emit[local]
            scale = np.exp(e - e.max(axis=2, keepdims=True))
            move = np.exp(step - step.max())
            alpha = np.empty_like(scale)
            beta = np.ones_like(scale)
            alpha[:, 0] = scale[:, 0] * np.exp(start)
            alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
            for i in range(1, size):
                alpha[:, i] = alpha[:, i - 1] @ move * scale[:, i]
                alpha[:, i] /= alpha[:, i].sum(axis=1, keepdims=True)
            for i in range(size - 2, -1, -1):
                beta[:, i] = (beta[:, i + 1] * scale[:, i + 1]) @ move.T
                beta[:, i] /= beta[:, i].sum(axis=1, keepdims=True)
            mass = alpha * beta
            mass /= mass.sum(axis=2, keepdims=True)
            pair = alpha[:, :-1, :, None] * move * (scale * beta)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            gain = np.eye(k, dtype=np.float32)[y] - mass
            of_word = np.stack([np.bincount(local.ravel(), gain[..., j].ravel(), len(used)) for j in range(k)], 1)
            grad = np.repeat(of_word, lens, axis=0)
            touched, inverse = np.unique(feat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, grad[:, j], len(touched)) for j in range(k)], 1).astype(np.float32) / settings.batch - 1e-5 * weights[touched]
            sums[0][touched] += grad**2
            weights[touched] += settings.rate * grad / np.sqrt(sums[0][touched])
            seen = np.zeros((k, k), np.float32)
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            for x, s, g in ((start, sums[1], (gain[:, 0]).sum(0) / settings.batch), (step, sums[2], (seen - pair.sum(axis=(0, 1))) / settings.batch - 1e-3 * step)):
                s += g**2
                x += (settings.rate * g / np.sqrt(s)).astype(np.float32)
    return Model(labels, weights, start, step)


def posteriors(model: Model, emit: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Forward-backward over all texts at once: the marginal of each label at each word."""
    scale = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(model.step - model.step.max())
    size = np.diff(before)
    order = np.argsort(-size, kind="stable")
    first, size = before[:-1][order], size[order]
    alpha = np.empty_like(scale)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
    now = None
    for t in range(longest):
        at = first[: alive[t]] + t
        now = scale[at] * (np.exp(model.start) if t == 0 else now[: alive[t]] @ move)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    back = np.ones((0, scale.shape[1]), scale.dtype)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), scale.shape[1]), scale.dtype)])
        alpha[at] *= back
        back = (back * scale[at]) @ move.T
        back /= back.sum(axis=1, keepdims=True)
    return alpha / alpha.sum(axis=1, keepdims=True)


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode())


def label_texts(model: Model, column: pa.Array) -> tuple[list[str], list[float], pa.Array]:
    """Language and score of each text, and its runs of words of one language."""
    data, offsets = raw_text(column)
    starts, ends, before = letter_words(data, offsets)
    k = len(model.labels)
    n = len(offsets) - 1
    run_type = pa.list_(pa.struct([("words", pa.int32()), ("lang", pa.string())]))
    if not k or not len(starts):
        return ["und"] * n, [0.0] * n, pa.array([[]] * n, run_type)
    code, distinct = coded_words(folded(data), starts, ends)
    mass = posteriors(model, emissions(model, distinct)[code], before)
    total = np.concatenate([np.zeros((1, k)), np.cumsum(mass, axis=0, dtype=np.float64)])
    share = np.round((total[before[1:]] - total[before[:-1]]) / np.maximum(1, np.diff(before))[:, None], 6)
    best = share.argmax(axis=1)
    raw, at = data.tobytes(), offsets.tolist()
    low = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), out=low[1:])
    plain = low[offsets[1:]] > low[offsets[:-1]]
    known = [bool(plain[i]) or has_letter(raw[at[i] : at[i + 1]]) for i in range(n)]
    lang = [model.labels[best[i]] if known[i] else "und" for i in range(n)]
    score = [min(1.0, float(share[i, best[i]])) if known[i] else 0.0 for i in range(n)]
    word = mass.argmax(axis=1)
    turn = np.ones(len(word), bool)
    turn[1:] = word[1:] != word[:-1]
    turn[before[:-1][np.diff(before) > 0]] = True
    at = np.flatnonzero(turn)
    names = pa.DictionaryArray.from_arrays(pa.array(word[at].astype(np.int32)), pa.array(model.labels, pa.string())).cast(pa.string())
    items = pa.StructArray.from_arrays([pa.array(np.diff(np.append(at, len(word))).astype(np.int32)), names], names=["words", "lang"])
    return lang, score, pa.ListArray.from_arrays(pa.array(np.searchsorted(at, before).astype(np.int32)), items)


def train(df: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", settings: Settings = Settings()) -> Model:
    """Fit on a sample of the labelled rows; which rows are in it depends on their ids and texts alone."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("y")).where("y is not null and t is not null")
    rows = rows.where(F.length("t") <= settings.longest)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(settings.labels).collect()}
    if not sizes:
        return fit([], settings)
    coin = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for y, n in sorted(sizes.items()) for x in (y, min(1 << 30, (settings.per_label << 30) // n + 1))))
    picked = rows.where(coin < F.try_element_at(share, F.col("y"))).select("t", "y").collect()
    return fit(sorted((r["t"], r["y"]) for r in picked), settings)


def identify(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, key, lang_pred, score, runs array<struct<words, lang>>) of every row."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            lang, score, runs = label_texts(broadcast.value, b.column(b.num_columns - 1))
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), runs]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "lang_pred", "score", "runs"])

    src = bounded(df).select(*keep, F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("\x00text"))
    kept = ", ".join(f"`{n}` {t}" for n, t in src.dtypes[:-1])
    return src.mapInArrow(run, f"{kept}, lang_pred string, score double, runs array<struct<words:int,lang:string>>")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_of_id() % 5 != 0))
    return identify(docs, model).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score")
