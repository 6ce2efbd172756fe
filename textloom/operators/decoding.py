"""Sequence decoding: word segmentation and tagging by exact Viterbi, greedy segmentation, and the adapter's acceptance rule.

Dynamic programming has no relational form, so these are Arrow-batched kernels. They decode distinct strings only. Models
of any size lie in mapped tables; a kernel looks up what a batch can need at once, and decodes by that. Dictionaries that
are sent whole (the greedy vocabulary, tag n-grams) are checked for size (`MODEL_ROWS`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_edges
from .counts import END, START
from .tables import Table, stored

#: Most rows of a model that a worker holds. Beyond it, train with a higher least count.
MODEL_ROWS = 5_000_000


@dataclass
class WordModel:
    """Counts of the segmenter."""

    one: dict[str, int]
    two: dict[tuple[str, str], int]
    three: dict[tuple[str, str, str], int]
    total: int | None = None
    longest: int | None = None
    size: int | None = None

    def __post_init__(self) -> None:
        if self.size is None:
            self.total, self.size, self.longest = sum(self.one.values()), len(self.one), max(map(len, self.one), default=20)

    def word(self, w: str) -> float:
        return (self.one.get(w, 0) + 1) / (self.total + self.size)

    def after(self, w: str, b: str, a: str) -> float:
        return (self.three.get((b, a, w), 0) + 1) / (self.two.get((b, a), 0) + self.size + 1)

    def known(self, words: set[str]) -> set[str]:
        return words & self.one.keys()

    def local(self, texts: list[str], longest: int | None = None) -> WordModel:
        return self

    def candidates(self, text: str, at: int, longest: int | None = None) -> list[str]:
        most = min(len(text), at + (longest or self.longest))
        return [text[at:e] for e in range(at + 1, most + 1) if text[at:e] in self.one]


@dataclass
class StoredWordModel:
    """The same counts in tables; local() has those that some texts can need."""

    one: Table
    two: Table
    three: Table
    total: int
    longest: int
    size: int

    def found(self, table: Table, keys: list) -> dict:
        """Of single words or tuples of them, those with a count."""
        if not keys:
            return {}
        n = table.get(*zip(*keys, strict=True)) if isinstance(keys[0], tuple) else table.get(keys)
        return {k: x for k, x in zip(keys, n.tolist(), strict=True) if x}

    def known(self, words: set[str]) -> set[str]:
        return set(self.found(self.one, list(words)))

    def local(self, texts: list[str], longest: int | None = None) -> WordModel:
        most = longest or self.longest
        one = self.found(self.one, list({t[i:e] for t in texts for i in range(len(t)) for e in range(i + 1, min(len(t), i + most) + 1)}))
        here = WordModel(one, {}, {}, self.total, self.longest, self.size)
        pairs: dict[tuple[str, str], set[str]] = {}
        for t in texts:  # words that begin and end at each position that can be reached
            ends: dict[int, list[tuple[str, int]]] = {0: [(START, -1)]}
            starts: list[list[str]] = [[]] * len(t) + [[END]]
            for i in range(len(t)):
                if i in ends:
                    starts[i] = here.candidates(t, i, longest) or [t[i]]
                    for w in starts[i]:
                        ends.setdefault(i + len(w), []).append((w, i))
            for i, words in ends.items():
                for a, at in words:
                    for b, _ in ends[at] if at >= 0 else ((START, -1),):
                        pairs.setdefault((b, a), set()).update(starts[i])
        here.two = self.found(self.two, list(pairs))
        # A trigram was seen only if its first two words were.
        here.three = self.found(self.three, [(*p, w) for p in here.two for w in pairs[p]])
        return here


@dataclass
class TagModel:
    """Counts of the tagger."""

    pairs: dict[tuple[str, str], int]
    tags: dict[str, int]
    two: dict[tuple[str, str], int]
    three: dict[tuple[str, str, str], int]
    size: int | None = None

    def __post_init__(self) -> None:
        self.of: dict[str, list[str]] = {}
        for w, t in sorted(self.pairs):
            self.of.setdefault(w, []).append(t)
        self.all = sorted(self.tags)
        self.size = len(self.of) if self.size is None else self.size

    def local(self, words: set[str]) -> TagModel:
        return self

    def possible(self, w: str) -> list[str]:
        return self.of.get(w, self.all)

    def emit(self, w: str, t: str) -> float:
        return (self.pairs.get((w, t), 0) + 1) / (self.tags.get(t, 0) + self.size)

    def move(self, b: str, a: str, t: str) -> float:
        return (self.three.get((b, a, t), 0) + 1) / (self.two.get((b, a), 0) + len(self.tags) + 1)


@dataclass
class StoredTagModel:
    """The same counts with those of words in a table: (word, rank) has the word's rank-th tag and its count."""

    pairs: Table
    tags: dict[str, int]
    two: dict[tuple[str, str], int]
    three: dict[tuple[str, str, str], int]
    size: int

    def local(self, words: set[str]) -> TagModel:
        names, left, pairs = sorted(self.tags), list(words), {}
        for rank in range(len(names)):
            got = self.pairs.get(left, [str(rank)] * len(left)).tolist()
            pairs |= {(w, names[x & 0xFFFF]): x >> 16 for w, x in zip(left, got, strict=True) if x}
            left = [w for w, x in zip(left, got, strict=True) if x]
        return TagModel(pairs, self.tags, self.two, self.three, self.size)


def segment(text: str, m: WordModel, longest: int | None = None) -> tuple[list[str], float]:
    """The best words of a string without spaces, and their score. Words score alone and in their context; a position
    without a known word takes one character. Of equal scores the first found stays, shorter words being tried first."""
    if not text:
        return [], 0.0
    states: list[dict[tuple[str, str], tuple[float, tuple | None]]] = [{} for _ in range(len(text) + 1)]
    states[0][START, START] = (0.0, None)
    for at in range(len(text)):
        if not states[at]:
            continue
        options = [(w, math.log(m.word(w))) for w in m.candidates(text, at, longest) or [text[at]]]
        for (b, a), (score, _) in states[at].items():
            for w, own in options:
                new = score + own + math.log(m.after(w, b, a))
                there = states[at + len(w)]
                if (a, w) not in there or new > there[a, w][0]:
                    there[a, w] = (new, (at, b, a))
    best, key = -math.inf, None
    for (b, a), (score, _) in states[-1].items():
        new = score + math.log(m.after(END, b, a))
        if new > best:
            best, key = new, (b, a)
    out, at = [], len(text)
    while at:
        out.append(key[1])
        at, *key = states[at][tuple(key)][1]
        key = tuple(key)
    return out[::-1], best


def greedy(text: str, vocab, longest: int | None = None) -> list[str]:
    """The longest known word at each position, or one character."""
    out, at = [], 0
    while at < len(text):
        most = len(text) if longest is None else min(len(text), at + longest)
        end = next((e for e in range(most, at, -1) if text[at:e] in vocab), at + 1)
        out.append(text[at:end])
        at = end
    return out


def viterbi(words: list[str], m: TagModel) -> tuple[list[str], float]:
    """The best tags of a sentence of lower-case words. A word never seen may have any tag; ties go to the tag tried first."""
    if not words:
        return [], 0.0
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {(START, START): (0.0, None)}
    trace = []
    for w in words:
        new: dict[tuple[str, str], tuple[float, tuple]] = {}
        options = [(t, math.log(m.emit(w, t))) for t in m.possible(w)]
        for (b, a), (score, _) in states.items():
            for t, own in options:
                s = score + own + math.log(m.move(b, a, t))
                if (a, t) not in new or s > new[a, t][0]:
                    new[a, t] = (s, (b, a))
        trace.append(new)
        states = new
    best, key = -math.inf, None
    for (b, a), (score, _) in states.items():
        s = score + math.log(m.move(b, a, END))
        if s > best:
            best, key = s, (b, a)
    out = []
    for step in reversed(trace):
        out.append(key[1])
        key = step[key][1]
    return out[::-1], best


def collected(df: DataFrame, *columns: str, value: str = "n") -> dict:
    """A model table as a dictionary; an error if it is larger than a worker may hold."""
    rows = df.select(*columns, value).limit(MODEL_ROWS + 1).collect()
    if len(rows) > MODEL_ROWS:
        raise ValueError(f"the model has over {MODEL_ROWS} rows; train it with a higher least count")
    return {r[0] if len(columns) == 1 else tuple(r[:-1]): r[-1] for r in rows}


def word_model(one: DataFrame, two: DataFrame, three: DataFrame) -> WordModel:
    return WordModel(collected(one, "w"), collected(two, "w1", "w2"), collected(three, "w1", "w2", "w3"))


def tag_model(pairs: DataFrame, tags: DataFrame, two: DataFrame, three: DataFrame) -> TagModel:
    return TagModel(collected(pairs, "word", "tag"), collected(tags, "tag"), collected(two, "w1", "w2"), collected(three, "w1", "w2", "w3"))


def stored_word_model(one: DataFrame, two: DataFrame, three: DataFrame) -> StoredWordModel:
    total, longest, size = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("w")), F.lit(20)), F.count("*")).first()
    return StoredWordModel(stored(one, "w"), stored(two, "w1", "w2"), stored(three, "w1", "w2", "w3"), total, longest, size)


def stored_tag_model(pairs: DataFrame, tags: DataFrame, two: DataFrame, three: DataFrame) -> StoredTagModel:
    t = collected(tags, "tag")
    if len(t) >= 1 << 16:
        raise ValueError("over 65,535 tags")
    ranked = pairs.withColumn("rank", (F.row_number().over(Window.partitionBy("word").orderBy("tag")) - 1).cast("string"))
    number = F.array_position(F.array(*map(F.lit, sorted(t))), F.col("tag")) - 1
    table = stored(ranked.select("word", "rank", F.shiftleft("n", 16).bitwiseOR(number).alias("n")), "word", "rank")
    return StoredTagModel(table, t, collected(two, "w1", "w2"), collected(three, "w1", "w2", "w3"), pairs.agg(F.count_distinct("word")).first()[0])


def texts_of(texts: pd.Series, most: int = 20_000) -> Iterator[list[str]]:
    """Runs of about `most` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n > most:
            yield run
            run, n = [], 0
    if run:
        yield run


def segment_strings(df: DataFrame, model: WordModel | StoredWordModel, column: str = "token", longest: int | None = None) -> DataFrame:
    """(column, words, score) of each distinct string."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [segment(t, m, longest) for run in texts_of(pdf[column]) for m in (held.value.local(run, longest),) for t in run]
            yield pd.DataFrame({column: pdf[column], "words": [w for w, _ in rows], "score": [s for _, s in rows]})

    return df.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, words array<string>, score double")


def adapted(df: DataFrame, model: WordModel, column: str = "token") -> DataFrame:
    """(column, clean, words, is_split): a token's words if it falls into two or more that are all known, else the bare token."""
    clean = df.select(column).distinct().withColumn("clean", strip_edges(F.lower(column)))
    cut = segment_strings(clean.where("clean <> ''"), model, "clean").select(F.col("clean").alias("c"), "words")
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = held.value.known({x for w in pdf["words"] for x in w})
            yield pdf.assign(ok=[len(w) >= 2 and all(x in known for x in w) for w in pdf["words"]])

    cut = cut.mapInPandas(run, "c string, words array<string>, ok boolean")
    ok = F.coalesce("ok", F.lit(False))
    bare = F.array(F.when(F.col("clean") == "", F.col(column)).otherwise(F.col("clean")))
    return clean.join(cut, F.col("clean") == F.col("c"), "left").select(column, "clean", F.when(ok, F.col("words")).otherwise(bare).alias("words"), ok.alias("is_split"))


def segment_and_tag(df: DataFrame, words: WordModel, tags: TagModel, column: str = "token") -> DataFrame:
    """(column, words, tags, split_score, single_score) of each distinct token: its words as `adapted` has them, tagged
    together; a valid split scores 1, a token that stays whole 0, and a single word is the baseline of 0."""
    cut = adapted(df, words, column).select(F.col(column).alias("_k"), "words", F.col("is_split").cast("double").alias("split_score"))
    got = tag_sentences(cut, tags, ("_k", "split_score"), "words")
    return got.select(F.col("_k").alias(column), F.col("tokens").alias("words"), "tags", "split_score", F.lit(0.0).alias("single_score"))


def full_pipeline(df: DataFrame, words: WordModel, tags: TagModel, column: str = "token") -> DataFrame:
    """(column, words, tags) of each distinct string without spaces: segmented, then tagged."""
    cut = segment_strings(df, words, column).select(F.col(column).alias("_k"), "words")
    return tag_sentences(cut, tags, ("_k",), "words").select(F.col("_k").alias(column), F.col("tokens").alias("words"), "tags")


def greedy_strings(df: DataFrame, vocab: dict | frozenset, column: str = "token", longest: int | None = None) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(frozenset(vocab))
    # No word is longer than the vocabulary's longest, so long strings cost no more a position than short ones.
    most = min(longest or math.inf, max(map(len, vocab), default=1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({column: pdf[column], "words": [greedy(t, held.value, most) for t in pdf[column]]})

    return df.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, words array<string>")


def tag_sentences(df: DataFrame, model: TagModel, keys: tuple[str, ...] = ("doc_id", "sent_id"), column: str = "tokens") -> DataFrame:
    """(keys, tokens, tags, score): the original words, tagged by their bare lower-case forms."""
    held = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keys, F.col(column).alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[tuple, tuple] = {}
        size = 0
        for pdf in batches:
            rows = []
            keyed = [tuple(t.lower().strip(",.?!;:'\"") for t in tokens) for tokens in pdf["tokens"]]
            model = held.value.local({w for key in keyed for w in key})
            for key in keyed:
                if key not in memory:
                    if size > 1_000_000:  # tokens, as sentences have any length
                        memory.clear()
                        size = 0
                    memory[key] = viterbi(list(key), model)
                    size += len(key)
                rows.append(memory[key])
            yield pdf.assign(tags=[t for t, _ in rows], score=[s for _, s in rows])

    return src.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in src.dtypes) + ", tags array<string>, score double")
