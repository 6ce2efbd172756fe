"""Add-k n-gram language models: counts, probabilities, sentence scores, perplexity, windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gram_rows
from .exchange import exchange

BOS, EOS, UNK = "<s>", "</s>", "<UNK>"
#: Largest exponent of a perplexity.
MOST_BITS = 50


@dataclass(frozen=True)
class LanguageModel:
    """n: order; k: smoothing; size: vocabulary with its three specials; probs: (w1 ... wn, n, ctx); contexts: (w1 ... wn-1, ctx);
    seqs: the sequences trained on; words: their number of words."""

    n: int
    k: float
    size: int
    vocab: DataFrame
    probs: DataFrame
    contexts: DataFrame
    seqs: DataFrame
    words: int


def vocabulary(rows: DataFrame, least: int = 1) -> DataFrame:
    """(w, n) of lower-cased tokens seen `least` times or more; specials are not in it."""
    return rows.select(F.explode("tokens").alias("w")).select(F.lower("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lowered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", F.transform("tokens", F.lower))


def train(rows: DataFrame, n: int, k: float = 0.05, least: int = 1, like: LanguageModel | None = None) -> LanguageModel:
    """Train on sentences with arrays `tokens`; one action counts the vocabulary, unless a model of the same rows is given. Contexts are summed where their n-grams lie, so counts are dealt twice and joined with nothing."""
    rows = rows.where(F.size("tokens") > 0)
    vocab = vocabulary(rows, least)
    seqs = lowered(rows) if least <= 1 else known(lowered(rows), vocab)
    names = [f"w{i + 1}" for i in range(n)]
    counts = gram_rows(seqs, F.col("seq"), n, BOS, EOS).groupBy(*names).agg(F.count("*").alias("n"))
    contexts = counts.groupBy(*names[:-1]).agg(F.sum("n").alias("ctx"))
    probs = counts.withColumn("ctx", F.sum("n").over(Window.partitionBy(*names[:-1])))
    size, words = (like.size - 3, like.words) if like else vocab.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return LanguageModel(n, k, size + 3, vocab, probs, contexts, seqs.select("seq"), words)


def known(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (doc_id, sent_id, seq) whose words outside the vocabulary became <UNK>."""
    flat = rows.select("doc_id", "sent_id", F.posexplode("seq").alias("pos", "w"))
    v = vocab.select(F.col("w").alias("v"))
    flat = flat.join(v, flat["w"] == v["v"], "left").select("doc_id", "sent_id", "pos", F.when(F.col("v").isNull(), UNK).otherwise(F.col("w")).alias("w"))
    return flat.groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("seq"))


def probability(model: LanguageModel, count: Column, ctx: Column) -> Column:
    return (F.coalesce(count, F.lit(0)) + F.lit(model.k)) / (F.coalesce(ctx, F.lit(0)) + F.lit(model.k * model.size))


def summed(models: tuple[LanguageModel, ...], rows: DataFrame, keys: tuple[str, ...], seen: bool, span: int | None = None, put: str | None = None) -> DataFrame:
    """exchange() by models of the same sentences."""
    m = models[0]
    return exchange(rows, None if seen else m.seqs, keys, tuple(x.n for x in models), m.k, m.size, m.words, BOS, EOS, span, put)


def log_prob(lp: str) -> Column:
    return F.when(F.col("n_tokens") == 0, float("-inf")).otherwise(F.col(lp))


def perplexity(lp: str) -> Column:
    return F.when(F.col("n_tokens") == 0, float("inf")).otherwise(F.pow(F.lit(2.0), F.least(-F.col(lp) / (F.col("n_tokens") + 1), F.lit(float(MOST_BITS)))))


def score(model: LanguageModel, rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_id"), seen: bool = False) -> DataFrame:
    """(keys, n_tokens, log_prob, ppl) of rows with arrays `seq`; words outside the model count like <UNK>; an empty row has -inf and inf.
    seen: these are the sentences the model was trained on, so they are read once."""
    lp = f"lp{model.n}"
    return summed((model,), rows, keys, seen).select(*keys, "n_tokens", log_prob(lp).alias("log_prob"), perplexity(lp).alias("ppl"))


def score_both(two: LanguageModel, three: LanguageModel, rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_id"), seen: bool = False) -> DataFrame:
    """(keys, n_tokens, and of each model its score and ppl) by a bigram and a trigram model of the same sentences, in one exchange."""
    of = [f(lp).alias(f"{name}_{what}") for lp, name in (("lp2", "bigram"), ("lp3", "trigram")) for f, what in ((log_prob, "score"), (perplexity, "ppl"))]
    return summed((two, three), rows, keys, seen).select(*keys, "n_tokens", *of)


def score_windows(model: LanguageModel, rows: DataFrame, span: int = 2, put: str | None = None, keys: tuple[str, ...] = ("doc_id", "sent_id"), seen: bool = False) -> DataFrame:
    """(keys, pos, n_tokens, log_prob, ppl) of local_windows by a bigram model, without making them: windows of a row share its n-grams."""
    return summed((model,), rows, keys, seen, span, put).select(*keys, "pos", "n_tokens", log_prob("lp2").alias("log_prob"), perplexity("lp2").alias("ppl"))


def local_windows(rows: DataFrame, span: int = 2, replacement: Column | None = None) -> DataFrame:
    """(doc_id, sent_id, pos, seq): for each token the words up to `span` before and behind it; the token itself gives way
    to a replacement (of its row) where that isn't null."""
    n = F.size("seq")
    cut = lambda i: F.slice("seq", F.greatest(i - span, F.lit(0)) + 1, F.least(i + span, n - 1) - F.greatest(i - span, F.lit(0)) + 1)
    put = (lambda i, s: s) if replacement is None else (lambda i, s: F.transform(s, lambda w, j: F.when(j == i - F.greatest(i - span, F.lit(0)), F.coalesce(replacement, w)).otherwise(w)))
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("pos"), put(i, cut(i)).alias("seq")))
    return rows.where(n > 0).select("doc_id", "sent_id", F.explode(windows).alias("x")).select("doc_id", "sent_id", "x.pos", "x.seq")
