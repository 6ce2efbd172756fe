"""Count models: vocabularies, n-grams, tags, deletion index. All are partial-then-final hash aggregations over arrays exploded in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gram_rows, words

START, END = "<START>", "<END>"


def word_arrays(tokenised: DataFrame) -> DataFrame:
    """Sentences whose array `words` is not empty."""
    return tokenised.withColumn("words", words("tokens")).where(F.size("words") > 0)


def count_grams(rows: DataFrame, seq: Column, n: int, start: str = START, end: str | None = END) -> DataFrame:
    """(w1 ... wn, n): occurrences of each n-gram."""
    return gram_rows(rows, seq, n, start, end).groupBy(*(f"w{i + 1}" for i in range(n))).agg(F.count("*").alias("n"))


def unigrams(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def bigrams(rows: DataFrame) -> DataFrame:
    """Word bigrams of the segmenter: each word with the one before it, from two starts, to one end."""
    return gram_rows(rows, F.col("words"), 2, START, END, starts=2).groupBy("w1", "w2").agg(F.count("*").alias("n"))


def adjacent(rows: DataFrame) -> DataFrame:
    """Adjacent word pairs without padding (the spelling model)."""
    return gram_rows(rows, F.col("words"), 2, START, None, starts=0).groupBy("w1", "w2").agg(F.count("*").alias("n"))


def deletions(w: Column) -> Column:
    """All strings that lack one character of w."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), (i - 1).cast("int")), F.substr(w, (i + 1).cast("int")))))


def deletion_index(vocab: DataFrame) -> DataFrame:
    """(variant, w): each deletion of each vocabulary word, once."""
    return vocab.where(F.length("w") > 0).select(F.explode(deletions(F.col("w"))).alias("variant"), "w")


def most_frequent_tag(pairs: DataFrame) -> DataFrame:
    """(word, tag) from counts (word, tag, n): the most frequent, ties to the smaller tag."""
    order = Window.partitionBy("word").orderBy(F.desc("n"), "tag")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("word", "tag")
