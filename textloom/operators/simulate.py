"""Typing simulation: merged words, corrupted words, trigger windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_alpha
from ..sources.corpus import coin


def inject_merges(tokens: DataFrame, p_mille: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, sent_id, token_idx, token, original_words, is_merge): a token stream in which a space between two
    alphabetic words was lost with probability p_mille / 1000.

    Hits in consecutive runs are taken alternately, as a typist who goes left to right would; so no word merges twice.
    """
    # Dealt and sorted once, by document: all windows follow that order.
    tokens = tokens.repartition("doc_id")
    sent = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    t = tokens.withColumn("next", F.lead("token").over(sent))
    draw = coin(seed, "doc_id", "sent_id", "pos") < p_mille
    t = t.withColumn("hit", F.coalesce(is_alpha("token") & is_alpha("next") & draw, F.lit(False)))
    t = t.withColumn("i", F.row_number().over(sent))
    t = t.withColumn("rank", F.col("i") - F.coalesce(F.max(F.when(~F.col("hit"), F.col("i"))).over(sent), F.lit(0)))
    t = t.withColumn("merge", F.col("hit") & (F.col("rank") % 2 == 1)).withColumn("eaten", F.coalesce(F.lag("merge").over(sent), F.lit(False)))
    t = t.where(~F.col("eaten"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id", "pos")) - 1
    return t.select(
        "doc_id", "sent_id", idx.cast("long").alias("token_idx"), F.when(F.col("merge"), F.concat("token", "next")).otherwise(F.col("token")).alias("token"),
        F.when(F.col("merge"), F.array("token", "next")).otherwise(F.array("token")).alias("original_words"), F.col("merge").alias("is_merge"),
    )


def corrupted(word: Column, kind: Column, spot: Column, letter: Column) -> Column:
    """A word with a letter deleted, two transposed, one replaced, one inserted, or `the` appended, by kind 0 ... 4; spot is 1-based."""
    head, tail = F.substr(word, F.lit(1), (spot - 1).cast("int")), F.substr(word, (spot + 1).cast("int"))
    own = F.substr(word, spot.cast("int"), F.lit(1))
    swap = F.concat(head, F.substr(word, (spot + 1).cast("int"), F.lit(1)), own, F.substr(word, (spot + 2).cast("int")))
    return F.when(kind == 0, F.concat(head, tail)).when(kind == 1, swap).when(kind == 2, F.concat(head, letter, tail)).when(kind == 3, F.concat(head, letter, own, tail)).otherwise(F.concat(word, F.lit("the")))


def corrupted_batch(vocab: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """(idx, word, corrupted): n vocabulary words of four letters or more by a fixed draw, each corrupted by idx % 5. Reports n rows: n is the feature."""
    drawn = vocab.where(is_alpha("w") & (F.length("w") >= 4)).withColumn("h", F.md5(F.concat(F.col("w"), F.lit(f"/{seed}"))))
    picked = drawn.orderBy("h", "w").limit(n).withColumn("idx", (F.row_number().over(Window.orderBy("h", "w")) - 1).cast("long"))
    spot = F.pmod(F.col("idx") * 7 + 3, F.length("w") - 1) + 1
    letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.col("idx") * 11 + 5, F.lit(26)) + 1).cast("int"), F.lit(1))
    return picked.select("idx", F.col("w").alias("word"), corrupted(F.col("w"), F.col("idx") % 5, spot, letter).alias("corrupted"))


def trigger_windows(outputs: DataFrame, every: int = 5, width: int = 8) -> DataFrame:
    """(doc_id, out_count, window) from (doc_id, token_idx, words): the last `width` output words whenever their number is a
    multiple of `every` at the end of an input token. A token of several words can jump a multiple."""
    doc = Window.partitionBy("doc_id").orderBy("token_idx")
    o = outputs.withColumn("done", F.sum(F.size("words")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    recent = F.flatten(F.collect_list("words").over(doc.rowsBetween(-(width - 1), 0)))
    o = o.withColumn("recent", recent)
    tail = F.slice("recent", F.greatest(F.size("recent") - width, F.lit(0)) + 1, width)
    return o.where((F.col("done") > 0) & (F.col("done") % every == 0) & (F.size("words") > 0)).select("doc_id", F.col("done").cast("long").alias("out_count"), tail.alias("window"))


def windows_in_row(rows: DataFrame, every: int = 5, width: int = 8) -> DataFrame:
    """The same for rows (doc_id, tokens) whose tokens are one output word each: cut from the array, without a shuffle."""
    n = F.size("tokens")
    cut = F.transform(F.sequence(F.lit(every), n, F.lit(every)), lambda i: F.struct(i.cast("long").alias("out_count"), F.slice("tokens", F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width))).alias("window")))
    return rows.where(n >= every).select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")


def tumbling_in_row(rows: DataFrame, every: int = 5) -> DataFrame:
    """tumbling_windows of rows (doc_id, tokens), without a shuffle."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / every)), lambda i: F.struct(i.cast("long").alias("window_id"), F.slice("tokens", (i * every + 1).cast("int"), every).alias("window")))
    return rows.where(F.size("tokens") > 0).select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")


def tumbling_windows(tokens: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, window_id, window): consecutive groups of `every` tokens."""
    rows = tokens.groupBy("doc_id", F.floor(F.col("token_idx") / every).alias("window_id")).agg(F.sort_array(F.collect_list(F.struct("token_idx", "token"))).alias("w"))
    return rows.select("doc_id", "window_id", F.transform("w", lambda x: x["token"]).alias("window"))
