"""Spelling: candidate generation by edits (A) and by symmetric deletion (B), non-word correction, real-word errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, is_alpha, strip_edges, with_case_of
from .counts import deletion_index, deletions

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SMOOTHING = 0.05


def edits(w: Column | str) -> Column:
    """All strings one deletion, transposition, replacement or insertion away, over a-z."""
    w = col(w)
    head = lambda i: F.substr(w, F.lit(1), i.cast("int"))
    tail = lambda i: F.substr(w, (i + 1).cast("int"))
    letters = F.array(*(F.lit(c) for c in LETTERS))
    n = F.length(w)
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(upto(n - 1), lambda i: F.concat(head(i), tail(i + 1)))
    swap = F.transform(upto(n - 2), lambda i: F.concat(head(i), F.substr(w, (i + 2).cast("int"), F.lit(1)), F.substr(w, (i + 1).cast("int"), F.lit(1)), tail(i + 2)))
    put = F.flatten(F.transform(upto(n - 1), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    add = F.flatten(F.transform(upto(n), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    return F.array_distinct(F.concat(cut, swap, put, add))


def candidates_a(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(q, cand): edits of each distinct query that are vocabulary words."""
    made = queries.select("q").distinct().select("q", F.explode(edits("q")).alias("cand")).where("cand <> q")
    return made.join(vocab.select(F.col("w").alias("cand")), "cand", "left_semi").select("q", "cand")


def candidates_b(queries: DataFrame, vocab: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(q, cand) by symmetric deletion: words whose deletion is the query, words that are a deletion of the query, and
    words that share a deletion with it. One equi-join: both sides are exploded to the strings they offer.
    """
    index = deletion_index(vocab) if index is None else index
    q = queries.select("q").distinct()
    offered = index.select("variant", "w", F.lit(False).alias("whole")).unionByName(vocab.select(F.col("w").alias("variant"), "w", F.lit(True).alias("whole")))
    asked = q.select("q", F.col("q").alias("variant"), F.lit(True).alias("own")).unionByName(
        q.where(F.length("q") > 0).select("q", F.explode(deletions(F.col("q"))).alias("variant"), F.lit(False).alias("own"))
    )
    return asked.join(offered, "variant").where("w <> q and not (own and whole)").select("q", F.col("w").alias("cand")).distinct()


#: Candidate generators by name: (queries, vocab) -> (q, cand).
STRATEGIES = {"A": candidates_a, "B": candidates_b}


def register(name: str, candidates) -> None:
    """Make a further generator available to correct_nonwords."""
    STRATEGIES[name] = candidates


def correct_nonwords(tokens: DataFrame, vocab: DataFrame, method: str = "B") -> DataFrame:
    """(token, fixed, method) of each distinct token of column `token`: the most frequent candidate, ties to the smaller, in the token's case."""
    q = tokens.select("token").distinct().withColumn("q", strip_edges(F.lower("token")))
    unknown = q.join(vocab.select(F.col("w").alias("q")), "q", "left_anti")
    found = STRATEGIES[method](unknown, vocab)
    order = Window.partitionBy("q").orderBy(F.desc("n"), "cand")
    best = found.join(vocab.select(F.col("w").alias("cand"), "n"), "cand").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("q", "cand")
    hit = q.join(best, "q", "left")
    return hit.select("token", F.coalesce(with_case_of(F.col("cand"), F.col("token")), "token").alias("fixed"), F.when(F.col("cand").isNull(), "none").otherwise(method).alias("method"))


def real_word_errors(targets: DataFrame, vocab: DataFrame, pairs: DataFrame, ratio: float = 8.0, keys: tuple[str, ...] = ("doc_id", "sent_id", "pos")) -> DataFrame:
    """(keys, token, cand, orig_p, cand_p): words that a neighbour by one edit fits far better.

    `targets`: keys, token, prev, next (`<s>` and `</s>` at the edges); `vocab`: (w, n); `pairs`: (w1, w2, n). Scores are
    computed once for each distinct (prev, word, next), then joined back.
    """
    size = vocab.agg(F.count("*").alias("v"))
    t = targets.withColumn("w", strip_edges(F.lower("token"))).withColumns({"p": F.lower("prev"), "x": F.lower("next")}).where(is_alpha("w") & (F.length("w") >= 2))
    triples = t.select("p", "w", "x").distinct()
    cands = candidates_b(triples.select(F.col("w").alias("q")), vocab)
    options = triples.join(cands.withColumnRenamed("q", "w"), "w").select("p", "w", "x", F.col("cand").alias("c"))
    options = options.unionByName(options.select("p", "w", "x").distinct().withColumn("c", F.col("w")))
    one = vocab.select(F.col("w").alias("u"), "n")
    two = pairs.select("w1", "w2", "n")
    s = F.lit(SMOOTHING)
    o = options.join(two.select(F.col("w1").alias("p"), F.col("w2").alias("c"), F.col("n").alias("pc")), ["p", "c"], "left")
    o = o.join(two.select(F.col("w1").alias("c"), F.col("w2").alias("x"), F.col("n").alias("cx")), ["c", "x"], "left")
    o = o.join(one.select(F.col("u").alias("p"), F.col("n").alias("np")), "p", "left").join(one.select(F.col("u").alias("c"), F.col("n").alias("nc")), "c", "left").na.fill(0).join(F.broadcast(size))
    prob = (F.col("pc") + s) / (F.col("np") + s * F.col("v")) * ((F.col("cx") + s) / (F.col("nc") + s * F.col("v")))
    o = o.withColumn("prob", prob).withColumn("orig", F.max(F.when(F.col("c") == F.col("w"), F.col("prob"))).over(Window.partitionBy("p", "w", "x")))
    order = Window.partitionBy("p", "w", "x").orderBy(F.desc(F.round(F.col("prob") / F.col("orig"), 9)), "c")
    best = o.where("c <> w").withColumn("_r", F.row_number().over(order)).where("_r = 1").where((F.col("prob") > F.col("orig")) & (F.col("prob") / F.greatest(F.lit(1e-12), "orig") >= ratio))
    return t.join(best.select("p", "w", "x", F.col("c").alias("cand"), F.col("orig").alias("orig_p"), F.col("prob").alias("cand_p")), ["p", "w", "x"]).select(*keys, "token", "cand", "orig_p", "cand_p")
