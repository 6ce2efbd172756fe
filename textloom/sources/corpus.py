"""Corpus sources: documents, sentences, tokens, passages, splits, CoNLL-U and bracketed trees; report sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_sentences, split_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """(doc_id, lang, source, sent_id, sentence). The language filter reaches the scan."""
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select("doc_id", "lang", "source", F.posexplode(split_sentences("text")).alias("sent_id", "sentence")).withColumn("sent_id", F.col("sent_id").cast("long"))


def tokenised(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """Sentences with their array of tokens."""
    return sentences(docs, lang).withColumn("tokens", split_tokens("sentence"))


def tokens(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """(doc_id, lang, source, sent_id, pos, token)."""
    return tokenised(docs, lang).select("doc_id", "lang", "source", "sent_id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def document_tokens(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """(doc_id, tokens): all tokens of a document in one array, sentence by sentence."""
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select("doc_id", F.flatten(F.transform(split_sentences("text"), split_tokens)).alias("tokens"))


def first_sentences(docs: DataFrame, n: int | None, lang: str | None = None) -> DataFrame:
    """The first n sentences in corpus order; None or 0: all."""
    rows = sentences(docs, lang)
    return rows.orderBy("doc_id", "sent_id").limit(n) if n else rows


def coin(seed: int, *cols: Column | str, modulus: int = 1000) -> Column:
    """A fixed draw from 0 ... modulus - 1 for each row, from integers alone."""
    key = F.lit(seed * 104_729)
    for c, by in zip(cols, (1_000_003, 10_007, 7_919), strict=False):
        key = key + (F.col(c) if isinstance(c, str) else c).cast("long") * by
    return F.pmod(key, F.lit(modulus))


def split_documents(docs: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with `is_train`: exactly floor(share * n) documents by a fixed draw.

    The counts of the 10,007 draws are summed; only the ids of the draw at the border are ranked, smallest first, for the
    last id that is in. Documents themselves are filtered by these two values where they are read. Rows of one id go together.
    """
    drawn = docs.withColumn("_draw", coin(seed, "doc_id", modulus=10_007))
    counts = drawn.groupBy("_draw").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_draw")  # at most 10,007 rows
    before = counts.select(F.col("_draw").alias("_d"), (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.floor(F.sum("_n").over(Window.partitionBy()) * share).alias("_quota"))
    before = before.join(counts.withColumnRenamed("_draw", "_d"), "_d").where("_before < _quota and _before + _n >= _quota")  # one row at most
    rank = F.row_number().over(Window.partitionBy("_d").orderBy("doc_id"))
    border = drawn.select("doc_id", "_draw").join(F.broadcast(before), F.col("_draw") == F.col("_d")).withColumn("_rank", rank)
    edge = border.where("_before + _rank = _quota").agg(F.max("_d").alias("_d"), F.max("doc_id").alias("_last"))  # one row
    inside = (F.col("_draw") < F.col("_d")) | ((F.col("_draw") == F.col("_d")) & (F.col("doc_id") <= F.col("_last")))
    return drawn.join(F.broadcast(edge)).withColumn("is_train", F.coalesce(inside, F.lit(False))).drop("_draw", "_d", "_last")


def passages(docs: DataFrame, source: str | None, least: int = 5, most: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_sentences, passage): a contiguous run of least ... most sentences of each document of a source, drawn by seed;
    the whole document if it is shorter. Detached punctuation is rejoined."""
    docs = docs.where(F.col("source") == source) if source else docs
    s = docs.select("doc_id", "source", split_sentences("text").alias("s")).where(F.size("s") > 0)
    want = F.lit(least) + coin(seed, "doc_id", modulus=most - least + 1)
    s = s.withColumn("want", F.least(want, F.size("s")).cast("int"))
    s = s.withColumn("start", F.pmod(coin(seed + 1, "doc_id", modulus=1_000_003), F.size("s") - F.col("want") + 1).cast("int"))
    text = F.array_join(F.slice("s", F.col("start") + 1, F.col("want")), " ")
    for mark in ",.!?":
        text = F.replace(text, F.lit(f" {mark}"), F.lit(mark))
    return s.select("doc_id", "source", F.col("want").cast("long").alias("n_sentences"), text.alias("passage"))


def read_conllu(texts: DataFrame, text: str = "value") -> DataFrame:
    """(sent_id, pos, id, word, lemma, upos, xpos, feats) of CoNLL-U texts: comments, ranges, empty nodes and lines without ten columns are skipped."""
    blocks = F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), r"\n[ \t]*\n")
    rows = texts.select(F.posexplode(blocks).alias("sent_id", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: F.split(x, "\t"))
    lines = F.filter(lines, lambda c: (F.size(c) == 10) & ~F.element_at(c, 1).rlike(r"^#|[-.]"))
    rows = rows.select("sent_id", F.posexplode(lines).alias("pos", "c"))
    names = ("id", "word", "lemma", "upos", "xpos", "feats")
    return rows.select(F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), *(F.col("c")[i].alias(n) for i, n in enumerate(names)))


def conllu_text(docs: DataFrame, lang: str = "es") -> DataFrame:
    """Sentences of a language written as CoNLL-U (value, doc_id), with features drawn from word endings."""
    feats = "case when w rlike 'as[.,]?$' then 'Gender=Fem|Number=Plur' when w rlike 'os[.,]?$' then 'Gender=Masc|Number=Plur' when w rlike 'a[.,]?$' then 'Gender=Fem|Number=Sing' when w rlike 'o[.,]?$' then 'Gender=Masc|Number=Sing' else '_' end"
    upos = "case when lower(w) in ('de', 'la', 'el', 'en', 'y', 'los', 'las', 'del', 'al', 'un', 'una') then 'DET' when w rlike 'ar[.,]?$' then 'VERB' else 'NOUN' end"
    line = F.expr(f"transform(tokens, (w, i) -> concat_ws('\\t', cast(i + 1 as string), w, lower(w), {upos}, '_', {feats}, '_', '_', '_', '_'))")
    rows = tokenised(docs, lang).select("doc_id", "sent_id", F.concat(F.lit("# sent\n"), F.array_join(line, "\n")).alias("block"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "block"))), lambda x: x["block"]), "\n\n").alias("value"))


def stream_tokens(spark: SparkSession, path: str, schema: str = "doc_id long, tok_idx long, token string", per_trigger: int = 1) -> DataFrame:
    """An ordered token stream from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row; infinities become null, which JSON can hold."""
    kinds = dict(df.dtypes)
    finite = [F.when(F.abs(F.col(c)) == math.inf, None).otherwise(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]
    df.select(*finite).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Model tables as a Parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame] | None:
    """The tables saved under path; None if any is missing, and the model is trained anew."""
    from pyspark.errors import AnalysisException

    try:
        return {n: spark.read.parquet(f"{path}/{n}") for n in names}
    except AnalysisException:
        return None
