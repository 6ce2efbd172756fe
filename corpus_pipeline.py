"""Corpus preparation: language ID, line dedup, near-dedup, mixing, tokenising.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; each works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import digest, encode_decode
from textloom.llm.common import crc_of_id, discard, scratch, table
from textloom.llm.language import identify, train
from textloom.llm.lines import drop_common_lines
from textloom.llm.mixing import WORD, mix
from textloom.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose words share no language to this extent is rejected, as is one without a letter.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (`und`, or no language with LEAST_SHARE of the posterior mass) go; a null lang gets the predicted one.

    Null and empty texts, and those without a letter, are `und` and go. Rows are judged one by one, so repeated ones stay
    or go together; ties go to the label that sorts first. Without any labelled row all texts are `und`.
    """
    docs = docs.select(*COLUMNS)
    model = train(docs.where(crc_of_id() % 5 != 0))
    found = identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their common lines; n_chars follows where it was known.

    All rows stay, those of null or empty texts unchanged (null: empty). Rows of one doc_id are one document; a row
    without an id keeps no common line and counts for none.
    """
    found = drop_common_lines(docs, keep=("lang", "source", "n_chars"))
    chars = F.when((F.col("n_dropped") > 0) & F.col("n_chars").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts stays: that with the smallest id, one without an id only if none has one.

    Of rows with one id and unlike texts each is judged by its own text, so none goes for another's sake; of those alike
    in everything one stays. Ties in the id go to the smaller hash of the text, then of the other columns. Null and empty
    texts, and those without a word, are one group.
    """
    # Hashes that name a text, and a row: nulls are told from absent values.
    others = [x for c in ("doc_id", "lang", "source", "n_chars") for x in (F.col(c).isNull(), F.col(c))]
    docs = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), F.xxhash64(*others, F.col("text").isNull()).alias("_r"))
    found = near_duplicates(docs, key="_t", keep=("doc_id", "_r"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t", "_r")).alias("x")).select("x._t", "x._r")
    return docs.join(first, ["_t", "_r"], "left_semi").dropDuplicates(["_t", "_r"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, which may be never.

    Null, empty and wordless texts have size 0 and are taken floor(r) times, or once more, for their source's ratio r.
    A null source is a source of its own; rows without an id are told apart by their texts; repeated rows are drawn apart.
    """
    docs = docs.select(*COLUMNS, F.coalesce("doc_id", F.xxhash64("text")).alias("_k"))
    taken = mix(docs, key="_k")
    # Only ids and sizes are drawn; rows of one id (there are hardly any) meet by their order of source and size.
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    docs = docs.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("source", size, F.xxhash64("text"))))
    taken = taken.select("_k", "copies", F.row_number().over(Window.partitionBy("_k").orderBy("source", "size", "copies")).alias("_n")).where("copies > 0")
    return docs.join(taken, ["_k", "_n"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row that is left; a null text is an empty one."""
    return digest(encode_decode(docs))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokenise", tokenise)]

#: The first and the fourth stage can't be written in SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
