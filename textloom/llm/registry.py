"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, lines, mixing, neighbours, secrets, simhash, suffixes, toxicity, transport

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_stream": transport.op1_transport_stream,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_secrets": secrets.op4_secrets,
    "op5_simhash": simhash.op5_simhash,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language.op8_language_id,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL: dict[str, str] = {
    "op9_line_dedup": lines.OP9_SQL,
}
