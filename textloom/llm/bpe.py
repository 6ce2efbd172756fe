"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged, so every such
place in a text is a certain cut. Texts are cut there, equal fragments are encoded once, and the ids
are concatenated. Which pairs are certain is read from the vocabulary file; pairs at which a cut could
change what the tokenizer's pre-tokenizer sees are left out (see `cut_table`).

Defined results: a null or empty text gives an empty id list and an empty decoded text; repeated rows
give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_array, bounded, each_batch, raw_text, spread, table, tidy

#: Bytes of fragments and ids that a worker remembers; the memory is started afresh when it is full.
REMEMBER = 24 << 20
#: Bytes of text that are encoded together, and fragments that the library gets at once.
PART_BYTES, PART = 2 << 20, 4000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 stands for itself, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Bytes of every token id; added tokens stand as their text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in token)
    for i, content in added.items():
        out[i] = content
    return out


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """256 x 256 booleans: between these two bytes a cut is certain and harmless.

    Certain: no token holds the pair. Harmless: both bytes are ASCII, the left one is no white space (a
    pre-tokenizer looks ahead over white space), and the right one is no apostrophe after punctuation (it
    might begin a contraction that the whole text doesn't have there).
    """
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        inside[b[:-1], b[1:]] = True
    cut = ~inside
    cut[128:] = False
    cut[:, 128:] = False
    cut[[32, *range(9, 14), *range(28, 32)]] = False
    letter = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
    cut[~letter, ord("'")] = False
    return cut


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        tokens = vocabulary(path)
        self.cut = cut_table(tokens).ravel()
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Fragments in one Arrow array, their ids in another: a few bytes a fragment, where objects would take hundreds."""
        self.known, self.known_ids, self.known_len = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def fragments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the fragments (n + 1), and how many fragments precede each text."""
        at = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            at[1:-1] = self.cut[data[:-1].astype(np.int32) * 256 + data[1:]]
        at[offsets] = True
        bounds = np.flatnonzero(at)
        return bounds, np.searchsorted(bounds, offsets)

    def encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these fragments by the library, one after the other, and how many each has."""
        flat, sizes = [], []
        for i in range(0, len(pieces), PART):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + PART].cast(pa.string()).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1].sum())))
        return np.concatenate([self.known_ids, *flat]), np.concatenate([self.known_len, *sizes])

    def encode_fragments(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all remembered fragments, where those of each given (distinct) fragment start, and how many it has."""
        if self.known.nbytes + self.known_ids.nbytes + self.known_len.nbytes > REMEMBER:
            self.forget()
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(at.is_null())
        at = at.to_numpy(zero_copy_only=False).astype(float)
        at[np.isnan(at)] = np.arange(len(self.known), len(self.known) + len(new))
        self.known_ids, self.known_len = self.encode_new(new)
        self.known = pa.concat_arrays([self.known, new])
        at = at.astype(np.int64)
        return self.known_ids, (np.cumsum(self.known_len) - self.known_len)[at], self.known_len[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their offsets."""
        bounds, before = self.fragments(data, offsets)
        coded = binary_array(data, bounds).dictionary_encode()
        flat, starts, lengths = self.encode_fragments(coded.dictionary)
        codes = coded.indices.to_numpy()
        per = lengths[codes]
        total = np.concatenate([[0], np.cumsum(per)])
        return flat[spread(starts[codes], per)], total[before]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of these ids; bytes that are no UTF-8 become the replacement character."""
        per = self.token_len[ids]
        data = self.token_bytes[spread(self.token_at[ids], per)].tobytes()
        at = np.concatenate([[0], np.cumsum(per)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encode_decode(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(key, ids array<int>, decoded string) of every row: the ids of the whole text, and the text they decode to."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in each_batch(batches, PART_BYTES):
            ids, offsets = codec.encode(*raw_text(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(codec.decode(ids, offsets), pa.string())], schema=schema)
            del ids, offsets, lists
            tidy()

    return (
        bounded(df)
        .select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
        .mapInArrow(run, "k long, ids array<int>, decoded string")
        .withColumnRenamed("k", key)
    )


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(key, decoded string) of rows that hold ids; a null list decodes to an empty text."""
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("k", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            rows = [x or [] for x in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            flat = np.array([x for r in rows for x in r], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.decode(flat, offsets), pa.string())], schema=schema)

    return (
        bounded(df)
        .select(F.col(key).cast("long").alias("k"), F.col(ids).cast("array<int>").alias("i"))
        .mapInArrow(run, "k long, decoded string")
        .withColumnRenamed("k", key)
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_decode(table(spark, sf_dir, "documents")))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
