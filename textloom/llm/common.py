"""Helpers shared by the training-data operators.

Text reaches Python as Arrow batches whose size is bounded in bytes, so one very long document
costs one large batch and not a large batch of long documents.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 8 << 20
#: The white space that the contracts name, `[\x20\x09-\x0D]`; bytes.split() splits at the same six.
SPACE = " \t\n\x0b\x0c\r"
LIBC = ctypes.CDLL(None)


def bounded(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the plans built on this frame's session by BATCH_BYTES."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where the session has none, a temporary one that goes with the process, if one
    machine runs all (tests), and else an error: executors wouldn't share such a folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a checkpoint in the shared folder: short lineage, safe from lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of scratch()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow string column, and offsets (n + 1); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def tidy() -> None:
    """Give memory that is free again back to the system; allocators would keep it for each worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(LIBC, "malloc_trim", None):
        trim(0)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over these bytes without copying them; offsets have one more entry than rows."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes, never across texts, and words before each text."""
    return runs_of(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)


def runs_of(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values, never across texts, and runs before each text."""
    data = word
    inner = offsets[1:-1]
    prev = np.empty(len(data), bool)
    prev[:1] = False
    prev[1:] = word[:-1]
    prev[inner[inner < len(data)]] = False
    starts = np.flatnonzero(word & ~prev)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def each_batch(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches again, cut where their text buffers exceed `most` bytes."""
    for b in batches:
        n = max(1, -(-b.nbytes // most))
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 lowered."""
    up = (data >= 65) & (data <= 90)
    up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + up * np.uint8(32)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and non-ASCII bytes, as runs_of gives them."""
    low = data | np.uint8(32)
    return runs_of(((low >= 97) & (low <= 122)) | (data >= 128), offsets)


def coded_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for every word, and the distinct words (binary)."""
    lengths = ends - starts
    coded = binary_array(data[spread(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
