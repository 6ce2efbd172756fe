"""Count tables in files that all workers of a machine map: neither the driver nor a worker holds a model.

A table is dealt over shards by hash; each shard is sorted by hash and written once to the folder of spark.checkpoint.dir,
which the driver and all executors share. Keys are told apart by 80 bits of hash, as in exchange.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .exchange import KEYS, _hashes

SHARD_BITS = 6
WIDTH = 18


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which has to be a path that executors can open; a temporary one where one machine runs all."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where and urlparse(where).scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a mounted folder: workers map the model's files from it")
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{urlparse(where).path}/tables-{uuid.uuid4().hex}" if where else tempfile.mkdtemp(prefix="textloom-")
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def hashed(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of tuples of strings, given by columns."""
    codes, names = pd.factorize(np.concatenate([np.asarray(c, object) for c in columns]))
    lanes = tuple(pd.util.hash_array(names, hash_key=k, categorize=False) for k in KEYS)
    return _hashes(np.split(codes, len(columns)), lanes)


@dataclass
class Table:
    """A count for each tuple of strings, 0 where there is none."""

    path: str
    maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"path": self.path, "maps": {}}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.maps:
            f = f"{self.path}/{i}"
            m = os.path.getsize(f) // WIDTH if os.path.exists(f) else 0
            at = lambda kind, o: np.memmap(f, kind, "r", o, m) if m else np.zeros(0, kind)
            self.maps[i] = at(np.uint64, 0), at(np.int64, 8 * m), at(np.uint16, 16 * m)
        return self.maps[i]

    def get(self, *columns: list) -> np.ndarray:
        """The counts of many tuples at once."""
        out = np.zeros(len(columns[0]), np.int64)
        if not len(out):
            return out
        h, g = hashed(list(columns))
        shard = (h >> np.uint64(64 - SHARD_BITS)).astype(np.int64)
        for i in np.unique(shard):
            mine = np.flatnonzero(shard == i)
            keys, values, checks = self.shard(int(i))
            at = np.searchsorted(keys, h[mine])
            while len(mine):  # another key may share the first 64 bits
                there = at < len(keys)
                mine, at = mine[there], at[there]
                same = keys[at] == h[mine]
                mine, at = mine[same], at[same]
                hit = checks[at] == g[mine]
                out[mine[hit]] = values[at[hit]]
                mine, at = mine[~hit], at[~hit] + 1
        return out


def stored(df: DataFrame, *columns: str, value: str = "n") -> Table:
    """The table of a data frame whose rows have different `columns`; one action writes it."""
    path = folder(df.sparkSession)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                h, g = hashed([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
                shard = (h >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
                yield pa.record_batch([pa.array(shard), pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)), b.column(value).cast(pa.int64())], ["shard", "h", "g", "n"])

    def write(t: pa.Table) -> pa.Table:
        i = t.column("shard")[0].as_py()
        h, g, n = t.column("h").to_numpy().view(np.uint64), t.column("g").to_numpy().astype(np.uint16), t.column("n").to_numpy()
        order = np.argsort(h, kind="stable")
        with open(f := f"{path}/{i}.{uuid.uuid4().hex}", "wb") as out:
            for a in (h, n, g):
                out.write(a[order].tobytes())
        os.replace(f, f"{path}/{i}")
        return pa.table({"rows": pa.array([len(h)])})

    df.select(*columns, value).mapInArrow(hash_rows, "shard int, h long, g int, n long").groupBy("shard").applyInArrow(write, "rows long").collect()
    return Table(path)
