"""Line dedup with a sharded minimal perfect hash.

Keys of long lines are hashed; keys found in many documents are dealt to shards by their hash. Each shard gets a
minimal perfect hash over its keys, and arrays beside it: fingerprint, document count and last document of each
key. Documents look their lines up in the arrays; no line is joined with a line.

If all shards together fit `BROADCAST_BYTES` (measured, not guessed), every worker gets the arrays and documents
are probed where they are read. Otherwise the documents' line hashes are dealt to the shards and stream past their
arrays; a shard with more than PROBES of them is replicated over as many tasks as that takes. The drop lists are
joined back to the documents. Both ways give the same.

Defined results: a null or empty text is one empty line; rows of one doc_id count as one document; a key's lines
stay in all rows of the largest doc_id that holds it; a row without an id counts for no key and keeps no common line;
texts of any length are taken whole; an empty table gives an empty table; other columns are carried if named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bounded, cut, each_batch, raw_text, table

BROADCAST_BYTES = 32 << 20
SHARD_KEYS = 50_000
#: Line hashes that stream past one copy of a shard.
PROBES = 2_000_000
STRIP = SPACE.encode()


def key_of(line: bytes, least: int) -> bytes | None:
    """The line's key, if it has `least` code points or more."""
    key = line.strip(STRIP)
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return key.lower()


def hashes(key: bytes) -> tuple[int, int]:
    """Two independent signed 64-bit halves: where the key goes, and its fingerprint."""
    x = xxhash.xxh3_128_intdigest(key)
    a, b = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys.

    At each level a bit array marks the places that exactly one remaining key falls on; the others go on to the next
    level. A key's index is the number of bits before its own.
    """

    GAMMA, LEVELS = 2, 40

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.unpackbits(bits, count=int(self.first[-1])) if len(bits) else np.zeros(0, np.uint8)
        self.flat = flat.astype(bool)
        self.rank = np.concatenate([[0], np.cumsum(flat)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, sizes, parts = keys, [], []
        for level in range(cls.LEVELS):
            if not len(rest):
                break
            m = cls.GAMMA * len(rest)
            at = (_mixed(rest, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(alone)
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("keys of a perfect hash must be distinct")
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(parts)) if parts else np.zeros(0, np.uint8))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or another key's index for one that isn't in the set."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.sizes.tolist()):
            at = self.first[level] + (_mixed(keys[open_], level) % np.uint64(m)).astype(np.int64)
            hit = self.flat[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


#: The arrays beside a perfect hash: fingerprint, document count (at most what fits) and last document.
ARRAYS = (("f", np.int64), ("n", np.uint32), ("last", np.int64))
INDEX = "shard int, n long, sizes binary, bits binary, prints binary, counts binary, lasts binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of INDEX: one, and a further one for keys whose first halves collide."""
    turn = pdf.groupby("h").cumcount()
    rows = []
    for t in range(int(turn.max()) + 1):
        own = pdf[turn == t]
        keys = own["h"].to_numpy(np.int64)
        mph = PerfectHash.build(keys)
        at = mph.index(keys)
        arrays = []
        for name, kind in ARRAYS:
            a = np.empty(len(keys), kind)
            a[at] = np.minimum(own[name].to_numpy(np.int64), np.iinfo(kind).max)
            arrays.append(a.tobytes())
        rows.append((int(pdf["shard"].iloc[0]), len(keys), mph.sizes.tobytes(), mph.bits.tobytes(), *arrays))
    return pd.DataFrame(rows, columns=["shard", "n", "sizes", "bits", "prints", "counts", "lasts"])


class Shard:
    """The arrays of one shard, and those of its colliding keys."""

    def __init__(self, layers: list[tuple[bytes, ...]]) -> None:
        self.layers = [(PerfectHash(np.frombuffer(x[0], np.int64), np.frombuffer(x[1], np.uint8)), *(np.frombuffer(y, kind) for y, (_, kind) in zip(x[2:], ARRAYS, strict=True))) for x in layers]

    def lookup(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: not a common line) and last document of each key."""
        count, last = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for mph, prints, counts, lasts in self.layers:
            at = mph.index(h)
            hit = np.flatnonzero(at >= 0)
            hit = hit[prints[at[hit]] == f[hit]]
            count[hit], last[hit] = counts[at[hit]], lasts[at[hit]]
        return count, last


def build_index(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = 40, documents: int = 5, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """INDEX, one row a shard, over the keys of `least` code points or more in `documents` documents or more; the number
    of shards, and of pairs (key, document) of all long lines."""
    schema = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("k", pa.int64())])
    seen = df.sparkSession.sparkContext.accumulator(0)  # only says how many tasks a shard gets; repeated tasks may add to it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            out: tuple[list, list, list] = ([], [], [])
            for i, k in enumerate(b.column(0).to_pylist()):
                keys = {key_of(x, least) for x in raw[at[i] : at[i + 1]].split(b"\n")} - {None}
                for h, f in map(hashes, keys):
                    out[0].append(h)
                    out[1].append(f)
                    out[2].append(k)
            seen.add(len(out[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    lines = bounded(df).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null").mapInArrow(run, "h long, f long, k long")
    # Pairs (key, document) are dealt by both, so a hot key is spread; its count is summed within each task before it is dealt by key.
    common = lines.dropDuplicates(["h", "f", "k"]).groupBy("h", "f").agg(F.count("*").alias("n"), F.max("k").alias("last")).where(F.col("n") >= documents)
    common = cut(common)
    shards = max(1, -(-common.count() // shard_keys))
    common = common.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return cut(common.groupBy("shard").applyInPandas(_pack, INDEX)), shards, seen.value


def _lines(raw: bytes, least: int) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """All lines, the numbers of those that have a key, and their hashes."""
    lines = raw.split(b"\n")
    keys = [(i, k) for i, k in enumerate(key_of(x, least) for x in lines) if k is not None]
    return lines, [i for i, _ in keys], [hashes(k) for _, k in keys]


def _dropped(shards: dict[int, Shard], n: int, h: np.ndarray, f: np.ndarray, k: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Which lines go, from their hashes and their document's id; none: that there is no id."""
    out = np.zeros(len(h), bool)
    which = h % n
    for s in np.unique(which).tolist():
        if s in shards:
            own = np.flatnonzero(which == s)
            out[own] = _gone(shards[s], h[own], f[own], k[own], none[own])
    return out


def _gone(shard: Shard, h: np.ndarray, f: np.ndarray, k: np.ndarray, none: np.ndarray) -> np.ndarray:
    count, last = shard.lookup(h, f)
    return (count > 0) & (none | (last != k))


def _heat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, n): documents that hold keys of a shard, summed over the keys."""
    for b in batches:
        n = [int(np.frombuffer(x.as_py(), ARRAYS[1][1]).sum(dtype=np.int64)) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["shard", "n"])


def drop_common_lines(
    df: DataFrame, text: str = "text", key: str = "doc_id", least: int = 40, documents: int = 5, keep: tuple[str, ...] = (), fits: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, most: int = PROBES
) -> DataFrame:
    """(kept columns, key, text without its common lines, n_lines, n_dropped) of every row."""
    spark = df.sparkSession
    index, shards, pairs = build_index(df, text, key, least, documents, shard_keys)
    names = ("sizes", "bits", "prints", "counts", "lasts")
    size = index.agg(F.sum(sum((F.length(x) for x in names[1:]), F.length(names[0])).cast("long"))).first()[0]
    src = bounded(df).select(*keep, F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    kept = [f"`{n}` {t}" for n, t in src.dtypes]
    result = ", ".join(kept) + ", n_lines long, n_dropped long"

    def kept_lines(raw: bytes, drop: set[int], lines: list[bytes]) -> bytes:
        return b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else raw

    if (size or 0) <= fits:
        layers: dict[int, list] = {}
        for r in index.collect():
            layers.setdefault(r["shard"], []).append(tuple(bytes(r[x]) for x in names))
        held = spark.sparkContext.broadcast(layers)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = {s: Shard(x) for s, x in held.value.items()}
            for b in each_batch(batches):
                data, offsets = raw_text(b.column(b.num_columns - 1))
                raw, at = data.tobytes(), offsets.tolist()
                rows = [_lines(raw[x:y], least) for x, y in zip(at, at[1:], strict=False)]
                pairs = np.array([p for r in rows for p in r[2]], np.int64).reshape(-1, 2)
                keys, each = b.column(b.num_columns - 2), [len(r[2]) for r in rows]
                ids, none = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
                gone = _dropped(arrays, shards, pairs[:, 0], pairs[:, 1], np.repeat(ids, each), np.repeat(none, each))
                out, n, i = [], [], 0
                for j, (lines, numbers, _) in enumerate(rows):
                    drop = {numbers[x] for x in np.flatnonzero(gone[i : i + len(numbers)]).tolist()}
                    i += len(numbers)
                    out.append(kept_lines(raw[at[j] : at[j + 1]], drop, lines).decode())
                    n.append(len(drop))
                more = [pa.array(out, pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names, "n_lines", "n_dropped"])

        return src.mapInArrow(probe, result)

    # Too large to send around: line hashes go to the shards, and lists of lines to drop come back by document. A row
    # without an id is known by its text's hash.
    row = [F.col(key).alias("k"), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("g")]
    copies = np.ones(shards, np.int64)
    hot = index.select("shard", "n", "counts").mapInArrow(_heat, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row a shard
    for r in hot:
        copies[r["shard"]] = max(1, -(-(r["n"] + pairs // shards) // most))
    schema = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), *((x, pa.int64()) for x in ("k", "g", "h", "f")), *((x, pa.binary()) for x in names)])
    flat = "shard int, salt int, k long, g long, h long, f long, " + ", ".join(f"{x} binary" for x in names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(2))
            raw, at = data.tobytes(), offsets.tolist()
            rows = {(k, g, *p) for i, (k, g) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for p in _lines(raw[at[i] : at[i + 1]], least)[2]}
            k, g, h, f = ([x[i] for x in rows] for i in range(4))
            shard = np.array(h, np.int64) % shards
            salt = np.array([hash((a, c)) for a, c in zip(k, g, strict=True)], np.int64) % copies[shard]
            cols = [pa.array(shard.astype(np.int32)), pa.array(salt.astype(np.int32)), *(pa.array(x, pa.int64()) for x in (k, g, h, f)), *(pa.nulls(len(h), pa.binary()) for _ in names)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for salt in range(int(copies[r["shard"]])):
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r | {"salt": salt}], schema=schema)

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, layers, one = None, [], None
        for b in batches:
            shard, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
            head = b.column(6).is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])]))[: len(shard)]
            out = [np.zeros(0, np.int64)]
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(shard)).tolist(), strict=True):
                if own != (shard[s], salt[s]):
                    own, layers, one = (shard[s], salt[s]), [], None
                for i in range(s, s + int(head[s:e].sum())):  # a shard's arrays come before its hashes
                    layers.append(tuple(b.column(6 + j)[i].as_py() for j in range(len(names))))
                    s, one = i + 1, None
                if s < e and layers:
                    one = one or Shard(layers)
                    k, h, f = (b.column(i).slice(s, e - s) for i in (2, 4, 5))
                    none = k.is_null().to_numpy(zero_copy_only=False)
                    out.append(s + np.flatnonzero(_gone(one, h.to_numpy(), f.to_numpy(), k.fill_null(0).to_numpy(), none)))
            yield b.take(pa.array(np.concatenate(out))).select(["k", "g", "h", "f"])

    probes = src.select(*row, F.col(text).alias("t")).mapInArrow(hashed, flat)
    streams = probes.unionByName(index.select("shard", *names).mapInArrow(copied, flat))
    gone = streams.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("sizes").isNull()).mapInArrow(lookup, "k long, g long, h long, f long")
    gone = gone.groupBy(F.col("k").alias("\x00k"), F.col("g").alias("\x00g")).agg(F.collect_set(F.struct("h", "f")).alias("\x00gone"))
    src = src.withColumn("\x00of", row[1])
    joined = src.join(gone, F.col(key).eqNullSafe(F.col("\x00k")) & F.col("\x00of").eqNullSafe(F.col("\x00g")), "left").drop("\x00k", "\x00g", "\x00of")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(b.num_columns - 2))
            raw, at = data.tobytes(), offsets.tolist()
            out, n, total = [], [], []
            for i, listed in enumerate(b.column(b.num_columns - 1).to_pylist()):
                lines, numbers, pairs = _lines(raw[at[i] : at[i + 1]], least)
                listed = {(x["h"], x["f"]) for x in listed or ()}
                drop = {j for j, p in zip(numbers, pairs, strict=True) if p in listed}
                out.append(kept_lines(raw[at[i] : at[i + 1]], drop, lines).decode())
                n.append(len(drop))
                total.append(len(lines))
            more = [pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *more], names=[*b.schema.names[:-1], "n_lines", "n_dropped"])

    return joined.mapInArrow(apply, result)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.i, c.key IS NOT NULL AND c.last <> k.doc_id AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
