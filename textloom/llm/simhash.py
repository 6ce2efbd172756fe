"""SimHash near-dedup over a grid of segment bit counts.

A fingerprint is embedded as the bit counts of its 2-bit segments. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so links (at most `radius` differing bits) lie within that
Manhattan distance: the join is a range join in the space of counts. Its grid has BLOCKS axes, blocks of segments;
points within the radius differ on at most `radius` axes, so they meet in the cell of the others. Within a cell, rows
are sorted by their total count; of those within `radius` of each other in it, the pairs within the Manhattan
distance are verified exactly. A cell gives each fingerprint at most one link, to the smallest one it reaches there:
the components are the same as with all pairs.

The members of a cell with more than CELL fingerprints are dealt once more over a finer grid of counts (FINE axes).
Where that is crowded too, as only many unlike neighbours of one point can make it, cells are of exact bits: EXACT
axes of four bits, whose cells hold 4,096 fingerprints at most, as all but 12 bits are given.

Defined results: a null or empty text, or one without words, has fingerprint 0 and links like any other; fewer words
than a shingle make one shingle of all; texts of any length are taken whole; equal texts share fingerprint and
component; rows of one doc_id are kept; an empty table gives an empty one; other columns are not read unless named in
`keep`. A null doc_id gets a null component unless the component holds another document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded, cut, each_batch, raw_text, table
from .graph import components

BLOCKS, FINE, EXACT, CELL = 6, 9, 16, 4096
#: Fingerprints of over 1 / HOT of all rows (fewer than HOT, whatever the input) are joined by a broadcast.
HOT = 1000
LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit value for each run of `counts` hashes (all positive): bits set in over half of the run."""
    parts = -(-counts // 255)
    run = np.repeat(np.arange(len(counts)), parts)
    first = np.cumsum(parts) - parts
    begin = (np.cumsum(counts) - counts)[run] + 255 * (np.arange(int(parts.sum())) - first[run])
    sums = np.empty((len(begin), 8, 8), np.int32)
    for j in range(8):  # eight byte-wide counters in each word; 255 rows can't overflow them
        lanes = np.add.reduceat(hashes >> np.uint64(j) & LANES, begin)
        sums[:, :, j] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(sums.reshape(-1, 64), first, axis=0)
    bits = (2 * total > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(column: pa.Array, words: int = 3) -> np.ndarray:
    """The SimHash of each text, unsigned."""
    data, offsets = raw_text(column)
    raw, at = data.tobytes(), offsets.tolist()
    hashes: list[int] = []
    counts = np.zeros(len(at) - 1, np.int64)
    for i in range(len(at) - 1):
        tokens = raw[at[i] : at[i + 1]].lower().split()
        if not tokens:
            continue
        if len(tokens) <= words:
            hashes.append(xxh64_intdigest(b" ".join(tokens), 42))
            counts[i] = 1
            continue
        text = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        hashes += [xxh64_intdigest(text[a:b], 42) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
        counts[i] = len(tokens) - words + 1
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        out[some] = majority(np.array(hashes, np.uint64), counts[some])
    return out


def segment_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, packed where the segments were."""
    ones = np.uint64(0x5555555555555555)
    return (x & ones) + (x >> np.uint64(1) & ones)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings (or of many from one), as segment_counts packs them."""
    low = np.uint64(0x3333333333333333)
    four = np.uint64(0x4444444444444444)
    out = np.zeros(np.broadcast(a, b).shape, np.int64)
    for shift in (np.uint64(0), np.uint64(2)):  # every second segment, so that each difference has four bits
        d = ((a >> shift & low) | four) - (b >> shift & low)  # 4 + a - b in 2 ... 6
        # |a - b|: of 2 and 6 the second bit is set and the last is not, of 3 and 5 the last one is.
        out += 2 * np.bitwise_count(d & np.uint64(0x2222222222222222) & ~(d << np.uint64(1))) + np.bitwise_count(d & np.uint64(0x1111111111111111))
    return out


def _cells(values: np.ndarray, blocks: int, radius: int, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and index of every row of `values`: one cell for each choice of blocks - radius blocks, `unit` bits wide at least."""
    cut_at = [64 // unit * i // blocks * unit for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(cut_at[i], cut_at[i + 1])) for i in range(blocks)]
    out = []
    for n, chosen in enumerate(combinations(masks, blocks - radius)):
        x = values & np.uint64(sum(chosen))
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x ^ x >> np.uint64(32)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.tile(np.arange(len(values)), len(out))


def link_cell(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of distinct unsigned fingerprints, each to the smallest one that it reaches in this cell.

    Of those within reach by their total, the Manhattan distance leaves a few to verify.
    """
    total = np.bitwise_count(values).astype(np.int64)
    order = np.argsort(total, kind="stable")
    values, total = values[order], total[order]
    counts = segment_counts(values)
    low = np.searchsorted(total, total - radius, "left").tolist()
    high = np.searchsorted(total, total + radius, "right").tolist()
    open_ = np.ones(len(values), bool)
    out = []
    for i in range(len(values)):
        if not open_[i]:
            continue
        open_[i] = False
        members, at = [i], 0
        while at < len(members):
            k = members[at]
            at += 1
            a, b = low[k], high[k]
            free = np.flatnonzero(open_[a:b]) + a
            if len(free):
                free = free[manhattan(counts[free], counts[k]) <= radius]
                hit = free[np.bitwise_count(values[free] ^ values[k]) <= radius]
                open_[hit] = False
                members += hit.tolist()
        if len(members) > 1:
            own = values[members].view(np.int64)
            root = int(own.min())
            out += [(x, root) for x in own.tolist() if x != root]
    return out


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("over", pa.bool_())])


def _linked(radius: int, most: int | None):
    """Links (a, b) from rows (cell, f) sorted by cell; members of a cell with more than `most` come back as (f, f, true)."""

    def batch(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], schema=PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, over = None, [], False
        for b in batches:
            c, f = (b.column(i).to_numpy() for i in (0, 1))
            starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(c))
            rows: list[tuple[int, int, bool]] = []
            # Runs of one row that don't touch the batch's ends hold no link.
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s == 1 and 0 < s and e < len(c):
                    continue
                if cell is not None and c[s] == cell:
                    held.append(f[s:e])
                else:
                    if cell is not None:
                        rows += finish(held, over)
                    cell, held, over = c[s], [f[s:e]], False
                n = sum(map(len, held))
                if most is not None and n > most:
                    rows += [(x, x, True) for h in held for x in h.tolist()]
                    held, over = [], True
            if rows:
                yield batch(rows)
        if cell is not None and (rows := finish(held, over)):
            yield batch(rows)

    def finish(held: list[np.ndarray], over: bool) -> list[tuple[int, int, bool]]:
        f = np.concatenate(held) if held else np.zeros(0, np.int64)
        if over:
            return [(x, x, True) for x in f.tolist()]
        f = np.unique(f.view(np.uint64))
        return [(a, b, False) for a, b in link_cell(f, radius)] if len(f) > 1 else []

    return run


def links(distinct: DataFrame, radius: int = 3, most: int = CELL) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column f that leave the same components as all links do."""
    schema = pa.schema([("cell", pa.int64()), ("f", pa.int64())])

    def grid(blocks: int, counted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = b.column(0).to_numpy().astype(np.int64)
                cells, rows = _cells(segment_counts(f.view(np.uint64)) if counted else f.view(np.uint64), blocks, radius, 2 if counted else 1)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(f[rows])], schema=schema)

        return run

    def dealt(df: DataFrame, blocks: int, counted: bool) -> DataFrame:
        return bounded(df).mapInArrow(grid(blocks, counted), "cell long, f long").repartition("cell").sortWithinPartitions("cell")

    out, left = None, distinct.select("f")
    for blocks, counted, bound in ((BLOCKS, True, most), (FINE, True, most), (EXACT, False, None)):
        found = dealt(left, blocks, counted).mapInArrow(_linked(radius, bound), "a long, b long, over boolean")
        found = cut(found) if bound else found
        own = found.where("not over").select("a", "b")
        out = own if out is None else out.unionByName(own)
        left = found.where("over").select(F.col("a").alias("f")).distinct()
        if not bound or left.isEmpty():
            return out.distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, radius: int = 3, most: int = CELL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, key, f, component_id) of every row: its fingerprint as a signed long, and the smallest key its fingerprint reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            f = fingerprints(b.column(b.num_columns - 1), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f)], names=[*b.schema.names[:-1], "f"])

    kept = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    src = bounded(df).select(*kept, F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = cut(src.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in src.dtypes[:-1]) + ", f long"))
    # One row a fingerprint: copies are summed within each task first, and never meet each other.
    classes = cut(rows.groupBy("f").agg(F.min("k").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes, radius, most))
    joined = roots.join(classes, roots["node"] == classes["f"]).select("f", "root", "least")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.drop("least").join(of_root, "root").select(F.col("f").alias("g"), "component_id")
    of_class = classes.join(linked, classes["f"] == linked["g"], "left").select("f", F.coalesce("component_id", "least").alias("component_id"), "n")
    total = classes.agg(F.sum("n")).first()[0] or 0
    of_class = of_class.withColumn("hot", F.col("n") * HOT > total).drop("n")
    # Rows of the hot fingerprints stay where they are; only the others are dealt by fingerprint.
    hot = F.broadcast(of_class.where("hot").select("f", "component_id"))
    out = rows.join(hot, "f").unionByName(rows.join(hot.select("f"), "f", "left_anti").join(of_class.where("not hot").drop("hot"), "f"))
    return out.select(*(F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)), F.col("k").alias(key), "f", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
