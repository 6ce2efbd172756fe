"""Approximate nearest neighbours: NN-descent graphs, searched greedily.

Equal vectors form one class, so copies never crowd a list. Classes are dealt over shards by a hash of their id, and a
task holds one shard at a time, so that no pair of nodes is ever a row of a shuffle. A shard's nodes get first neighbours
from a few random orders of the space (sign codes of random hyperplanes): blocks of adjacent rows are compared whole.
NN-descent then lets each node's neighbours and reverse neighbours compare each other, which finds neighbours of
neighbours. Every query is searched in every shard: it starts at the nodes beside it in the random orders, at those of
largest norm and, in its own shard, at itself, keeps a beam, and expands the best unexpanded nodes until its beam holds
none. What a shard has found is scored on the original vectors, in double precision; the best of all shards count.

Nearness is the inner product. While a graph is built, vectors get one more component that makes their norms equal, so
that nearness in the graph follows it; graph and beams use single precision, on vectors scaled by the largest norm.

A beam that is wide enough for one table may be too narrow for a larger one, and nodes that are on nobody's list can't
be met. So a fixed number of queries is searched first and held against all vectors: while too few of their nearest are
found the beam grows by half, and once it is eight times as wide the degree is doubled. All queries are then searched once.

Graphs cost time in proportion to the rows, searches in proportion to queries times shards. Only the probes' vectors and
scores are collected and nothing of the data's size is broadcast; list lengths, beam, blocks and shards are parameters.

Defined results: null vectors, zero vectors, vectors with null or non-finite components and, of the others, those
that haven't the most frequent length (the larger of equally frequent ones) take no part; rows of one id count once
(the smallest vector); ties go to the smaller id; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, cut, table


@dataclass(frozen=True)
class Settings:
    #: Neighbours a node keeps, and how many of them (each way) take part in a descent round.
    degree: int = 32
    joined: int = 24
    #: Random orders of the first lists, rows of a block, descent rounds.
    orders: int = 6
    block: int = 256
    rounds: int = 2
    #: Beam of a query in a shard, all of which is expanded in the end; nodes expanded at a time.
    beam: int = 64
    step: int = 8
    #: Nodes of largest norm at which every search starts too (large inner products may lie far from the query itself), and
    #: nodes beside the query in each random order.
    entries: int = 64
    beside: int = 8
    #: Most list entries and bytes of vectors of a shard; tables of over `few` nodes have up to `spread` smaller shards.
    listed: int = 1 << 21
    shard_bytes: int = 32 << 20
    few: int = 4096
    spread: int = 8
    #: Queries whose results are held against all vectors, and the recall below which the beam is widened (an estimate
    #: from so many probes strays by about 0.01, so 0.9 is held with a margin).
    probes: int = 128
    least: float = 0.93
    seed: int = 5


def ranks(owner: np.ndarray) -> np.ndarray:
    """Of rows sorted by owner: the position of each among its owner's."""
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))


def best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Indices of each owner's `most` best others, each once; ties to the smaller other."""
    order = np.lexsort((-score, other, owner))
    o, x = owner[order], other[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    order = order[fresh]
    order = order[np.lexsort((other[order], -score[order], owner[order]))]
    return order[ranks(owner[order]) < most]


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, type]:
    """(id, key128, vec binary, norm2) of the rows that take part."""
    wide = dict(df.dtypes)[vector] != "array<float>"
    kind = np.float64 if wide else np.float32
    src = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>" if wide else "array<float>").alias("v")).where("id is not null and v is not null")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    d = src.where(whole).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = d[0] if d else 0
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary()), ("norm2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(sizes == d))
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d) if d else np.zeros((0, 0), kind)
            exact = flat.astype(np.float64)
            norm = np.einsum("ij,ij->i", exact, exact)
            ok = np.isfinite(norm) & (flat != 0).any(axis=1)
            flat = flat[ok] + kind(0)  # -0.0 becomes 0.0, so that equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(norm[ok])], schema=schema)

    rows = bounded(src).mapInArrow(run, "id long, vec binary, norm2 double")
    rows = rows.groupBy("id").agg(F.min(F.struct("vec", "norm2")).alias("r")).select("id", "r.*")
    return cut(rows.withColumn("key128", F.md5("vec"))), kind


def lists_of(ids: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (-1: none) and scores the `most` best, each once, best first."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
    s[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    s[ids < 0] = -np.inf
    if s.shape[1] > most:
        at = np.argpartition(-s, most - 1, axis=1)[:, :most]
        ids, s = np.take_along_axis(ids, at, 1), np.take_along_axis(s, at, 1)
    at = np.argsort(-s, axis=1, kind="stable")
    ids, s = np.take_along_axis(ids, at, 1), np.take_along_axis(s, at, 1)
    ids[s == -np.inf] = -1
    return ids, s


def paired(owner: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order of rows by owner, then by a number below 2**32."""
    return np.argsort(owner.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64), kind="stable")


def falling(s: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 that fall as single-precision scores rise."""
    b = s.astype(np.float32).view(np.uint32)
    return np.where(b >> 31, b, ~(b | np.uint32(1 << 31)))


#: Pairs that are merged into the lists at a time; products of a batch of hoods; lists merged at a time.
PAIRS, PRODUCTS, LISTS = 2_000_000, 1_200_000, 8192


def improve(ids: np.ndarray, score: np.ndarray, u: np.ndarray, x: np.ndarray, s: np.ndarray) -> None:
    """Takes pairs (u, x) of this score into the lists of u, in place."""
    k = ids.shape[1]
    order = paired(u, falling(s))
    u, x, s = u[order], x[order], s[order]
    rank = ranks(u)
    near = rank < 2 * k  # a pair may come a few times
    u, x, s, rank = u[near], x[near], s[near], rank[near]
    first = np.flatnonzero(rank == 0)
    row = np.cumsum(rank == 0) - 1
    for i in range(0, len(first), LISTS):
        own = u[first[i : i + LISTS]]
        a, z = first[i], first[i + LISTS] if i + LISTS < len(first) else len(u)
        c = np.full((len(own), k + 1 + rank[a:z].max()), -1, np.int32)
        cs = np.full(c.shape, -np.inf, np.float32)
        c[:, :k], cs[:, :k] = ids[own], score[own]
        c[row[a:z] - i, k + rank[a:z]], cs[row[a:z] - i, k + rank[a:z]] = x[a:z], s[a:z]
        ids[own], score[own] = lists_of(c, cs, k)


def turned(ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each node the `most` nearest nodes that have it on their list (-1: none)."""
    u, at = np.nonzero(ids >= 0)
    x = ids[u, at]
    order = paired(x, falling(score[u, at]))
    u, x = u[order], x[order]
    rank = ranks(x)
    near = rank < most
    out = np.full((len(ids), most), -1, np.int32)
    out[x[near], rank[near]] = u[near]
    return out


def levelled(v: np.ndarray) -> np.ndarray:
    """Vectors scaled by the largest norm, with one more component that makes their norms 1 (single precision)."""
    v = v.astype(np.float64)
    v /= np.abs(v).max()  # squares stay finite
    norm = np.einsum("ij,ij->i", v, v)
    top = norm.max()
    return (np.hstack([v, np.sqrt(np.maximum(0, top - norm))[:, None]]) / np.sqrt(top)).astype(np.float32)


class Orders:
    """Random orders of a shard's nodes: by sign codes of hyperplanes, then along one more direction."""

    def __init__(self, h: np.ndarray, settings: Settings) -> None:
        self.bits = (len(h) // settings.block).bit_length()
        self.planes = np.random.default_rng(settings.seed).normal(size=(settings.orders, self.bits + 1, h.shape[1])).astype(np.float32)
        self.keys, self.orders = [], []
        for t in range(settings.orders):
            key = self.key(h, t)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.orders.append(order.astype(np.int32))

    def key(self, h: np.ndarray, t: int) -> np.ndarray:
        p = (h @ self.planes[t].T).astype(np.float64)
        along = p[:, self.bits]
        return ((p[:, : self.bits] > 0) << np.arange(self.bits)).sum(axis=1) + 0.5 + 0.5 * along / (1 + np.abs(along))

    def beside(self, h: np.ndarray, most: int) -> np.ndarray:
        """Nodes next to these vectors in the orders; a row for each vector."""
        out = []
        for t, (key, order) in enumerate(zip(self.keys, self.orders, strict=True)):
            at = np.searchsorted(key, self.key(h, t))[:, None] + np.arange(-(most // 2), most - most // 2)
            out.append(order[np.clip(at, 0, len(order) - 1)])
        return np.concatenate(out, axis=1)


def descend(h: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Lists and scores of the nearest neighbours of each row of h, found by NN-descent."""
    n, k, block = len(h), settings.degree, settings.block
    ids, score = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32)
    for order in Orders(h, settings).orders:
        pieces = max(1, round(n / block))
        for i in range(pieces):
            own = order[n * i // pieces : n * (i + 1) // pieces]
            m = min(k, len(own) - 1)
            if m < 1:
                continue
            s = h[own] @ h[own].T
            np.fill_diagonal(s, -np.inf)
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            ids[own], score[own] = lists_of(np.hstack([ids[own], own[near]]), np.hstack([score[own], np.take_along_axis(s, near, 1)]), k)
    for _ in range(settings.rounds if n > block else 0):
        hoods = np.hstack([np.arange(n, dtype=np.int32)[:, None], ids[:, : settings.joined], turned(ids, score, settings.joined)])
        hoods.sort(axis=1)
        hoods[:, 1:][hoods[:, 1:] == hoods[:, :-1]] = -1
        width = hoods.shape[1]
        many = max(1, PRODUCTS // width**2)
        held: list[tuple[np.ndarray, ...]] = []
        for i in range(0, n, many):
            g = hoods[i : i + many]
            x = h[g]
            s = x @ x.transpose(0, 2, 1)
            s[:, np.arange(width), np.arange(width)] = -np.inf
            hit = s > np.where(g < 0, np.inf, score[g, -1])[:, :, None]
            hit &= (g >= 0)[:, None, :]
            c, a, b = np.nonzero(hit)
            held.append((g[c, a], g[c, b], s[c, a, b]))
            if i + many >= n or sum(len(x[0]) for x in held) > PAIRS:
                improve(ids, score, *(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
    return ids, score


def linked(ids: np.ndarray) -> np.ndarray:
    """The lists, and of each node a few more that have it on theirs, first those which fewest lists lead to."""
    n, k = ids.shape
    u, at = np.nonzero(ids >= 0)
    x = ids[u, at].astype(np.int64)
    led = np.bincount(x, minlength=n)
    more = ~np.isin(x * n + u, u * n + x)
    u, x = u[more], x[more]
    order = paired(x, led[u])
    u, x = u[order], x[order]
    rank = ranks(x)
    few = rank < max(1, k // 4)
    out = np.full((n, max(1, k // 4)), -1, np.int32)
    out[x[few], rank[few]] = u[few]
    return np.hstack([ids, out])


class Shard:
    """A shard's vectors and graph, for searches."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, near: np.ndarray, settings: Settings) -> None:
        self.ids, self.v, self.near, self.settings = ids, v, near, settings
        h = levelled(v)
        self.orders = Orders(h, settings)
        self.entries = np.argsort(h[:, -1], kind="stable")[: settings.entries].astype(np.int32)
        self.h = np.ascontiguousarray(h[:, :-1])

    def search(self, q: np.ndarray, asked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of asked, id, score): the `most` best nodes found for each vector, q being its id."""
        w = asked.astype(np.float64)
        w = w / np.abs(w).max(axis=1)[:, None]
        w = (w / np.sqrt(np.einsum("ij,ij->i", w, w))[:, None]).astype(np.float32)
        at = np.minimum(np.searchsorted(self.ids, q), len(self.ids) - 1)
        own = np.where(self.ids[at] == q, at, -1).astype(np.int32)
        beside = self.orders.beside(np.hstack([w, np.zeros((len(w), 1), np.float32)]), self.settings.beside)
        first = np.hstack([np.broadcast_to(self.entries, (len(w), len(self.entries))), beside, own[:, None]])
        found, _ = self.beams(w, first)
        found = found[:, : 2 * most]  # in single precision their order is near enough
        row, col = np.nonzero(found >= 0)
        x = found[row, col]
        s = np.einsum("ij,ij->i", asked[row].astype(np.float64), self.v[x].astype(np.float64))
        keep = best(row, self.ids[x], s, most)
        return row[keep], self.ids[x[keep]], s[keep]

    def beams(self, w: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and scores of each beam, best first, after a greedy search from the nodes in `new` (-1: none)."""
        n, many, beam, step = len(self.h), len(w), self.settings.beam, self.settings.step
        met = np.full(many * n, -1, np.int32)
        ids, s, done = np.full((many, beam), -1, np.int32), np.full((many, beam), -np.inf, np.float32), np.ones((many, beam), bool)
        while True:  # a node is met once for a query, so this ends
            row, col = np.nonzero(new >= 0)
            key = row * n + new[row, col]
            key = key[met[key] < 0]
            number = np.arange(len(key), dtype=np.int32)
            met[key] = number
            key = key[met[key] == number]  # of a node reached from several, one
            row, y = np.divmod(key, n)
            ends = np.searchsorted(row, np.arange(many + 1))
            got, h = np.empty(len(y), np.float32), self.h[y]
            for i in np.flatnonzero(np.diff(ends)).tolist():
                np.dot(h[ends[i] : ends[i + 1]], w[i], out=got[ends[i] : ends[i + 1]])
            good = got > s[row, -1]
            row, y, got = row[good], y[good], got[good]
            if len(row):
                rank = ranks(row)
                wide = (many, beam + 1 + int(rank.max()))
                c, cs, cd = np.full(wide, -1, np.int32), np.full(wide, -np.inf, np.float32), np.ones(wide, bool)
                c[:, :beam], cs[:, :beam], cd[:, :beam] = ids, s, done
                c[row, beam + rank], cs[row, beam + rank], cd[row, beam + rank] = y, got, False
                order = np.argsort(-cs, axis=1, kind="stable")[:, :beam]
                ids, s, done = (np.take_along_axis(x, order, 1) for x in (c, cs, cd))
            picked = ~done & (np.cumsum(~done, axis=1) <= step)
            row, col = np.nonzero(picked)
            if not len(row):
                return ids, s
            done |= picked
            new = np.full((many, step, self.near.shape[1]), -1, np.int32)
            new[row, ranks(row)] = self.near[ids[row, col]]
            new = new.reshape(many, -1)


def build_graph(nodes: DataFrame, kind: type, settings: Settings = Settings()) -> DataFrame:
    """(shard, id, vec, near): nodes (id, vec) dealt over shards, and their neighbours, as positions among a shard's ids."""
    n, wide = nodes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    most = max(1, min(settings.listed // settings.degree, settings.shard_bytes // (wide or 1)))
    shards = max(1, -(-n // most), min(settings.spread, -(-n // settings.few)))
    schema = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("vec", pa.binary()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in by_cell(batches):
            t = pa.Table.from_batches(list(parts))
            h = levelled(matrix(t.column(2), kind))
            near = linked(descend(h, settings)[0])
            for i in range(0, len(near), 4000):
                part = t.slice(i, 4000)
                lists = pa.array([x.tobytes() for x in near[i : i + 4000]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), shard, np.int32)), *(part.column(j).combine_chunks() for j in (1, 2)), lists], schema=schema)

    dealt = nodes.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vec")
    tasks = min(shards, TASKS)
    dealt = bounded(dealt).repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "id")
    return cut(dealt.mapInArrow(run, "shard int, id long, vec binary, near binary"))


#: Most tasks of a stage; queries that a task searches in a shard, and how many it searches together at most.
TASKS, SLICE, TOGETHER = 2000, 16_384, 64


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of the first column, which the rows come sorted by. A run is to be read before the next."""

    def split() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            cell = b.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            yield from ((int(cell[i]), b.slice(i, j - i)) for i, j in zip(starts[:-1], starts[1:], strict=True) if j > i)

    for cell, parts in groupby(split(), key=lambda x: x[0]):
        yield cell, (b for _, b in parts)


def search(graph: DataFrame, asked: DataFrame, kind: type, most: int, settings: Settings = Settings()) -> DataFrame:
    """(q, x, s): the `most` best nodes found for each vector of asked (q, vec); a node q itself is among them."""
    shards = graph.agg(F.max("shard")).first()[0]
    if shards is None:
        return graph.select(F.col("id").alias("q"), F.col("id").alias("x"), F.lit(0.0).alias("s"))
    shards += 1
    slices = max(1, -(-asked.count() // SLICE))
    cells = lambda shard, part: (F.lit(slices) * shard + part).cast("int").alias("cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = graph.select("*", each(slices).alias("slice")).select(cells(F.col("shard"), F.col("slice")), F.lit(0).alias("what"), "id", "vec", "near")
    queries = asked.select(F.col("q").alias("id"), "vec", F.pmod(F.xxhash64("q"), F.lit(slices)).alias("slice"), each(shards).alias("shard"))
    queries = queries.select(cells(F.col("shard"), F.col("slice")), F.lit(1).alias("what"), "id", "vec", F.lit(None).cast("binary").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in by_cell(batches):
            nodes, shard = [], None
            for b in parts:
                what = b.column(1).to_numpy()
                at = int(np.searchsorted(what, 1))
                if at:
                    nodes.append(b.slice(0, at))
                if at == len(what) or not nodes and shard is None:
                    continue
                if shard is None:
                    t = pa.Table.from_batches(nodes)
                    nodes = []
                    shard = Shard(t.column(2).to_numpy(), matrix(t.column(3), kind), matrix(t.column(4), np.int32), settings)
                    del t
                b = b.slice(at)
                together = max(1, min(TOGETHER, (8 << 20) // len(shard.ids)))
                for i in range(0, b.num_rows, together):
                    some = b.slice(i, together)
                    q = some.column(2).to_numpy()
                    row, x, s = shard.search(q, matrix(some.column(3), kind), most)
                    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(x), pa.array(s)], names=["q", "x", "s"])

    tasks = min(shards * slices, TASKS)
    rows = bounded(held.unionByName(queries)).repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "what", "id")
    found = rows.mapInArrow(run, "q long, x long, s double")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "x")
    return cut(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n"))


def floors(nodes: DataFrame, probes: DataFrame, kind: type, k: int) -> DataFrame:
    """(p, floor, n): of each probe (q, vec), collected here, the least score of its k nearest nodes, and their number."""
    rows = probes.collect()
    ids = np.array([r["q"] for r in rows], np.int64)
    asked = np.stack([np.frombuffer(r["vec"], kind) for r in rows]).astype(np.float64) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(ids), 0))
        for b in batches:
            if b.num_rows and len(ids):
                s = asked @ matrix(b.column(1), kind).astype(np.float64).T
                s[ids[:, None] == b.column(0).to_numpy()] = -np.inf
                top = -np.sort(-np.hstack([top, s]), axis=1)[:, :k]
        row, at = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(top[row, at])], names=["p", "s"])

    order = Window.partitionBy("p").orderBy(F.desc("s"))
    true = bounded(nodes).select("id", "vec").mapInArrow(run, "p long, s double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return cut(true.groupBy("p").agg(F.min("s").alias("floor"), F.count("*").alias("n")))


def recall(found: DataFrame, floor: DataFrame) -> float:
    """The share of the probes' nearest nodes that searches found (q, x, s)."""
    # Sums of the same products in another order differ in their last digits.
    reached = (F.col("x") != F.col("q")) & (F.col("s") >= F.col("floor") - F.abs("floor") * 1e-9)
    hits = found.join(F.broadcast(floor), found["q"] == floor["p"]).groupBy("q", "n").agg(F.count_if(reached).alias("hits"))
    got, n = hits.agg(F.sum(F.least("hits", "n"))).first()[0], floor.agg(F.sum("n")).first()[0]
    return (got or 0) / n if n else 1.0


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of df whose id is in queries (column of that name)."""
    rows, kind = vectors(df, key, vector)
    nodes = cut(rows.groupBy("key128").agg(F.min(F.struct("id", "vec", "norm2")).alias("r")).select("key128", "r.*"))
    of_class = nodes.select(F.col("key128").alias("k2"), F.col("id").alias("c"))
    asked = rows.select("id", "key128").join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = cut(asked.join(of_class, asked["key128"] == of_class["k2"]).select(F.col("id").alias("query_id"), F.col("c").alias("q")))
    starts = cut(nodes.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("q"), "vec"))
    graph, n = build_graph(nodes, kind, settings), nodes.count()
    probes = starts.orderBy(F.xxhash64("q"), "q").limit(settings.probes)
    floor, narrow = floors(nodes, probes, kind, k), settings.beam
    while settings.beam < n and recall(search(graph, probes, kind, k + 1, settings), floor) < settings.least:
        settings = replace(settings, beam=settings.beam + max(1, settings.beam // 2))
        if settings.beam >= 8 * narrow:
            settings, narrow = replace(settings, degree=2 * settings.degree, joined=2 * settings.joined), settings.beam
            graph = build_graph(nodes, kind, settings)
    found = search(graph, starts, kind, k + 1, settings)
    # Of a class of equal vectors only the k + 1 smallest ids can be among k nearest.
    small = Window.partitionBy("key128").orderBy("id")
    members = rows.select("id", "key128").withColumn("n", F.row_number().over(small)).where(F.col("n") <= k + 1)
    members = members.join(of_class, members["key128"] == of_class["k2"]).select(F.col("c").alias("x2"), F.col("id").alias("vec_id"))
    hits = asked.join(found, "q").join(members, F.col("x") == F.col("x2")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s").alias("score"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
