"""Suffix-array dedup with deep-shallow sorting.

Bytes are removed that lie in a string of `window` bytes which also starts anywhere else. Two equal windows agree on
their anchors (see anchors.py), so only suffixes at anchors are sorted: `gram` bytes name an anchor, and every
window of its occurrence lies within window - gram bytes around it, its context.

1. Each text gives its anchors with hashes of gram and context. Equal contexts settle each other whole.
2. Of an anchor with unlike contexts, one occurrence of each goes on, with the bytes around it.
3. The occurrences of an anchor are sorted by the bytes behind it and by the reversed bytes before it: multikey
   quicksort on eight-byte words to a shallow depth, then a blind trie orders each group that still shares its
   prefix. From both orders and their common-prefix lengths follow, for every offset, the occurrences whose windows
   there are equal.
4. Spans come back to the texts, which lose the bytes they cover.

Common anchors are thinned out before they are dealt: of equal contexts in an Arrow batch one goes on. An anchor with
more than THIN unlike ones in some batch, or more than CROWD in all, is crowded and isn't dealt as such: each of its
matches shares half of the missing context before or behind it, so the occurrences are dealt by hashes of either half,
until few are left together or the whole window is named. The batch that finds a crowd deals a mark in its stead, by
which the occurrences from other batches are told to go the same way. Equal texts in several batches don't meet there,
so texts that come more than once are counted, and are spans as a whole.

Defined results: a null or empty text, or one shorter than the window, loses nothing; equal texts, and rows of one
doc_id, are separate places that match each other; overlapping occurrences within a text count; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Rolling, anchors, mixed
from .common import bounded, cut, each_batch, raw_text, table

WINDOW, GRAM = 400, 256
#: Bytes to which multikey quicksort goes; tries order what is alike beyond.
SHALLOW = 32
#: Most occurrences of an anchor that a task holds together; most rows of a run that it looks at together.
CROWD, ROWS = 50_000, 200_000
#: Most occurrences of one anchor, or longer name, that an Arrow batch deals under it.
THIN = 64


class Trie:
    """A blind trie: nodes hold where their branches differ and the branching bytes, no text."""

    __slots__ = ("depth", "branches", "rows")

    def __init__(self, depth: int, rows: list[int] | None = None) -> None:
        self.depth, self.rows, self.branches = depth, rows, {}

    def some(self) -> int:
        node = self
        while node.rows is None:
            node = next(iter(node.branches.values()))
        return node.rows[0]

    def insert(self, row: int, text: list[bytes]) -> Trie:
        """The root after this row came in. Texts are of equal length."""
        own, node = text[row], self
        while node.rows is None and (step := node.branches.get(own[node.depth])):
            node = step
        other = text[node.some()]
        at = common(own, other)
        if at == len(own):
            node.rows.append(row)
            return self
        above, node = None, self
        while node.rows is None and node.depth < at:
            above, node = node, node.branches.get(own[node.depth])
            if node is None:
                break
        leaf = Trie(len(own), [row])
        if node is not None and node.rows is None and node.depth == at:
            node.branches[own[at]] = leaf
            return self
        if node is None:
            above.branches[own[above.depth]] = leaf
            return self
        fork = Trie(at)
        fork.branches = {other[at]: node, own[at]: leaf}
        if above is None:
            return fork
        above.branches[own[above.depth]] = fork
        return self

    def ordered(self) -> list[int]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.rows is not None:
                out += node.rows
            else:
                stack += [node.branches[b] for b in sorted(node.branches, reverse=True)]
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two texts of one length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def deep_shallow(group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order of rows by (group, text); text is a matrix of bytes whose width is a multiple of eight."""
    words = text.view(">u8")
    order = np.argsort(group, kind="stable")
    tied = group[order[1:]] == group[order[:-1]] if len(order) else np.zeros(0, bool)
    for depth in range(min(SHALLOW, text.shape[1]) // 8):
        if not tied.any():
            return order
        label = np.concatenate([[0], np.cumsum(~tied)])
        word = words[order, depth].astype(np.uint64)
        again = np.lexsort((word, label))
        order, word = order[again], word[again]
        tied = tied & (word[1:] == word[:-1])
    # Runs of ties are what quicksort leaves; a trie orders each, unless its rows are all equal.
    edge = np.flatnonzero(np.diff(np.concatenate([[False], tied, [False]]).astype(np.int8)))
    for a, b in edge.reshape(-1, 2).tolist():
        rows = order[a : b + 1]
        rest = [x.tobytes() for x in text[rows, SHALLOW:]]
        trie = Trie(len(rest[0]), [0])
        for i in range(1, len(rest)):
            trie = trie.insert(i, rest)
        order[a : b + 1] = rows[trie.ordered()]
    return order


def shared(order: np.ndarray, group: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before it in this order; -1 across groups and for the first."""
    out = np.full(len(order), -1, np.int64)
    a, b = order[:-1], order[1:]
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        unlike = text[x] != text[y]
        n = np.where(unlike.any(axis=1), unlike.argmax(axis=1), text.shape[1])
        out[1 + i : 1 + i + len(x)] = np.where(group[x] == group[y], np.minimum(n, np.minimum(size[x], size[y])), -1)
    return out


def reach(group: np.ndarray, before: list[bytes], behind: list[bytes], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset d for which another row of the group has the same d bytes before its anchor and the
    same need - d bytes behind it; (1, 0) if there is none. `before` is reversed."""
    sides = []
    for texts in (before, behind):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        wide = max(8, -(-need // 8) * 8)
        text = np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(len(texts), wide)
        order = deep_shallow(group, text)
        sides.append((size, order, shared(order, group, text, size)))
    low, high = np.full(len(group), need + 1), np.full(len(group), -1)
    classes = np.empty(len(group), np.int64)
    for d in range(need + 1):
        key, ok = np.zeros(len(group), np.int64), np.ones(len(group), bool)
        for (size, order, lcp), depth in zip(sides, (d, need - d), strict=True):
            classes[order] = np.cumsum(lcp < depth)
            key = key * np.int64(len(group) + 1) + classes
            ok &= size >= depth
        rows = np.flatnonzero(ok)
        by = rows[np.argsort(key[rows], kind="stable")]
        same = key[by[1:]] == key[by[:-1]]
        hit = np.zeros(len(by), bool)
        hit[1:] |= same
        hit[:-1] |= same
        hit = by[hit]
        low[hit] = np.minimum(low[hit], d)
        high[hit] = np.maximum(high[hit], d)
    none = high < 0
    return np.where(none, 1, low), np.where(none, 0, high)


SPAN = pa.schema([*((x, pa.int64()) for x in ("t", "n", "lo", "hi", "h", "at")), ("crowded", pa.bool_())])
SPANS = "t long, n long, lo long, hi long, h long, at long, crowded boolean"
#: In place of an anchor's bytes behind: what else a row of find_anchors is.
MARK, COVERED, CROWDED = 509, 510, 511


def spans(t, n, lo, hi, h=None, at=None, crowded=None) -> pa.RecordBatch:
    """Spans to remove (h null), or occurrences that go on (lo, hi null)."""
    nulls = pa.nulls(len(t), pa.int64())
    cols = [nulls if c is None else pa.array(np.asarray(c, np.int64)) for c in (t, n, lo, hi, h, at)]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(t), pa.bool_()) if crowded is None else pa.array(crowded)], schema=SPAN)


def joined(t: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes of the texts in as few spans."""
    if not len(t):
        return t, n, lo, hi
    order = np.lexsort((lo, n, t))
    t, n, lo, hi = t[order], n[order], lo[order], hi[order]
    text = np.concatenate([[0], np.cumsum((t[1:] != t[:-1]) | (n[1:] != n[:-1]))]) << 28
    end = np.maximum.accumulate(text + hi)
    first = np.flatnonzero(np.concatenate([[True], (text + lo)[1:] > end[:-1]]))
    return t[first], n[first], lo[first], np.maximum.reduceat(hi, first)


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Whole runs of the first column as in whole_runs; a run of over `most` rows comes in parts that overlap by a row."""
    held: list[pa.RecordBatch] = []

    size, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy()
        starts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if last is not None and last != k[0]:
            starts = np.concatenate([[0], starts])
        last = k[-1]
        if len(starts):
            at = int(starts[-1])
            done = [*held, b.slice(0, at)] if at else held
            if done:
                yield pa.Table.from_batches(done)
            held, size = [b.slice(at)], b.num_rows - at
        else:
            held.append(b)
            size += b.num_rows
            if size > most:
                yield pa.Table.from_batches(held)
                held, size = [b.slice(b.num_rows - 1)], 1
    if held:
        yield pa.Table.from_batches(held)


def unpacked(place: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Length of the text, position, and the span of the anchor's context."""
    n, at = place >> 36, place >> 9 & (1 << 27) - 1
    return n, at, np.maximum(0, at - (window - gram)), at + (place & 511)


def thinned(h: np.ndarray, c: np.ndarray, t: np.ndarray, place: np.ndarray, window: int, gram: int, most: int) -> tuple[np.ndarray, ...]:
    """Rows of find_anchors: one of equal contexts, what those cover, crowded anchors under hashes of their own, and their marks."""
    order = np.lexsort((c, h))
    h, c, t, place = h[order], c[order], t[order], place[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    if new_c.all():
        gone = (np.zeros(0, np.int64),) * 4
    else:
        of_c = np.diff(np.append(np.flatnonzero(new_c), len(h)))
        n, _, lo, hi = unpacked(place, window, gram)
        own = (np.repeat(of_c, of_c) > 1) & (hi - lo >= window)
        u, n, lo, hi = joined(t[own], n[own], lo[own], hi[own])
        gone = (mixed(u.view(np.uint64) + lo.astype(np.uint64)).view(np.int64), lo << 32 | hi, u, n << 36 | COVERED)
    h, c, t, place, new_h = h[new_c], c[new_c], t[new_c], place[new_c], new_h[new_c]
    size = np.diff(np.append(np.flatnonzero(new_h), len(h)))
    names = h[new_h][size > most]
    over = np.repeat(size > most, size)
    parts = [
        (h[~over], c[~over], t[~over], place[~over]), gone,
        (c[over], h[over], t[over], place[over] | CROWDED), (names, np.full(len(names), np.iinfo(np.int64).min), np.zeros(len(names), np.int64), np.full(len(names), MARK)),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def find_anchors(df: DataFrame, window: int, gram: int, most: int = THIN) -> DataFrame:
    """(h, c, t, place): hash of each anchor's gram and context, the text's hash, and length, position and bytes behind in one."""
    schema = pa.schema([(x, pa.int64()) for x in ("h", "c", "t", "place")])
    need = window - gram
    if window >= MARK:
        raise ValueError(f"windows are shorter than {MARK} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(1))
            out = []
            for t, a, z in zip(b.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = z - a
                if n < window:
                    continue
                roll = Rolling(data[a:z], tables)
                grams = roll.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
                at = anchors(grams, need + 1)
                first, end = np.maximum(0, at - need), np.minimum(n, at + window)
                c = mixed(roll.of(first, end) + (at - first).astype(np.uint64))
                out.append((grams[at].view(np.int64), c.view(np.int64), np.full(len(at), t), n << 36 | at << 9 | (end - at)))
            if out:
                rows = thinned(*(np.concatenate(x) for x in zip(*out, strict=True)), window, gram, most)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)

    return df.mapInArrow(run, "h long, c long, t long, place long")


def settle(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """From anchors dealt by h: spans of equal contexts, and occurrences with unlike ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(0, np.int64)
        for tab in pieces(batches, ROWS):
            h, c, t, place = (tab.column(i).to_numpy() for i in range(4))
            kind = place & 511
            if (own := np.flatnonzero(kind == COVERED)).size:
                yield spans(t[own], place[own] >> 36, c[own] >> 32, c[own] & (1 << 32) - 1)
            if (own := np.flatnonzero(kind == CROWDED)).size:
                n, at, _, _ = unpacked(place[own], window, gram)
                yield spans(t[own], n, None, None, c[own], at, np.ones(len(own), bool))
            # A run that comes in parts has its marks in the first.
            marked = np.union1d(h[kind == MARK], marked[marked == h[0]])
            own = kind < MARK
            h, c, t, place = h[own], c[own], t[own], place[own]
            new_h = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            if new_h.all() and not len(marked):
                continue
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])[: len(h)]
            first_c = np.flatnonzero(new_c)
            of_c = np.diff(np.append(first_c, len(h)))
            many = np.repeat(of_c, of_c) > 1
            n, at, lo, hi = unpacked(place, window, gram)
            own = np.flatnonzero(many & (hi - lo >= window))
            if len(own):
                yield spans(*joined(t[own], n[own], lo[own], hi[own]))
            first_h = np.flatnonzero(new_h)
            contexts = np.add.reduceat(new_c.astype(np.int64), first_h) if len(h) else first_h
            crowded = np.isin(h, marked)
            unlike = (crowded | np.repeat(contexts > 1, np.diff(np.append(first_h, len(h))))) & new_c
            if unlike.any():
                yield spans(t[unlike], n[unlike], None, None, h[unlike], at[unlike], crowded[unlike])

    return rows.repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, SPANS)


HOOD = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("before", pa.binary()), ("behind", pa.binary())])
FOUND = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), *HOOD])
HOODS = "lo long, hi long, key long, t long, n long, at long, left int, right int, before binary, behind binary"


def longer(left: int, right: int, need: int) -> set[tuple[int, int]]:
    """Context lengths of which each match has one: twice, half of what is missing is before or behind."""
    out = {(left, right)}
    for _ in range(2):
        out = {x for a, b in out for half in [-(-(need - a - b) // 2)] for x in ((a + half, b), (a, b + half))}
    return out


def split(rows: list[dict], need: int, window: int) -> Iterator[dict]:
    """Occurrences of HOODS under longer names, and spans (lo, hi) of what matches already.

    A name leaves some offsets of the window open. Of the rows that agree in all bytes of these, one goes on, as all
    have matches at each of them. An occurrence whose whole window is named is a match by itself.
    """
    found: list[tuple[int, int, int, int]] = []
    alike: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["left"] + r["right"] == need:
            found.append((r["t"], r["n"], r["at"] - r["left"], r["at"] - r["left"] + window))
            continue
        for left, right in longer(r["left"], r["right"], need):
            if len(r["before"]) >= left and len(r["behind"]) >= right:
                name = xxhash.xxh3_64_intdigest(b"%d %d %d " % (r["key"], left, right) + r["before"][:left] + r["behind"][:right])
                name -= name >> 63 << 64
                row = r | {"key": name, "left": left, "right": right}
                before, behind = r["before"][: need - right], r["behind"][: need - left]
                if len(before) + len(behind) < 2 * need - left - right:  # the text ends before
                    yield row
                else:
                    alike.setdefault((name, before, behind), []).append(row)
    for same in alike.values():
        yield same[0]
        if len({(r["t"], r["n"], r["at"]) for r in same}) > 1:
            found += [(r["t"], r["n"], r["at"] + r["right"] - need, r["at"] - r["left"] + window) for r in same]
    if found:
        for t, n, lo, hi in zip(*(x.tolist() for x in joined(*np.array(found, np.int64).T)), strict=True):
            yield {"lo": lo, "hi": hi, "t": t, "n": n, "key": t}


def listed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of dictionaries, whose missing fields are null."""
    while part := list(islice(rows, 4000)):
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def neighbourhoods(df: DataFrame, places: DataFrame, window: int, gram: int) -> DataFrame:
    """HOODS: occurrences with the bytes around them, key being the anchor's hash, crowded ones under longer names; and
    spans that those show (lo and hi not null)."""
    need = window - gram
    wanted = places.groupBy("t", "n").agg(F.collect_set(F.struct("at", "h", "crowded")).alias("places"))
    texts = df.join(wanted, ["t", "n"]).select("t", "n", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(2))
            raw = data.tobytes()
            cols: list[list] = [[] for _ in HOOD]
            crowded: list[dict] = []
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if ids[i] == last:  # a copy of the text before
                    continue
                last = ids[i]
                for p in b.column(3)[i].as_py():
                    at = p["at"]
                    row = (p["h"], *last, at, 0, 0, raw[a + max(0, at - need) : a + at][::-1], raw[a + at + gram : min(z, a + at + window)])
                    if p["crowded"] and need:
                        crowded.append(dict(zip(HOOD.names, row, strict=True)))
                        continue
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            blank = pa.nulls(len(cols[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, *(pa.array(x, f.type) for x, f in zip(cols, HOOD, strict=True))], schema=FOUND)
            yield from listed(split(crowded, need, window), FOUND)

    return bounded(texts).mapInArrow(run, HOODS)


def matched(hoods: DataFrame, window: int, gram: int, crowd: int, most: int = THIN) -> DataFrame:
    """HOODS of HOODS: spans of occurrences that match another one, spans given, and crowded occurrences under longer names."""
    need = window - gram
    out = FOUND
    # In the shuffle, done is 0 for an occurrence, 1 for a row of the result, -1 for a crowded name's mark, which comes first.
    dealt = pa.schema([*out, ("done", pa.int32())])

    def flagged(b: pa.RecordBatch, done: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, done, np.int32))], schema=dealt)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            if given.any():
                yield flagged(b.filter(pa.array(given)), 1)
            b = b.filter(pa.array(~given))
            _, first = np.unique(np.stack([b.column(i).to_numpy() for i in range(2, 6)], 1), axis=0, return_index=True)
            b = b.take(pa.array(first))  # copies of a text may have sent an occurrence twice
            names, code, counts = np.unique(b.column(2).to_numpy(), return_inverse=True, return_counts=True)
            over = (counts > most)[code]
            yield flagged(b.filter(pa.array(~over)), 0)
            if over.any():
                yield from listed((x | {"done": 1} for x in split(b.filter(pa.array(over)).to_pylist(), need, window)), dealt)
                yield from listed(iter([{"key": int(k), "done": -1} for k in names[counts > most]]), dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        size, going_on, marked = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for tab in pieces((b.select([2, *range(b.num_columns)]) for b in batches), crowd):
            tab = tab.select(range(1, tab.num_columns))
            key, done = tab.column(2).to_numpy(), tab.column(10).to_numpy()
            marked = np.union1d(key[done < 0], marked[marked == key[0]])
            if (done > 0).any():
                yield from tab.filter(pa.array(done > 0)).select(out.names).to_batches()
            tab = tab.filter(pa.array(done == 0)).select(HOOD.names)
            if not tab.num_rows:
                continue
            key = tab.column(0).to_numpy()
            counts = np.unique(key, return_counts=True)
            # A run that comes in parts is hot as a whole: its last part may be small.
            hot = np.union1d(counts[0][counts[1] > crowd], going_on)
            going_on = hot[hot == key[-1]]
            hot = np.union1d(hot, marked)
            if len(hot):
                over = np.isin(key, hot)
                for part in tab.filter(pa.array(over)).to_batches(4000):
                    yield from listed(split(part.to_pylist(), need, window), out)
                tab = tab.filter(pa.array(~over))
            if not tab.num_rows:
                continue
            # Small runs are sorted together.
            waiting.append(tab)
            size += tab.num_rows
            if size >= 16_384:
                yield finish(pa.concat_tables(waiting))
                waiting, size = [], 0
        if waiting:
            yield finish(pa.concat_tables(waiting))

    def finish(tab: pa.Table) -> pa.RecordBatch:
        group, t, n, at = (tab.column(i).to_numpy() for i in range(4))
        order = np.lexsort((at, n, t, group))
        same = np.zeros(len(order), bool)  # copies of a text may have sent an occurrence twice
        o = order
        same[1:] = (group[o[1:]] == group[o[:-1]]) & (t[o[1:]] == t[o[:-1]]) & (n[o[1:]] == n[o[:-1]]) & (at[o[1:]] == at[o[:-1]])
        own = order[~same]
        tab = tab.take(pa.array(own))
        group, t, n, at = group[own], t[own], n[own], at[own]
        low, high = reach(group, tab.column(6).to_pylist(), tab.column(7).to_pylist(), need)
        hit = low <= high
        blank = [pa.nulls(int(hit.sum()), f.type) for f in HOOD]
        blank[1], blank[2] = pa.array(t[hit]), pa.array(n[hit])
        return pa.RecordBatch.from_arrays([pa.array(at[hit] - high[hit]), pa.array(at[hit] - low[hit] + window), *blank], schema=out)

    rows = bounded(hoods).mapInArrow(thin, HOODS + ", done int").repartition("key").sortWithinPartitions("key", "done", "t", "n", "at")
    return rows.mapInArrow(run, HOODS)


def find_repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, most: int = THIN) -> DataFrame:
    """(t, n, lo, hi): spans of texts (t, n, text) that are covered by repeated windows."""
    settled = cut(settle(find_anchors(bounded(df).select("t", "text"), window, gram, most), window, gram))
    found = settled.where("h is null").select("t", "n", "lo", "hi")
    # Copies that come from several batches around a crowded anchor are one occurrence (t, n, at) from here on.
    copies = df.groupBy("t", "n").count().where((F.col("count") > 1) & (F.col("n") >= window))
    found = found.unionByName(copies.select("t", "n", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    rows = neighbourhoods(df, settled.where("h is not null"), window, gram)
    while True:
        got = cut(matched(rows, window, gram, crowd, most))
        found = found.unionByName(got.where("lo is not null").select("t", "n", "lo", "hi"))
        rows = got.where("lo is null")
        if rows.isEmpty():
            return found


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, most: int = THIN) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of every row."""
    src = bounded(df).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    src = src.withColumns({"t": F.xxhash64("text"), "n": F.octet_length("text").cast("long")})
    of_text = find_repeats(src, window, gram, crowd, most).distinct().groupBy("t", "n").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = src.join(of_text, ["t", "n"], "left").select("k", "text", "spans")
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(1))
            raw = data.tobytes()
            rows = []
            lists = b.column(2).to_pylist()
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                runs: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in lists[i] or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                ends = [0, *(x for r in runs for x in r), z - a]
                kept = b"".join(raw[a + x : a + y] for x, y in zip(ends[::2], ends[1::2], strict=True)) if runs else raw[a:z]
                rows.append((z - a, z - a - len(kept), len(runs), kept))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], schema.field(j + 1).type) for j in range(4))], schema=schema)

    return rows.mapInArrow(run, "k long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("k", key)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
