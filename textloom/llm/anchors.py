"""Anchors: places that any two equal windows of bytes agree on."""

from __future__ import annotations

import numpy as np

#: An odd base of the polynomial hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LONGEST = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(pow(base, done, 2**64))
        done += m
    return out


class Rolling:
    """Hashes of byte ranges of one buffer: equal bytes, equal hashes, wherever they stand."""

    def __init__(self, data: np.ndarray, tables: dict[str, np.ndarray]) -> None:
        n = len(data) + 1
        if len(tables.get("up", ())) < n:
            tables["up"], tables["down"] = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        self.down = tables["down"]
        # Bytes are stirred first, so that runs of one byte and small changes give unlike sums.
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93) * tables["up"][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of every range [start, end), the length mixed in."""
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(x + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w consecutive values, by running minima from both ends of blocks."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the smallest value of some window of w values; equal windows mark equal places.

    Tied values are all marked, so a window's marks depend on the window alone.
    """
    if len(grams) < w:
        return np.zeros(0, np.int64)
    low = sliding_min(grams, w)
    # A position is marked if the largest of the minima of the windows that hold it is its own value.
    top = ~low
    edge = np.full(w - 1, np.iinfo(low.dtype).max, low.dtype)
    over = ~sliding_min(np.concatenate([edge, top, edge]), w)
    return np.flatnonzero(over == grams)
