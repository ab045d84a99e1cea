"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement, on arrays.

Texts are read as strings of wide symbols: ``width`` bytes make one symbol, and every phase of a text (its bytes from 0, from 1,
... from width - 1) is a string of its own with its own end mark, so every byte position starts one suffix and a common prefix
of ``depth`` symbols is a common prefix of width * depth bytes. Each shard is sorted once. The interleave of all shards starts as
their concatenation; each refinement walks it, reads the next transform symbol of the named shard and moves the shard's number,
stably, into the bucket of that symbol, which sorts by one symbol more. Blocks that stay together through ``depth`` rounds are
the repeated intervals, their members have a common prefix of at least width * depth bytes. No suffix is compared or sorted again.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_MULT = 0x9E3779B97F4A7C15 | 1


def rolling(data: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` bytes, combined from windows of doubling width."""
    table = mix64(np.arange(seed, seed + 256, dtype=np.uint64) * np.uint64(_MULT))
    n, part, power = 1, table[data], _MULT
    out, covered = None, 0
    while True:
        if width & n:
            if out is None:
                out = part
            else:
                m = len(data) - covered - n + 1
                out = out[:max(m, 0)] * np.uint64(power) + part[covered:covered + max(m, 0)]
            covered += n
        if covered == width:
            return mix64(out[:max(0, len(data) - width + 1)])
        m = len(part) - n
        part = part[:max(m, 0)] * np.uint64(power) + part[n:n + max(m, 0)]
        power, n = power * power & (1 << 64) - 1, 2 * n


class Shard:
    """The sorted suffixes of some texts: ``at`` (byte position, -1 for an end mark) and ``prior`` (transform symbol, 0 for an end mark)."""

    def __init__(self, sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, depth: int):
        lens = np.maximum(0, ends - starts - width + 1)  # suffixes of each text
        first = np.repeat(np.cumsum(lens) - lens, lens)
        own = np.arange(lens.sum()) - first
        at = np.repeat(starts, lens) + own
        last = np.repeat(ends, lens) - width
        keys = [np.where(at + j * width <= last, sym[np.minimum(at + j * width, len(sym) - 1)], 0) for j in range(depth)]
        order = np.lexsort(keys[::-1])
        prior = np.where(own >= width, sym[np.maximum(at - width, 0)], 0)
        closing = at[at + width > last]  # the last symbol of each string stands before its end mark
        self.at = np.concatenate((np.full(len(closing), -1, np.int64), at[order]))
        self.prior = np.concatenate((sym[closing], prior[order])).astype(np.int32)
        self.strings = len(closing)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, block numbers) of all suffixes in merged order; equal numbers share ``depth`` symbols."""
    sizes = [len(s.at) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.int16), [s.strings for s in shards])
    prior, at = np.concatenate([s.prior for s in shards]), np.concatenate([s.at for s in shards])
    block = np.zeros(len(z), np.int64)
    for _ in range(depth):
        c = np.empty(len(z), np.int32)
        c[np.argsort(z, kind="stable")] = prior
        order = np.argsort(c, kind="stable")
        c, z, block = c[order], z[order], block[order]
        z[:len(ends)] = ends
        new = np.ones(len(z), bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        new[:len(ends) + 1] = True
        block = np.cumsum(new)
    merged = np.empty(len(z), np.int64)
    merged[np.argsort(z, kind="stable")] = at
    return merged, block


def least_owner(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, width: int = 10, depth: int = 5, n_shards: int = 8) -> np.ndarray:
    """For every byte position of the concatenated texts, the least ``owner`` of a text in which the width * depth bytes that
    start there occur; the text's own owner where fewer bytes follow."""
    mine = np.repeat(owner, np.diff(offsets))
    out = mine.copy()
    if not len(data) or len(data) < width:
        return out
    _, sym = np.unique(rolling(data, width), return_inverse=True)
    sym = (sym + 1).astype(np.int32)
    n = len(offsets) - 1
    cuts = sorted({0, n, *np.searchsorted(offsets, np.linspace(0, len(data), min(n_shards, n) + 1)[1:-1]).tolist()})
    shards = [Shard(sym, offsets[a:b], offsets[a + 1:b + 1], width, depth) for a, b in zip(cuts, cuts[1:])]
    at, block = merge(shards, depth)
    real = at >= 0
    at, block = at[real], block[real]
    heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(at) else np.zeros(0, np.int64)
    if len(at):
        least = np.minimum.reduceat(mine[at], heads)
        found = np.repeat(least, np.diff(np.append(heads, len(at))))
        whole = at + width * depth <= np.repeat(offsets[1:], np.diff(offsets))[at]
        out[at[whole]] = found[whole]
    return out
