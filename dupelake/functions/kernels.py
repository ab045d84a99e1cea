"""Numpy kernels that run inside Arrow batches; each works on a whole batch of frames or pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ..config import (BRIGHT_LEVEL, DARK_LEVEL, DARK_SHARE, DIFF_DIVISOR, FRAME_PIXELS, FRAME_SIDE, MatchFlag,
                      ScanConfig)
from .vectors import allowed_bits, required_matches

_HASH_SIDE = 8


def _dct_rows() -> np.ndarray:
    k = np.arange(1, _HASH_SIDE + 1)[:, None]
    i = np.arange(FRAME_SIDE)[None, :]
    basis = np.cos((2 * i + 1) * k * np.pi / (2.0 * FRAME_SIDE)).astype(np.float32)
    return (basis * np.float32(np.sqrt(2.0 / FRAME_SIDE))).astype(np.float32)


def phash_batch(frames: np.ndarray) -> np.ndarray:
    """(n, 1024) luma bytes -> signed 64-bit hashes: low AC block of the DCT against its median."""
    basis = _dct_rows()
    x = frames.reshape(-1, FRAME_SIDE, FRAME_SIDE).astype(np.float32)
    ac = np.matmul(np.matmul(basis, x), basis.T).reshape(-1, 64)
    ordered = np.sort(ac, axis=1)
    median = (ordered[:, 31] + ordered[:, 32]) * np.float32(0.5)
    bits = (ac > median[:, None]).astype(np.uint64)
    return np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64), axis=1).view(np.int64)


def mirror_batch(frames: np.ndarray, side: int = FRAME_SIDE) -> np.ndarray:
    return frames.reshape(-1, side, side)[:, :, ::-1].reshape(len(frames), -1)


def stack_frames(values, width: int = FRAME_PIXELS) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, width)


@F.pandas_udf(T.LongType())
def phash(gray: pd.Series) -> pd.Series:
    """64-bit perceptual hash of a 32x32 frame; null for missing or odd-sized frames."""
    ok = gray.map(lambda b: b is not None and len(b) == FRAME_PIXELS).to_numpy(dtype=bool)
    out = pd.Series([None] * len(gray), dtype="Int64")
    if ok.any():
        out[ok] = phash_batch(stack_frames(gray[ok]))
    return out


def by_length(values: pd.Series, empty, fn) -> list:
    """``fn`` over (n, length) stacks of the byte strings of equal length; ``empty`` for missing and empty ones."""
    out = [empty] * len(values)
    lengths: dict[int, list[int]] = {}
    for i, b in enumerate(values):
        if b is not None and len(b):
            lengths.setdefault(len(b), []).append(i)
    for n, at in lengths.items():
        for i, v in zip(at, fn(stack_frames([values.iat[i] for i in at], n))):
            out[i] = v
    return out


def _square(x: np.ndarray) -> int:
    side = math.isqrt(x.shape[1])
    return side if side * side == x.shape[1] else 0


@F.pandas_udf(T.BinaryType())
def flip(gray: pd.Series) -> pd.Series:
    """Mirror each row of a square frame; null for others."""
    def many(x):
        side = _square(x)
        return [row.tobytes() for row in mirror_batch(x, side)] if side else [None] * len(x)
    return pd.Series(by_length(gray, None, many), dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def mirrored_hashes(gray: pd.Series) -> pd.Series:
    """Hashes of the mirrored frames of one file each; ``gray`` holds its 32x32 frames one after the other."""
    frames = np.frombuffer(b"".join(gray), np.uint8).reshape(-1, FRAME_PIXELS)
    hashes = phash_batch(np.ascontiguousarray(mirror_batch(frames))) if len(frames) else np.zeros(0, np.int64)
    ends = np.cumsum([len(b) // FRAME_PIXELS for b in gray])
    return pd.Series(np.split(hashes, ends[:-1]) if len(ends) else [])


@F.pandas_udf(T.BooleanType())
def is_dark(gray: pd.Series) -> pd.Series:
    """At least 80 % of the pixels are near black."""
    def many(x):
        return ((x <= DARK_LEVEL).sum(axis=1) >= DARK_SHARE * x.shape[1]).tolist()
    return pd.Series(by_length(gray, None, many), dtype=object)


@F.pandas_udf(T.BooleanType())
def is_dark_rgb(rgb: pd.Series) -> pd.Series:
    """RGB form: a pixel counts as dark only when all three channels are."""
    def many(x):
        px = x[:, : x.shape[1] // 3 * 3].reshape(len(x), -1, 3)
        return ((px <= DARK_LEVEL).all(axis=2).sum(axis=1) >= DARK_SHARE * px.shape[1]).tolist()
    return pd.Series(by_length(rgb, None, many), dtype=object)


@F.pandas_udf(T.DoubleType())
def frame_detail(gray: pd.Series) -> pd.Series:
    """Mean absolute difference to the right and lower neighbour; 0 for frames that are not square."""
    def many(x):
        return neighbour_difference(x).tolist()
    return pd.Series(by_length(gray, 0.0, many), dtype=float)


def neighbour_difference(x: np.ndarray) -> np.ndarray:
    """The measure of :func:`frame_detail` for (frames, length) pixels."""
    side = _square(x)
    if side <= 1:
        return np.zeros(len(x))
    x = x.reshape(-1, side, side).astype(np.int16)
    total = sum(np.abs(np.diff(x, axis=k)).reshape(len(x), -1).sum(axis=1, dtype=np.int32 if side < 2048 else np.int64) for k in (1, 2))
    return total / (2 * side * (side - 1))


def sad_fraction(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Mean absolute difference of aligned rows as a single-precision fraction; ``weight`` is the pixels per column."""
    weight = np.ones(a.shape[-1], np.int32) if weight is None else weight
    sad = np.abs(a.astype(np.int16) - b.astype(np.int16)) @ weight
    return (sad.astype(np.float32) / np.float32(weight.sum()) / np.float32(DIFF_DIVISOR)).astype(np.float32)


def unmasked(x: np.ndarray, black: bool, white: bool) -> np.ndarray:
    """Pixels that count when near black or near white ones are ignored."""
    return ((x > DARK_LEVEL) | (not black)) & ((x < BRIGHT_LEVEL) | (not white))


def masked_fraction(a: np.ndarray, b: np.ndarray, black: bool, white: bool, weight: np.ndarray | None = None) -> np.ndarray:
    """As ``sad_fraction`` over the pixels that are neither near black nor near white on both sides; NaN if none."""
    weight = np.ones(a.shape[-1], np.int32) if weight is None else weight
    keep = unmasked(a, black, white) & unmasked(b, black, white)
    sad = (np.abs(a.astype(np.int16) - b.astype(np.int16)) * keep) @ weight
    n = keep @ weight
    with np.errstate(divide="ignore", invalid="ignore"):
        return (sad.astype(np.float32) / n.astype(np.float32) / np.float32(DIFF_DIVISOR)).astype(np.float32)


def sad_matrix(x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: tuple | None = None, limit: float | None = None,
               open_: np.ndarray | None = None) -> np.ndarray:
    """Summed absolute differences of every frame of ``x`` with every frame of ``y``.

    ``x`` and ``y`` are (columns, frames) int16, ``weight`` the pixels per column; ``kept`` holds their masks (0 or -1).
    With a limit the sums stop, too small then, once every open pair is over it.
    """
    total = np.zeros((x.shape[1], y.shape[1]), np.int32)
    part, gap, both = (np.zeros(total.shape, np.int16) for _ in range(3))
    held = 0
    for d in range(len(x)):
        np.subtract(x[d][:, None], y[d][None, :], out=gap)
        np.abs(gap, out=gap)
        if kept is not None:
            np.bitwise_and(kept[0][d][:, None], kept[1][d][None, :], out=both)
            np.bitwise_and(gap, both, out=gap)
        part += gap
        held += 1
        if held == 32 or d + 1 == len(x) or weight[d + 1] != weight[d]:  # 32 sums of bytes stay below 2 to the 15
            total += np.multiply(part, np.int32(weight[d]), dtype=np.int32)
            part[:] = 0
            held = 0
            if limit is not None and not (open_ & (total <= limit)).any():
                break
    return total


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) if x.dtype == np.int64 else x).astype(np.int64)


def _vectors(packed, ok: np.ndarray) -> np.ndarray:
    """Packed int8 vectors as (files, positions, dimension); a file without any usable vector may be packed at any width."""
    n, positions = ok.shape
    sizes = np.array([len(v) for v in packed])
    width = int(sizes.max()) // positions if n else 1
    out = np.zeros((n, positions * width), np.int8)
    whole = sizes == positions * width
    if (ok.any(axis=1) & ~whole).any():
        raise ValueError("all vectors of one job need the same dimension")
    if whole.any():
        out[whole] = np.frombuffer(b"".join(v for v, w in zip(packed, whole) if w), np.int8).reshape(int(whole.sum()), -1)
    return out.reshape(n, positions, width)


class FeatureBlock:
    """Aligned features of many files, decoded from one Arrow batch.

    Columns: ``gray`` binary (positions concatenated), ``phash`` array<bigint>, ``vec`` binary (int8 positions
    concatenated), ``vec_ok`` array<boolean>, ``is_image`` boolean. Absent columns are simply not decoded.
    """

    def __init__(self, rows: pd.DataFrame):
        self.n = len(rows)
        self.ids = rows["file_id"].to_numpy(np.int64)
        self.is_image = rows["is_image"].to_numpy(bool)
        self.gray = self.phash = self.vec = self.vec_ok = self.weight = None
        if "gray" in rows and self.n and rows["gray"].notna().all():
            self.gray = np.frombuffer(b"".join(rows["gray"]), np.uint8).reshape(self.n, -1, FRAME_PIXELS)
        if "phash" in rows and self.n and rows["phash"].notna().all():
            self.phash = np.array([np.asarray(p, np.int64) for p in rows["phash"]])
        if "vec" in rows and self.n and rows["vec"].notna().all():
            ok = np.array([np.asarray(o, bool) for o in rows["vec_ok"]])
            self.vec_ok = ok
            self.vec = _vectors(rows["vec"], ok)

    def merge_alike(self, *others: "FeatureBlock") -> None:
        """Neighbouring pixels that are alike in every frame of the blocks become one column, with their number as weight."""
        blocks = [b for b in (self, *others) if b.gray is not None]
        if self.gray is None or self.weight is not None:
            return
        differ = np.logical_or.reduce([(b.gray[..., 1:] != b.gray[..., :-1]).any(axis=(0, 1)) for b in blocks])
        first = np.concatenate([[0], np.flatnonzero(differ) + 1])
        weight = np.diff(np.append(first, self.gray.shape[-1])).astype(np.int32)
        order = np.argsort(weight, kind="stable")  # columns of one weight lie together
        for b in blocks:
            b.gray, b.weight = np.ascontiguousarray(b.gray[..., first[order]]), weight[order]

    def flipped(self) -> "FeatureBlock":
        out = object.__new__(FeatureBlock)
        out.__dict__.update(self.__dict__)
        if self.gray is not None:
            flat = self.gray.reshape(-1, FRAME_PIXELS)
            out.gray = mirror_batch(flat).reshape(self.gray.shape)
            if self.phash is not None:
                out.phash = phash_batch(np.ascontiguousarray(out.gray.reshape(-1, FRAME_PIXELS))).reshape(self.phash.shape)
        return out


def _gray_diff(a: FeatureBlock, b: FeatureBlock, i, j, cfg: ScanConfig) -> np.ndarray:
    x, y = a.gray[i], b.gray[j]
    per = masked_fraction(x, y, cfg.ignore_black, cfg.ignore_white, a.weight) if cfg.ignore_black or cfg.ignore_white \
        else sad_fraction(x, y, a.weight)
    total = np.zeros(len(per), np.float32)
    for p in range(per.shape[1]):  # position order fixes the single-precision sum
        total = (total + per[:, p]).astype(np.float32)
    return total


def classic_verdict(a: FeatureBlock, b: FeatureBlock, i, j, cfg: ScanConfig):
    """(matched, difference, algorithm flags) of aligned index pairs without the embedding pass."""
    i, j = np.asarray(i), np.asarray(j)
    n = len(i)
    matched, diff, flags = np.zeros(n, bool), np.ones(n, np.float32), np.zeros(n, np.int16)
    if n == 0:
        return matched, diff, flags
    image = a.is_image[i]
    limit1 = np.float32(1.0) - np.float32(cfg.percent) / np.float32(100.0)
    want_gray = image | (not cfg.use_phash) | cfg.combine
    if a.gray is not None and b.gray is not None and want_gray.any():
        samples = a.gray.shape[1]
        total = _gray_diff(a, b, i, j, cfg)
        with np.errstate(invalid="ignore"):
            ok = want_gray & (total <= np.float32(limit1 * np.float32(samples)))
        d = (total / np.float32(samples)).astype(np.float32)
        matched |= ok
        diff = np.where(ok, d, diff)
        if cfg.combine:
            flags[ok] |= int(MatchFlag.GRAYSCALE)
    if (cfg.use_phash or cfg.combine) and a.phash is not None and b.phash is not None:
        bits = popcount(a.phash[i] ^ b.phash[j])
        samples = bits.shape[1]
        passes = (bits <= allowed_bits(cfg.percent)).sum(axis=1)
        ok = ~image & (passes >= required_matches(samples, cfg.quorum_ratio))
        sim = (np.float32(1.0) - bits.astype(np.float32) / np.float32(64.0)).astype(np.float32)
        d = ((np.float32(1.0) - sim).sum(axis=1, dtype=np.float32) / np.float32(samples)).astype(np.float32)
        diff = np.where(ok, np.where(matched, np.minimum(diff, d), d), diff)
        matched = matched | ok
        if cfg.combine:
            flags[ok] |= int(MatchFlag.PHASH)
    return matched, diff.astype(np.float32), flags


def embedding_similarity(a: FeatureBlock, b: FeatureBlock, i, j) -> np.ndarray:
    """Mean cosine over positions usable on both sides; -1 when fewer than half qualify."""
    x, y = a.vec[i].astype(np.int32), b.vec[j].astype(np.int32)
    cos = np.clip((x * y).sum(axis=2).astype(np.float32) / np.float32(127.0 * 127.0), -1.0, 1.0)
    ok = a.vec_ok[i] & b.vec_ok[j]
    count = ok.sum(axis=1)
    need = max(1, (ok.shape[1] + 1) // 2)
    total = np.where(ok, cos, np.float32(0)).sum(axis=1, dtype=np.float32)
    return np.where(count >= need, total / np.maximum(count, 1), -1.0).astype(np.float32)


def plain_verdict(a: FeatureBlock, b: FeatureBlock, i, j, cfg: ScanConfig):
    """Un-flipped verdict: classic first, the embedding pass only where classic fails."""
    matched, diff, flags = classic_verdict(a, b, i, j, cfg)
    if cfg.use_ai and a.vec is not None and b.vec is not None and len(matched):
        i, j = np.asarray(i), np.asarray(j)
        rest = np.flatnonzero(~matched)
        if len(rest):
            sim = embedding_similarity(a, b, i[rest], j[rest])
            hit = sim >= np.float32(cfg.ai_percent) / np.float32(100.0)
            idx = rest[hit]
            matched[idx] = True
            diff[idx] = np.float32(1.0) - sim[hit]
            flags[idx] = int(MatchFlag.AI_MATCHED)
    return matched, diff, flags


def full_verdict(a: FeatureBlock, b: FeatureBlock, i, j, cfg: ScanConfig, flipped_a: FeatureBlock | None = None):
    """Verdict with the optional flipped pass. Returns (matched, difference, flags, matched_unflipped)."""
    matched, diff, flags = plain_verdict(a, b, i, j, cfg)
    plain = matched.copy()
    if cfg.flip:
        fa = flipped_a or a.flipped()
        fm, fd, ff = classic_verdict(fa, b, i, j, cfg)
        better = fm & (~matched | (fd < diff))
        matched = matched | better
        diff = np.where(better, fd, diff)
        flags = np.where(better, ff | int(MatchFlag.FLIPPED), flags)
    return matched, diff.astype(np.float32), flags.astype(np.int16), plain


def sliding_best(shorter: np.ndarray, longer: np.ndarray, min_sim: float) -> tuple[float, int]:
    """Best offset of ``shorter`` in ``longer`` by mean bit agreement; (0, 0) when nothing reaches ``min_sim``."""
    sim, at = sliding_best_many(shorter[None, :], longer, min_sim)
    return float(sim[0]), int(at[0])


def sliding_best_many(shorter: np.ndarray, longer: np.ndarray, min_sim: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sliding_best` for many clips of one length: (k, m) words against one source."""
    k, m = shorter.shape
    best, at = np.zeros(k, np.float32), np.zeros(k, np.int64)
    if m == 0 or m > len(longer):
        return best, at
    capacity = m * 32
    windows = np.lib.stride_tricks.sliding_window_view(longer, m)
    step = max(1, 2_000_000 // (m * k))  # bounded scratch for long sources
    for start in range(0, len(windows), step):
        bits = np.bitwise_count(windows[None, start:start + step] ^ shorter[:, None, :]).sum(axis=2, dtype=np.int64)
        floor = np.maximum(best, np.float32(min_sim))
        allowed = ((np.float32(1.0) - floor) * np.float32(capacity)).astype(np.float32).astype(np.int64)
        sim = (np.float32(1.0) - bits.astype(np.float32) / np.float32(capacity)).astype(np.float32)
        sim = np.where(bits <= allowed[:, None], sim, np.float32(0.0))
        pos = sim.argmax(axis=1)
        top = sim[np.arange(k), pos]
        better = top > best
        best, at = np.where(better, top, best), np.where(better, start + pos, at)
    return best, at


def allowed_word_bits(m: int, min_sim: float) -> int:
    """Most differing bits of ``m`` words at a similarity of ``min_sim``, in the single precision of :func:`sliding_best`."""
    return max(-1, int(np.floor(np.float32((np.float32(1.0) - np.float32(min_sim)) * np.float32(m * 32)))))


def sliding_least(shorter: np.ndarray, longer: np.ndarray, most: int, scratch: int = 1 << 18):
    """Best windows of all clips (k, m) in all sources (s, n) of one length each: yields (clip, source, bits, position) of the
    pairs whose best window has at most ``most`` differing bits; the first of equal windows counts."""
    (k, m), (s, n) = shorter.shape, longer.shape
    places = n - m + 1
    wide = np.uint32 if (32 * m + 1) * places < 2**32 else np.uint64
    s_step = min(s, max(1, scratch // places))
    k_step = min(k, max(1, scratch // (places * s_step)))
    for s0 in range(0, s, s_step):
        turned = np.ascontiguousarray(longer[s0:s0 + s_step].T)  # a word of all sources is one run
        for k0 in range(0, k, k_step):
            clips = shorter[k0:k0 + k_step]
            bits = np.zeros((len(clips), places, turned.shape[1]), np.uint16 if m < 2048 else np.uint32)
            for i in range(m):
                bits += np.bitwise_count(turned[None, i:i + places] ^ clips[:, i, None, None])
            key = bits.astype(wide) * wide(places) + np.arange(places, dtype=wide)[None, :, None]
            least = key.min(axis=1)
            x, y = np.nonzero(least < wide((most + 1) * places))
            value = least[x, y]
            yield k0 + x, s0 + y, (value // wide(places)).astype(np.int64), (value % wide(places)).astype(np.int64)


def _gradient(x: np.ndarray) -> np.ndarray:
    """(..., n, n) frames -> summed absolute differences to the existing neighbours of each pixel."""
    x = x.astype(np.int16)
    g = np.zeros_like(x)
    dx, dy = np.abs(np.diff(x, axis=-1)), np.abs(np.diff(x, axis=-2))
    g[..., :, 1:] += dx
    g[..., :, :-1] += dx
    g[..., 1:, :] += dy
    g[..., :-1, :] += dy
    return g


def _corners(x: np.ndarray) -> np.ndarray:
    """(..., n, n) -> (..., 4, pixels): the four corner cells in which an overlay may sit."""
    n = x.shape[-1]
    cw, ch = max(4, n // 3), max(4, n // 4)
    cells = [x[..., y0:y0 + ch, x0:x0 + cw].reshape(*x.shape[:-2], ch * cw) for y0 in (0, n - ch) for x0 in (0, n - cw)]
    return np.stack(cells, axis=-2)


def corner_gradients(frames: np.ndarray) -> np.ndarray:
    """Gradients of (frames, n, n) in the corner cells."""
    return _corners(_gradient(frames))


def _one_corner(gain: np.ndarray) -> np.ndarray:
    """(pairs, frames, 4, pixels) gradient gains in the corners -> does the extra energy persist in one corner only?"""
    count, pixels = gain.shape[1], gain.shape[-1]
    won = gain >= 32
    wins = won.sum(axis=1, dtype=np.int16)
    steady = wins >= math.ceil(count * 0.70)
    cells = steady.sum(axis=2)
    out = np.zeros(len(gain), bool)
    some = np.flatnonzero(cells.max(axis=1, initial=0) >= max(5, pixels // 12))
    if not len(some):
        return out
    won, wins, steady, cells = won[some], wins[some], steady[some], cells[some]
    mean_gain = np.where(won, gain[some], 0).sum(axis=1) / np.maximum(wins, 1)
    mean = np.where(steady, mean_gain, 0).sum(axis=2) / np.maximum(cells, 1)
    order = np.argsort(-cells, axis=1, kind="stable")
    rows = np.arange(len(cells))
    first, second = cells[rows, order[:, 0]], cells[rows, order[:, 1]]
    out[some] = (mean[rows, order[:, 0]] >= 45) & (second <= np.maximum(3, np.floor(first * 0.45)))
    return out


def overlay_of_gains(gain: np.ndarray) -> np.ndarray:
    """Per row of corner gains of A over B: bit 1 when A carries a one-corner overlay, bit 2 when B does."""
    return _one_corner(gain).astype(np.int32) + 2 * _one_corner(-gain).astype(np.int32)


def overlay_codes(a_frames: list, b_frames: list) -> np.ndarray:
    """Per pair of frame lists: bit 1 when A carries a one-corner overlay B lacks, bit 2 for the reverse.

    Needs five common square frames of at least 16x16; pairs of equal shape are evaluated together.
    """
    out = np.zeros(len(a_frames), np.int32)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(a_frames, b_frames)):
        count = min(len(a), len(b))
        sizes = {len(f) for f in (*a[:count], *b[:count])}
        side = math.isqrt(next(iter(sizes))) if len(sizes) == 1 else 0
        if count >= 5 and side >= 16 and side * side in sizes:
            shapes.setdefault((count, side), []).append(i)
    for (count, n), idx in shapes.items():
        for s in range(0, len(idx), 256):
            part = idx[s:s + 256]
            stack = lambda fs: corner_gradients(np.frombuffer(b"".join(b"".join(fs[i][:count]) for i in part), np.uint8).reshape(
                len(part), count, n, n))
            out[part] = overlay_of_gains(stack(a_frames) - stack(b_frames))
    return out
