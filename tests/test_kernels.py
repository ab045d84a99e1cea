"""Kernels and scalar rules against hand values and brute force (no cluster work)."""

import numpy as np
import pandas as pd

from dupelake.config import ScanConfig
from dupelake.functions import kernels as K, vectors as V


def test_allowed_bits_and_quorum():
    assert [V.allowed_bits(p) for p in (90, 92, 94, 96, 98, 99)] == [6, 5, 3, 2, 1, 0]
    assert [V.required_matches(n, 0.6) for n in range(1, 6)] == [1, 2, 2, 3, 3]
    assert V.sign_bound(0.89, 384) == 91


def test_sliding_window_finds_planted_clip():
    rng = np.random.default_rng(42)
    source = rng.integers(0, 2**32, 32, dtype=np.uint32)
    assert K.sliding_best(source[10:26], source, 0.8) == (1.0, 10)
    longer = np.array([1, 2, 0xDEADBEEF, 0xCAFEBABE, 5], np.uint32)
    assert K.sliding_best(np.array([0xDEADBEEF, 0xCAFEBABE], np.uint32), longer, 0.0) == (1.0, 2)
    assert K.sliding_best(source, source[:4], 0.0) == (0.0, 0)


def test_sliding_window_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        long, short = rng.integers(0, 2**32, 40, dtype=np.uint32), rng.integers(0, 2**32, rng.integers(2, 12), dtype=np.uint32)
        best = (0.0, 0)
        for o in range(len(long) - len(short) + 1):
            bits = sum(int(a ^ b).bit_count() for a, b in zip(short, long[o:o + len(short)]))
            sim = float(np.float32(1) - np.float32(bits) / np.float32(32 * len(short)))
            if sim > best[0]:
                best = (sim, o)
        got = K.sliding_best(short, long, 0.0)
        assert got[1] == best[1] and abs(got[0] - best[0]) < 1e-6


def test_hash_is_stable_under_noise_and_matches_full_transform():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (20, 1024)).astype(np.uint8)
    i = np.arange(32)
    full = np.cos((2 * i[None, :] + 1) * i[:, None] * np.pi / 64) * np.sqrt(2 / 32)
    for row, h in zip(x, K.phash_batch(x)):
        ac = (full @ row.reshape(32, 32).astype(float) @ full.T)[1:9, 1:9].ravel()
        med = np.sort(ac)[31:33].mean()
        want = sum(1 << k for k in range(64) if ac[k] > med)
        assert (int(h) & (2**64 - 1) ^ want).bit_count() <= 1


def test_gray_difference_and_masks():
    a, b = np.full((1, 1024), 100, np.uint8), np.full((1, 1024), 132, np.uint8)
    assert K.sad_fraction(a, b)[0] == np.float32(0.125)
    dark = np.zeros((1, 1024), np.uint8)
    assert np.isnan(K.masked_fraction(dark, a, True, False)[0])


def test_mirror_twice_is_identity():
    x = np.random.default_rng(2).integers(0, 256, (3, 1024)).astype(np.uint8)
    assert (K.mirror_batch(K.mirror_batch(x)) == x).all()


def test_overlay_is_one_sided():
    rng = np.random.default_rng(5)
    clean = [np.full((32, 32), 90, np.uint8) for _ in range(6)]
    marked = []
    for f in clean:
        g = f.copy()
        g[:8, :10] = np.where(rng.integers(0, 2, (8, 10)), 250, 5)
        marked.append(g)
    enc = lambda fs: [f.tobytes() for f in fs]
    assert list(K.overlay_codes([enc(marked), enc(clean), enc(clean)], [enc(clean), enc(marked), enc(clean)])) == [1, 2, 0]


def test_combined_verdict_takes_the_better_difference():
    g = np.random.default_rng(9).integers(0, 256, 1024).astype(np.uint8)
    rows = pd.DataFrame({"file_id": [1, 2], "is_image": [False, False], "gray": [g.tobytes(), g.tobytes()], "phash": [[5], [5]]})
    b = K.FeatureBlock(rows)
    m, d, f = K.classic_verdict(b, b, [0], [1], ScanConfig(combine=True))
    assert m[0] and d[0] == 0 and f[0] == 24
