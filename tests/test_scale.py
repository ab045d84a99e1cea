"""Work that has to grow with the input and the result, not with the pairs that are looked at."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dupelake.config import ScanConfig
from dupelake.functions import kernels as K
from dupelake.operators import scoring as SC
from dupelake.plans.blocks import ENOUGH_BLOCKS, GROWTH, cell_sizes


def _rows(n: int, samples: int, coarse: bool, seed: int = 5) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    side = rng.integers(0, 256, (n, samples, 32, 2), dtype=np.uint8)
    gray = np.repeat(side, 16, axis=3) if coarse else rng.integers(0, 256, (n, samples, 32, 32), dtype=np.uint8)
    gray = gray.reshape(n, samples, 1024)
    gray[1::7] = np.clip(gray[0::7][:len(gray[1::7])].astype(int) + 9, 0, 255)   # near copies
    gray[2::7] = gray[0::7][:len(gray[2::7])].reshape(-1, samples, 32, 32)[..., ::-1].reshape(-1, samples, 1024)   # mirrored
    gray[3::7] = 0
    vec = rng.integers(-40, 40, (n, samples, 64)).astype(np.int8)
    vec[4::7] = vec[0::7][:len(vec[4::7])]
    return pd.DataFrame({
        "file_id": np.arange(n), "path": [f"/{(i * 37) % n:03}" for i in range(n)], "fk": [str(i % 3) for i in range(n)], "size": 1.0, "dev": 1.0, "inode": 1.0,
        "is_image": samples == 1, "duration_s": rng.choice([100.0, 101.0, 150.0], n), "gray": [g.tobytes() for g in gray],
        "phash": list(K.phash_batch(gray.reshape(-1, 1024)).reshape(n, samples)), "vec": [v.tobytes() for v in vec],
        "vec_ok": list(rng.random((n, samples)) < 0.8)})


@pytest.mark.parametrize("coarse", [True, False])
@pytest.mark.parametrize("change", [
    dict(percent=80.0), dict(percent=80.0, flip=True), dict(percent=80.0, ignore_black=True, ignore_white=True, flip=True),
    dict(percent=97.0, use_ai=True, ai_percent=30.0), dict(percent=80.0, combine=True, ignore_black=True, flip=True),
    dict(percent=80.0, use_phash=True, use_ai=True, ai_percent=20.0, folder_mode="different")])
def test_rectangles_of_pairs_give_the_verdict_of_single_pairs(change, coarse, monkeypatch):
    cfg = ScanConfig(sample_count=2, **change)
    rows = _rows(70, 2, coarse)
    whole = K.FeatureBlock(rows)
    rank = {int(f): (p, f) for f, p in zip(rows["file_id"], rows["path"])}
    i, j = map(np.array, zip(*[(a, b) for a in range(70) for b in range(70) if rank[a] < rank[b]]))
    m, diff, flags, plain = K.full_verdict(whole, whole, i, j, cfg)
    d = rows["duration_s"].to_numpy()
    m &= np.abs(d[i] - d[j]) <= np.minimum(d[i], d[j]) * cfg.duration_percent / 100
    if cfg.folder_mode == "different":
        m &= rows["fk"].to_numpy()[i] != rows["fk"].to_numpy()[j]
    want = {(int(a), int(b), float(x), int(f), bool(p)) for a, b, x, f, p in zip(i[m], j[m], diff[m], flags[m], plain[m])}

    asked = []
    one_by_one = SC.full_verdict
    monkeypatch.setattr(SC, "full_verdict", lambda a, b, x, y, *more: asked.append(len(x)) or one_by_one(a, b, x, y, *more))
    at = np.arange(70)
    got = SC._score_block(K.FeatureBlock(rows), rows, at, at, True, cfg, False, cfg.use_phash or cfg.combine)
    assert {(int(r.a), int(r.b), float(r.diff), int(r.flags), bool(r.plain)) for r in got.itertuples()} == want and len(got) == len(want)
    assert len(want) > 0 and sum(asked) <= len(want) + 2   # only pairs that match are compared one by one


def test_alike_pixels_count_once():
    block = K.FeatureBlock(_rows(20, 1, True))
    whole = K.FeatureBlock(_rows(20, 1, True))
    block.merge_alike()
    assert block.gray.shape[-1] == 64 and block.weight.sum() == 1024
    i, j = np.triu_indices(20, 1)
    for cfg in (ScanConfig(percent=70.0), ScanConfig(percent=70.0, ignore_black=True)):
        for x, y in zip(K.full_verdict(block, block, i, j, cfg), K.full_verdict(whole, whole, i, j, cfg)):
            assert (x == y).all()


def test_rows_are_sent_to_few_blocks(spark):
    rows = spark.range(3000).select("id", F.lit(1).alias("cell"))
    blocks = lambda n, size: cell_sizes(rows.limit(n), size, growth=GROWTH).first()["blocks"]
    assert blocks(3000, 10) == 38 and blocks(1000, 10) == ENOUGH_BLOCKS and blocks(50, 10) == 5


@pytest.mark.parametrize("change", [dict(percent=85.0, flip=True), dict(percent=85.0)])
def test_large_components_of_images_settle_in_claim_rounds(spark, change, monkeypatch):
    """Copies, mirrored matches and all: the same groups as the replay in one task, without the round per member."""
    from dupelake.operators import grouping as G
    from dupelake.queries.streams import vectors_with_copies

    def never(*_):
        raise AssertionError("images without gates need no merge rounds")

    monkeypatch.setattr(G, "_merge_rounds", never)
    cfg = ScanConfig(**change)
    few = vectors_with_copies(spark, "/root/testdata/sf0.001", cfg).where("file_id % 1000000 < 150")
    reps, members = (G.cut_lineage(d) for d in SC.collapse_copies(few, cfg))
    pairs = G.cut_lineage(SC.matching_pairs(reps, cfg))
    replayed, claimed = ({tuple(r) for r in G.merge_pairs(reps, members, pairs, cfg.with_(replay_limit=n)).collect()} for n in (10**6, 2))
    assert claimed == replayed and len(claimed) > 60


def test_one_pass_claims_like_the_rounds(spark, monkeypatch):
    """Components of images go through one pass per component; the rounds beyond ``SCAN_PAIRS`` give the same groups."""
    from dupelake.operators import grouping as G
    from dupelake.queries.streams import vectors_with_copies

    cfg = ScanConfig(percent=85.5, flip=True, replay_limit=2)
    few = vectors_with_copies(spark, "/root/testdata/sf0.001", cfg).where("file_id % 1000000 < 120")
    reps, members = (G.cut_lineage(d) for d in SC.collapse_copies(few, cfg))
    pairs = G.cut_lineage(SC.matching_pairs(reps, cfg))
    stored = []
    monkeypatch.setattr(G, "store", lambda df, real=G.store: stored.append(1) or real(df))
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(G, "SCAN_PAIRS", most, raising=False)
        found.append(({tuple(r) for r in G.merge_pairs(reps, members, pairs, cfg).collect()}, len(stored)))
    assert found[0][0] == found[1][0] and len(found[0][0]) > 40
    assert found[0][1] == 1 and found[1][1] > 10   # no round is stored
