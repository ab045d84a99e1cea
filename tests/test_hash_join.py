"""The hash join: key rows a file sends, frequent bands and passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dupelake.config import ScanConfig
from dupelake.operators import candidates as C


def _files(n=150):
    rng = np.random.default_rng(8)
    words = rng.integers(-2**62, 2**62, (n, 3))
    words[:60, 0] = words[0, 0]                                                     # one frequent hash at one position
    words[100:] = words[50:100] ^ (np.int64(1) << rng.integers(0, 60, (n - 100, 3)))  # near copies
    turned = np.roll(words, 2, axis=0)
    return pd.DataFrame({"file_id": rng.permutation(n), "path": [f"/p{k:03d}" for k in rng.permutation(n)], "folder": [f"/{k % 50 % 2}" for k in range(n)],
                         "duration_s": rng.uniform(60, 120, n), "phash": list(words), "phash_flip": list(turned), "is_new": rng.random(n) < 0.4})


@pytest.mark.parametrize("change", [dict(), dict(folder_mode="same", duration_percent=0.0, duration_max_s=30.0)])
@pytest.mark.parametrize("mirrored", [False, True])
def test_frequent_bands_and_passes_change_no_pair(spark, mirrored, change, monkeypatch):
    for name, value in (("HOT_FILES", 5), ("PILOT_HITS", 4), ("PASS_ROWS", 800)):
        monkeypatch.setattr(C, name, value, raising=False)
    cfg = ScanConfig(sample_count=3, use_phash=True, percent=96.0, **change)
    pdf = _files()
    bits, need = C.allowed_bits(96.0), C.required_matches(3, cfg.quorum_ratio)
    tol = (lambda d: d * 0.2) if cfg.duration_percent else (lambda d: 30.0)
    left, right, d = np.array(list(pdf["phash_flip" if mirrored else "phash"])), np.array(list(pdf["phash"])), pdf["duration_s"].to_numpy()
    want, fresh = set(), set()
    for x in range(len(pdf)):
        for y in range(len(pdf)):
            gate = {"none": True, "same": pdf.folder[x] == pdf.folder[y], "different": pdf.folder[x] != pdf.folder[y]}[cfg.folder_mode]
            if gate and pdf.path[x] < pdf.path[y] and abs(d[x] - d[y]) <= min(tol(d[x]), tol(d[y])):
                if (np.bitwise_count(left[x] ^ right[y]) <= bits).sum() >= need:
                    pair = int(pdf.file_id[x]), int(pdf.file_id[y])
                    want.add(pair)
                    fresh |= {pair} if pdf.is_new[x] or pdf.is_new[y] else set()
    files = spark.createDataFrame(pdf)
    for part, expected in ((files.drop("is_new"), want), (files, fresh)):
        rows = [(r.a, r.b) for r in C.hash_pairs(part, cfg, 3, mirrored).collect()]
        assert sorted(rows) == sorted(expected) and len(expected) > 5


def test_a_file_sends_few_key_rows(spark):
    """Six bands a file (nine pairs of bands for each of three pairs of positions before), read by both sides of the join."""
    files = spark.createDataFrame(_files()).drop("is_new")
    plan = C.hash_pairs(files, ScanConfig(sample_count=3, use_phash=True, percent=96.0), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert len(C._probes(3, ScanConfig(sample_count=3, use_phash=True, percent=96.0))) == 6 and plan.count("Generate explode") == 4
