"""Operators on small frames, against hand values and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dupelake.config import ScanConfig
from dupelake.functions import formats as T, paths as P
from dupelake.functions.kernels import FeatureBlock, full_verdict, mirror_batch, phash
from dupelake.operators import candidates as C, features as FE, folders as FO, grouping as G, ranking as R, scoring as SC
from dupelake.plans import skew


def test_duration_tolerance(spark):
    cases = [(1, 0, 0, 3600, 36), (1, 0, 0, 60, 0.6), (1, 5, 0, 60, 5), (1, 0, 10, 3600, 10), (1, 5, 10, 700, 7),
             (0, 0, 0, 3600, 0), (0, 0, 15, 60, 15), (0, 8, 0, 50, 8), (0, 5, 15, 50, 15)]
    for p, lo, hi, d, want in cases:
        cfg = ScanConfig(duration_percent=p, duration_min_s=lo, duration_max_s=hi)
        got = spark.range(1).select(C.duration_tolerance(F.lit(float(d)), cfg)).first()[0]
        assert got == pytest.approx(want)


@pytest.mark.parametrize("cfg", [dict(), dict(duration_percent=1.0, duration_min_s=5.0), dict(duration_percent=20.0, duration_min_s=5.0, duration_max_s=60.0),
                                 dict(duration_percent=0.0, duration_max_s=3.0), dict(duration_percent=0.0)])
def test_duration_pairs_equal_brute_force(spark, cfg):
    cfg = ScanConfig(**cfg)
    rng = np.random.default_rng(4)
    d = np.round(np.exp(rng.uniform(-2, 8, 150)), 1)
    df = spark.createDataFrame(pd.DataFrame({"file_id": np.arange(150), "duration_s": d}))
    got = {(r.a, r.b) for r in C.duration_pairs(df, cfg).collect()}
    tol = SC._tolerances(d, cfg)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if abs(d[i] - d[j]) <= min(tol[i], tol[j])}
    assert got == want


def _corpus(spark):
    rng = np.random.default_rng(7)
    media, frames = [], []

    def add(g, d):
        k = len(media)
        media.append((k, f"/lib/{rng.integers(0, 9)}/v{k:05d}.mp4", False, float(d)))
        frames.extend((k, p, float(p), g[p].tobytes(), False) for p in range(2))

    for base in range(36):
        g, d = rng.integers(0, 256, (2, 1024)).astype(np.uint8), int(rng.integers(30, 600))
        add(g, d)
        if base % 6 == 0:
            for _ in range(3):
                amp = int(rng.integers(0, 30))
                add(np.clip(g.astype(int) + rng.integers(-amp, amp + 1, g.shape), 0, 255).astype(np.uint8), d + int(rng.integers(0, 3)))
            add(g, d)
            add(g, d)
        if base % 12 == 0:
            add(mirror_batch(g), d)
    m = spark.createDataFrame(pd.DataFrame(media, columns=["file_id", "path", "is_image", "duration_s"]))
    f = spark.createDataFrame(pd.DataFrame(frames, columns=["file_id", "pos", "sec", "gray", "dark"]))
    return m, f.withColumn("phash", phash("gray"))


@pytest.mark.parametrize("cfg", [dict(), dict(use_phash=True, percent=92.0), dict(combine=True, flip=True, percent=92.0),
                                 dict(combine=True, percent=90.0, folder_mode="different"), dict(use_phash=True, flip=True, percent=92.0),
                                 dict(use_phash=True, flip=True, percent=88.0, quorum_ratio=0.5, duration_percent=2.0),
                                 dict(use_phash=True, flip=True, percent=94.0, duration_percent=0.0, folder_mode="same")])
def test_matching_pairs_equal_brute_force(spark, cfg):
    cfg = ScanConfig(sample_count=2, block_rows=16, **cfg)
    media, frames = _corpus(spark)
    media = media.withColumn("folder", P.folder_of("path"))
    reps, members = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg), cfg)
    reps = skew.cut_lineage(reps)
    assert members.count() == media.count() and reps.count() < media.count()
    rows = SC.matching_pairs(reps, cfg).collect()
    got = {(r.a, r.b): (round(r.diff, 5), r.flags, r.plain) for r in rows}
    assert len(got) == len(rows)
    p = reps.withColumn("fk", C.folder_key("folder", cfg)).toPandas().sort_values(["path", "file_id"]).reset_index(drop=True)
    block = FeatureBlock(p)
    i, j = np.triu_indices(len(p), 1)
    d, fk = p["duration_s"].to_numpy(), p["fk"].to_numpy(object)
    ok = np.abs(d[i] - d[j]) <= np.minimum(d[i], d[j]) * cfg.duration_percent / 100
    if cfg.folder_mode != "none":
        ok &= (fk[i] == fk[j]) == (cfg.folder_mode == "same")
    i, j = i[ok], j[ok]
    m, diff, flags, plain = full_verdict(block, block, i, j, cfg)
    want = {(a, b): (round(float(x), 5), int(f), bool(q)) for a, b, x, f, q in zip(block.ids[i[m]], block.ids[j[m]], diff[m], flags[m], plain[m])}
    assert got == want and (cfg.folder_mode == "same" or want)


@pytest.mark.parametrize("mirrored", [False, True])
def test_hash_pairs_of_new_files_and_hot_keys(spark, mirrored):
    """A third of the files shares one hash; with ``is_new`` only pairs of two known files are missing."""
    cfg = ScanConfig(sample_count=3, use_phash=True, percent=95.0, duration_percent=5.0)
    rng = np.random.default_rng(3)
    n = 120
    words = rng.integers(-2**62, 2**62, (n, 3))
    words[: n // 3] = words[0]
    words[60:90] = words[30:60] ^ (np.int64(1) << rng.integers(0, 60, (30, 3)))
    turned = words[::-1] if mirrored else words
    d = rng.uniform(50, 90, n)
    pdf = pd.DataFrame({"file_id": rng.permutation(n), "path": [f"/p{k:03d}" for k in rng.permutation(n)], "folder": "/p", "duration_s": d,
                        "phash": list(words), "phash_flip": list(turned), "is_new": rng.random(n) < 0.3})
    files = spark.createDataFrame(pdf)
    bits, need = C.allowed_bits(95.0), C.required_matches(3, cfg.quorum_ratio)
    want, fresh = {}, set()
    for x in range(n):
        for y in range(n):
            if pdf.path[x] < pdf.path[y] and abs(d[x] - d[y]) <= 0.05 * min(d[x], d[y]):
                k = int((np.bitwise_count(turned[x] ^ words[y]) <= bits).sum())
                if k >= need:
                    want[int(pdf.file_id[x]), int(pdf.file_id[y])] = k
                    fresh |= {(int(pdf.file_id[x]), int(pdf.file_id[y]))} if pdf.is_new[x] or pdf.is_new[y] else set()
    for part, expected in ((files.drop("is_new"), set(want)), (files, fresh)):
        rows = C.hash_pairs(part, cfg, 3, mirrored).collect()
        assert len(rows) == len(expected) > 0 and {(r.a, r.b) for r in rows} == expected
        assert all(want[r.a, r.b] == r.matches for r in rows)


def test_chain_is_split_and_flipped_pair_survives(spark):
    media, frames = _corpus(spark)
    cfg = ScanConfig(sample_count=2)
    out = G.find_duplicates(SC.compare_snapshot(media, frames, cfg), cfg).toPandas()
    assert (out.groupby("group_id").size() > 1).all() and out["file_id"].is_unique


def test_one_clip_two_sources_keeps_the_first(spark):
    m = spark.createDataFrame([(1, 9, 0.9, 3), (2, 9, 0.95, 4), (2, 8, 0.9, 1)], "source_id long, clip_id long, sim double, offset_s int")
    a = {(r.source_id, r.clip_id) for r in G.assign_clips(m, [F.col("source_id")]).collect()}
    assert a == {(1, 9), (2, 8)}
    only = G.emit_clips(G.assign_clips(m.where("clip_id = 9"), [F.col("source_id")])).collect()
    assert {r.file_id for r in only} == {1, 9}


def test_dense_slot_usability(spark):
    black, bright, other = bytes(3 * 16), bytes([200]) * 48, bytes([90]) * 48
    rows = [(1, i, f) for i, f in enumerate([black, bright, bright, other, black])]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["file_id", "slot", "rgb"]))
    got = [r.usable for r in FE.dense_slot_usability(df).orderBy("slot").collect()]
    assert got == [False, True, False, True, False]


def test_message_and_path_functions(spark):
    msgs = ["it's 12 of '3 files' done", 'open "a 1', "plain 42 x 7"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string").select(T.normalize_message("m").alias("k"))
    assert [r.k for r in df.collect()] == ["it'*'# files'", 'open "', "plain # x #"]
    r = spark.range(1).select(P.folder_of(F.lit("C:\\a\\b.mp4")).alias("f"), P.normalize_path(F.lit(" /x/y// ")).alias("n"),
                              P.file_name(F.lit("/x/y.mkv")).alias("b"), T.bytes_text(F.lit(1536)).alias("s")).first()
    assert (r.f, r.n, r.b, r.s) == ("C:/a", "/x/y", "y.mkv", "1.5 KB")


def test_coverage_of_contained_folder(spark):
    df = spark.createDataFrame([(100, 80, 80), (80, 80, 80)], "total long, files long, groups long")
    got = df.select(FO.coverage_percent(F.col("groups"), FO.resource_estimate(F.col("total"), F.col("files"), F.col("groups")))).collect()
    assert [r[0] for r in got] == [80.0, 100.0]


def _items(spark):
    rng = np.random.default_rng(11)
    n = 120
    return spark.createDataFrame(pd.DataFrame({
        "group_id": rng.integers(0, 12, n).astype(str), "path": [f"/p/{k:04d}" for k in range(n)], "size": rng.integers(1, 50, n),
        "duration_s": 100.0, "frame_size_int": rng.integers(1, 4, n) * 1000, "w": 640, "h": 360, "kbps": rng.integers(10, 30, n) * 100,
        "fps": 25.0, "audio_kbps": 128, "audio_sample_rate": 48000, "hdr": "", "format": "h264", "audio_format": "aac", "audio_channel": "stereo",
        "is_image": False, "flags": 0, "similarity": 100.0}))


def test_hot_groups_give_the_same_results(spark):
    it = skew.cut_lineage(_items(spark))
    run = lambda: (
        {(r.group_id, r.winner) for r in R.decisive_winner(it).collect()},
        {(r.path, r.decided_by) for r in R.pick_keeper(it, R.resolve_criteria([])[:3]).where("is_keeper").collect()},
        {(r.path, r.k) for r in skew.rank_within(it, "group_id", [F.col("size"), F.col("path")], "k").collect()})
    normal = run()
    spark.conf.set(skew.HOT_ROWS_CONF, "5")
    try:
        assert run() == normal
    finally:
        spark.conf.unset(skew.HOT_ROWS_CONF)


def test_weighted_scores_by_sorting_equal_arrays(spark):
    it = R._with_ratios(_items(spark)).withColumn("hdr_rank", F.lit(0))
    a = {r.path: r.score for r in R._scores_in_arrays(it, "group_id", "path").collect()}
    b = {r.path: r.score for r in R._scores_by_sorting(it, "group_id", "path").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_score_pairs_of_mixed_types_and_missing_vectors(spark):
    import numpy as np

    from dupelake.config import ScanConfig
    from dupelake.operators.scoring import compare_snapshot, matching_pairs, score_pairs

    rng = np.random.default_rng(1)
    frame = lambda: bytes(rng.integers(60, 200, 1024, dtype=np.uint8))
    shot = [frame() for _ in range(6)]
    media = spark.createDataFrame([(i, f"/m/{i}", i % 3 == 0, 60.0) for i in range(6)], "file_id long, path string, is_image boolean, duration_s double")
    frames = [(i, p, 0.0, shot[i % 2] if i < 4 else shot[i], None, False) for i in range(6) for p in range(1 if i % 3 == 0 else 2)]
    frames.append(frames[1])  # a doubled position
    frames = spark.createDataFrame(frames, "file_id long, pos int, sec double, gray binary, phash long, dark boolean")
    vec = [int(v) for v in rng.integers(-127, 127, 16)]
    vecs = spark.createDataFrame([(i, p, vec) for i in (4, 5) for p in range(2)], "file_id long, pos int, vec array<tinyint>")
    cfg = ScanConfig(sample_count=2, percent=99.0, use_ai=True, ai_percent=1.0)
    snap = compare_snapshot(media, frames, cfg, vecs)
    assert snap.count() == 6
    pairs = spark.createDataFrame([(0, 1), (1, 3), (1, 2), (4, 5), (2, 5)], "a long, b long")
    got = {(r.a, r.b): r.matched for r in score_pairs(pairs, snap, cfg).collect()}
    assert got[0, 1] is False and got[1, 3] is False and len(got) == 5
    assert got[2, 5] is False  # no vectors on one side
    assert {(r.a, r.b) for r in matching_pairs(snap.withColumn("copies", F.lit(1)), cfg).collect()} <= {(0, 3), (4, 5), (1, 2), (1, 4), (2, 4), (1, 5)}


def test_quarantine_takes_the_latest_attempt(spark):
    from dupelake.operators.relocate import quarantine

    catalog = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 0)], "path string, flags int")
    events = spark.createDataFrame([
        (1, "sampling", "a", "begin"), (2, "sampling", "a", "end"), (3, "sampling", "a", "begin"), (1, "audio", "b", "begin"), (2, "audio", "b", "end"),
        (5, "audio", "c", "begin"), (5, "audio", "c", "end")], "ts int, phase string, path string, event string")
    assert {r.path: r.flags for r in quarantine(catalog, events).collect()} == {"a": 4, "b": 0, "c": 1 | 64, "d": 0}


def test_short_tracks_keep_an_empty_fingerprint(spark):
    from dupelake.operators.features import audio_fingerprint, fingerprint_status

    pcm = spark.createDataFrame([(1, 0, [100] * 3000), (2, 0, [0] * 30_000)], "file_id long, chunk long, samples array<smallint>")
    words = audio_fingerprint(pcm)
    assert {r.file_id: len(r.words) > 0 for r in words.collect()} == {1: False, 2: True}
    media = spark.createDataFrame([(1, 0), (2, 0)], "file_id long, flags int")
    assert {r.file_id: r.flags for r in fingerprint_status(media, words).collect()} == {1: 32, 2: 128}


def test_preview_of_an_empty_plan_confirms_no_bytes(spark):
    plan = spark.createDataFrame([], "set_id string, group_id string, path string, size bigint, action string, reason string, move boolean")
    unique = spark.createDataFrame([], "state string, size bigint")
    r = FO.consolidation_preview(plan, unique).first()
    assert (r["reclaim_user_bytes"], r["matched_files"], r["groups"], r["reclaim_bytes"]) == (0, 0, 0, None)


def test_folder_matches_from_summaries_and_row_by_row(spark, monkeypatch):
    it = _items(spark).withColumn("path", F.concat(F.lit("/f"), F.substring("path", -1, 1), F.lit("/x"), F.substring("path", 4, 4)))
    it = skew.cut_lineage(it.unionByName(it.where("path like '/f3/%'")))  # some rows come twice
    run = lambda: sorted(tuple(str(v) for v in r) for r in FO.folder_pair_matches(it).select(
        "folder_a", "folder_b", "group_id", "files_a", "files_b", "review_only", "auto_review", "winner").collect())
    n = {(r.group_id, r.f): r.n for r in it.groupBy("group_id", P.folder_of("path").alias("f")).agg(F.count("*").alias("n")).collect()}
    rows = run()
    assert any(r[-1] != "None" for r in rows)
    assert all((int(r[3]), int(r[4])) == (n[r[2], r[0]], n[r[2], r[1]]) for r in rows)
    monkeypatch.setattr(FO, "PAIR_GROUP", 10)
    assert run() == rows
    exchanges = FO._matches_of_summaries(it, None, "group_id")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == 2  # one for each side, of items; no pair is shuffled


@pytest.mark.parametrize("cfg", [dict(percent=96.0), dict(percent=90.0), dict(percent=96.0, quorum_ratio=0.1)])
def test_first_shared_key_is_the_first_equal_band_key(spark, cfg):
    cfg = ScanConfig(use_phash=True, sample_count=3, **cfg)
    rng = np.random.default_rng(5)
    x = rng.integers(-2**63, 2**63 - 1, (300, 3))
    y = np.where(rng.random((300, 3)) < 0.3, rng.integers(-2**63, 2**63 - 1, (300, 3)), x ^ (1 << rng.integers(0, 63, (300, 3))) ^ (1 << rng.integers(0, 63, (300, 3))))
    df = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y.tolist()}), "x array<bigint>, y array<bigint>")
    same = F.zip_with(C.hash_band_keys("x", 3, cfg), C.hash_band_keys("y", 3, cfg), lambda a, b: a == b)
    rows = df.select(F.array_position(same, True).alias("want"), C.first_shared_key("x", "y", 3, cfg).alias("got")).collect()
    assert [r.want or None for r in rows] == [None if r.got is None else r.got + 1 for r in rows] and any(r.want for r in rows)


def _shuffles(df) -> int:
    """Exchanges of the rows by group: those of the plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_keepers_by_number_equal_keepers_by_path(spark):
    """A window pass carries numbers for the items, a hot pass their order columns; both choose alike, also with null kinds."""
    it = _items(spark).withColumn("is_image", F.expr("CASE WHEN substr(path, -1) = '3' THEN NULL WHEN substr(path, -1) = '7' THEN true ELSE false END"))
    it = skew.cut_lineage(it.withColumn("duration_s", F.expr("100.0 + crc32(path) % 4")))
    crit = R.resolve_criteria(["Bitrate"])
    run = lambda hot: {(r.path, r.is_keeper, r.decided_by) for r in R.keeper_step(
        R._with_ratios(it), skew.GroupPasses("group_id", hot), crit).collect()}
    assert run(False) == run(True)


def test_recommendation_deals_the_items_once(spark):
    from dupelake.operators import selection as K

    it = skew.cut_lineage(_items(spark))
    assert _shuffles(R.likely_winner(it)) == 1
    assert _shuffles(R.recommend_best(it)) == 1
    assert _shuffles(R.recommend_best(it, ["Resolution"])) == 1
    assert _shuffles(K.smart_non_best(it.withColumn("folder", F.lit("/p")), best_criteria=[])) == 1


def test_wide_and_hot_groups_get_the_same_recommendation(spark, monkeypatch):
    from dupelake.operators import selection as K

    it = skew.cut_lineage(_items(spark).withColumn("folder", F.lit("/p")).withColumn("created", F.lit(0)))
    rules = [K.Rule("non_best"), K.Rule("lower_bitrate")]
    run = lambda: (
        {tuple(r) for r in R.recommend_best(it).collect()}, {tuple(r) for r in R.recommend_best(it, ["Bitrate"]).collect()},
        {tuple(r) for r in R.likely_winner(it).collect()}, {r.path for r in K.smart_non_best(it, best_criteria=[]).collect()},
        {(r.path, r.action, r.tie_break) for r in K.rule_assistant(it, rules, True, best_criteria=[]).collect()},
        {(r.path, r.action, r.tie_break) for r in K.rule_assistant(it, rules).collect()})
    normal = run()
    monkeypatch.setattr(R, "_ARRAY_GROUP", 8)
    spark.conf.set(skew.HOT_ROWS_CONF, "9")
    try:
        assert run() == normal
    finally:
        spark.conf.unset(skew.HOT_ROWS_CONF)


def test_components_by_contraction(spark):
    """Long chains in shuffled order, a star, doubled and turned edges, self loops and nulls against union by hand."""
    rng = np.random.default_rng(11)
    ids = rng.permutation(400)
    pairs = [(int(ids[i]), int(ids[i + 1])) for i in range(0, 150)] + [(int(ids[200]), int(ids[k])) for k in range(201, 240)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:5] + [(int(ids[300]), int(ids[300])), (int(ids[301]), None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        if y is not None and x != y:
            parent[max(root(x), root(y))] = min(root(x), root(y))
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert G.connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_frame_energies_need_little_memory():
    """1 500 frames in one batch: as many scratch bytes as for a few, and the same values."""
    import tracemalloc

    import pyarrow as pa

    pcm = np.random.default_rng(2).integers(-20000, 20000, (1500, FE.AUDIO_FRAME)).astype(np.int16)
    samples = pa.ListArray.from_arrays(pa.array(np.arange(1501) * FE.AUDIO_FRAME, pa.int32()), pa.array(pcm.reshape(-1)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(1500, np.int64)), pa.array(np.arange(1500)), samples], names=["file_id", "frame", "samples"])
    tracemalloc.start()
    out = pa.Table.from_batches(list(FE.frame_energies(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # 148 MB with the whole batch at once, growing with it
    got = np.stack([out[f"c{i}"].to_numpy() for i in range(12)], axis=1)
    assert np.array_equal(got, FE.chroma_energies(pcm * (1.0 / 32768.0)))


def test_best_flags_deal_the_items_once(spark):
    it = skew.cut_lineage(_items(spark))
    out = R.best_flags(it).select("path", *R.BEST_COLUMNS)
    assert _shuffles(out) == 1
    normal = {tuple(r) for r in out.collect()}
    spark.conf.set(skew.HOT_ROWS_CONF, "9")
    try:
        assert {tuple(r) for r in R.best_flags(it).select("path", *R.BEST_COLUMNS).collect()} == normal
    finally:
        spark.conf.unset(skew.HOT_ROWS_CONF)


def test_dense_clips_of_a_block_equal_pairs_alone(spark):
    """Sources and clips that meet in one product give what each pair gives alone; a row without usable slots gives nothing."""
    from dupelake.operators import partial as PA

    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 64))
    base = np.rint(base / np.linalg.norm(base, axis=1, keepdims=True) * 127).astype(int)
    cut = {1: (30, 0), 2: (12, 5), 3: (9, 14), 4: (25, 2), 5: (6, 0)}
    media = spark.createDataFrame([(f, f"/x{f}", False, 10.0 * n) for f, (n, _) in cut.items()], "file_id long, folder string, is_image boolean, duration_s double")
    rows = [(f, k, 5.0, [int(v) for v in base[at + k]] if f != 5 and (f, k) != (2, 3) else None) for f, (n, at) in cut.items() for k in range(n)]
    dense = skew.cut_lineage(spark.createDataFrame(rows, "file_id long, slot int, interval_s float, vec array<tinyint>"))
    cfg = ScanConfig(ai_partial_hit_percent=25.0)
    run = lambda m: {tuple(r) for r in PA.dense_clip_matches(m, dense, cfg).collect()}
    whole = run(media)
    assert {(r[0], r[1], r[3]) for r in whole} >= {(1, 2, 25), (1, 3, 70), (1, 4, 10)}
    alone = set().union(*[run(media.where(F.col("file_id").isin(a, b))) for a, b in ((1, 2), (1, 3), (1, 4), (1, 5), (4, 2), (4, 3), (4, 5), (2, 3), (2, 5), (3, 5))])
    assert whole == alone


@pytest.mark.parametrize("mode", ["none", "same", "different"])
def test_audio_bindings_equal_bound_matches_of_single_pairs(spark, mode):
    from dupelake.functions.kernels import sliding_best
    from dupelake.operators import partial as PA
    rng = np.random.default_rng(3)
    words = [rng.integers(1, 2**32, 12) for _ in range(6)]
    rows = []
    for i in range(120):
        n = int(rng.integers(2, 13))
        w = np.where(rng.random(n) < 0.5, words[i % 6][:n], rng.integers(1, 2**32, n)) if i < 90 else np.array(rows[i - 60][4], np.int64) % 2**32
        rows.append((i, "/f" + str(i // 6 % 2), f"p{(i * 7) % 100}", float(10 * len(w)), [int(x) - 2**32 if x >= 2**31 else int(x) for x in w]))
    media = spark.createDataFrame([(*r[:4], False, 0) for r in rows], "file_id long, folder string, path string, duration_s double, is_image boolean, flags int")
    audio = spark.createDataFrame([(r[0], r[4]) for r in rows], "file_id long, words array<int>")
    cfg = ScanConfig(partial_similarity=0.7, folder_mode=mode)
    unsigned = [np.array(r[4], np.int64).astype(np.uint32) for r in rows]
    want = set()
    for s in rows:
        for c in rows:
            gate = mode == "none" or (s[1] == c[1]) == (mode == "same")
            if len(c[4]) < len(s[4]) and cfg.partial_min_ratio <= c[3] / s[3] < 0.95 and gate:
                sim, at = sliding_best(unsigned[c[0]], unsigned[s[0]], 0.7)
                if sim >= np.float32(0.7):
                    want.add((s[0], c[0], float(sim), int(at)))
    found = PA.audio_clip_matches(media, audio, cfg)
    assert {tuple(r) for r in found.select("source_id", "clip_id", F.col("sim").cast("double"), "offset_s").collect()} == want and want
    names = ["source_id", "clip_id", "sim", "offset_s", "group_id"]
    bound = {tuple(r) for r in PA.bind_clips(found, media).select(*names).collect()}
    assert {tuple(r) for r in PA.audio_bindings(media, audio, cfg).select(*names).collect()} == bound
    met = PA._audio_meetings(PA._audio_classes(media, audio, cfg, None)[0], cfg, True).groupBy("clip_id").count().agg(F.max("count")).first()[0]
    assert met <= 5  # one source a clip and meeting, and no more meetings than octaves linked


def test_light_recordings_share_large_blocks(spark):
    from dupelake.operators import partial as PA
    rows = spark.createDataFrame([(i, 50.0, "/c", [1] * 5) for i in range(640)], "file_id long, duration_s double, folder string, words array<int>")
    met = lambda **more: len(PA._ratio_meetings(rows, ScanConfig(), ["words"], 64, **more).collect())
    assert met(weight=F.size("words"), block_weight=PA.BLOCK_WORDS) == 2 * 640  # one block: each row once as source and once as clip
    assert met() == 2 * 640 * 10


def test_normal_paths_skip_the_pattern(spark):
    odd = ["/a/b", "/a/b/", "/", "//", "", " /a ", "a\\b\\", "/a/\n", "/a//\r\n", "/a/ ", "/a\n", "\\", "/a/ ", "/a/\u0085", None, "/ä/ß"]
    plain = lambda c: F.regexp_replace(F.translate(F.trim(F.coalesce(c, F.lit(""))), "\\", "/"), "(?<=.)/+$", "")
    df = spark.createDataFrame([(p,) for p in odd], "path string").select("path", P.normalize_path("path").alias("new"), plain(F.col("path")).alias("old"))
    assert [r.new for r in df.collect()] == [r.old for r in df.collect()]
    assert "CASE WHEN" in df.select("new")._jdf.queryExecution().optimizedPlan().toString()
