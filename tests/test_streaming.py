"""Drops one after the other against everything at once."""

import os

from pyspark.sql import functions as F

from dupelake.config import ScanConfig
from dupelake.operators import features as FE, grouping as G, scoring as SC
from dupelake.sources import catalog as CA, generate as GE
from dupelake.streaming import incremental as IN


def _rows(df):
    return sorted(map(str, df.collect()))


def _group_sets(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.group_id, set()).add((r.file_id, round(r.similarity, 3), r.flags))
    return sorted(map(sorted, groups.values()))


def test_match_batches_equal_one_match(spark, tmp_path):
    cfg = ScanConfig(sample_count=2)
    media, frames = GE.generate_compare_corpus(spark, 30)
    snap = SC.compare_snapshot(media, FE.hash_frames(frames), cfg)
    early = snap.where("file_id % 4 = 1").withColumn("file_id", F.col("file_id") + 10**9).withColumn("path", F.concat(F.lit("!"), "path"))
    late = snap.where("file_id % 4 = 2").withColumn("file_id", F.col("file_id") + 2 * 10**9).withColumn("path", F.concat("path", F.lit("~")))
    rows = snap.unionByName(early).unionByName(late)
    early = early.cache()
    swapped, other = sorted(r.file_id for r in early.select("file_id").collect())[0], bytearray(snap.orderBy(F.desc("file_id")).first().gray)
    changed = rows.where(F.col("file_id") == swapped).withColumn("gray", F.lit(other)).select(*rows.columns)
    root, step = str(tmp_path / "m"), IN.match_batch(str(tmp_path / "m"), cfg, 8)
    drops = [rows.where("file_id % 3 = 0"), rows.where("file_id % 3 = 1"), rows.where("file_id % 3 = 2"), changed]
    for i, drop in enumerate(drops):
        step(drop, i)
    step(drops[2].where(F.col("file_id") != swapped), 2)  # a replayed drop changes nothing
    now = rows.where(F.col("file_id") != swapped).unionByName(changed)
    reps, _ = SC.collapse_copies(now, cfg)
    want = SC.matching_pairs(reps, cfg)
    assert _rows(IN.matched_edges(spark, root).select(*want.columns)) == _rows(want)
    assert _group_sets(IN.matched_groups(spark, root)) == _group_sets(G.find_duplicates(now, cfg))


def test_new_copy_that_sorts_first_is_linked(spark):
    cfg = ScanConfig(sample_count=2)
    media, frames = GE.generate_compare_corpus(spark, 6)
    snap = SC.compare_snapshot(media, FE.hash_frames(frames), cfg)
    for path in ("!first", "~last"):
        one = snap.agg(F.min("file_id")).first()[0]
        new = snap.where(F.col("file_id") == one).withColumn("file_id", F.lit(10**9).cast("long")).withColumn("path", F.lit(path))
        got = {frozenset((r.a, r.b)) for r in IN.match_new(new, snap, cfg).where("diff = 0").collect()}
        assert frozenset((one, 10**9)) in got


def test_moved_files_keep_their_row_across_drops(spark, tmp_path):
    schema = "path string, size long, created timestamp, modified timestamp, content_key string, gone boolean"
    state = "file_id long, path string, size long, created timestamp, modified timestamp, content_key string, vanished boolean"
    root = str(tmp_path / "cat")
    step = IN.refresh_batch(root, state, buckets=16)
    at = lambda i: f"2024-01-0{i}"
    drop = lambda rows: spark.createDataFrame(
        [(p, n, at(1), at(1), k, g) for p, n, k, g in rows], schema.replace("timestamp", "string")).select(
        "path", "size", F.to_timestamp("created").alias("created"), F.to_timestamp("modified").alias("modified"), "content_key", "gone")
    step(drop([(f"/a/{i}", i, f"k{i}", False) for i in range(40)]), 0)
    ids = {r.path: r.file_id for r in CA.read_catalog(spark, root).collect()}
    step(drop([("/a/1", 1, "k1", True), ("/b/2", 2, "k2", False), ("/a/2", 2, "k2", True), ("/a/4", 5, "k9", False)]), 1)
    step(drop([("/b/1", 1, "k1", False)]), 2)
    files = lambda: {(d, f) for d, _, fs in os.walk(root + "/data") for f in fs if f.endswith(".parquet")}
    before = files()
    step(drop([("/b/1", 1, "k1", False), ("/a/7", 7, "k7", False)]), 3)  # nothing new
    assert files() == before
    rows = {r.path: r for r in CA.read_catalog(spark, root).collect()}
    assert set(rows) == set(ids) - {"/a/1", "/a/2"} | {"/b/1", "/b/2"}
    assert rows["/b/1"].file_id == ids["/a/1"] and rows["/b/2"].file_id == ids["/a/2"] and not any(r.vanished for r in rows.values())
    kinds = {r.path: (r.change, r.keep_features) for r in spark.read.parquet(root + "/changes/batch=1").collect()}
    assert kinds == {"/a/1": ("missing", True), "/b/2": ("relinked", True), "/a/4": ("replaced", False)}
    touched = {d for d, _ in before if "/00000003/" in d + "/"}
    assert 1 <= len(touched) <= 2  # the buckets of one moved file, of sixteen


def test_whole_folders_tell_what_vanished(spark, tmp_path):
    state = "file_id long, path string, size long, created timestamp, modified timestamp, content_key string, vanished boolean"
    root = str(tmp_path / "cat")
    row = "select '{}' as path, 5L as size, timestamp'2024-01-01' as created, timestamp'2024-01-01' as modified, '{}' as content_key"
    many = lambda *r: spark.sql(" union all ".join(row.format(*x) for x in r))
    step = IN.refresh_batch(root, state, whole_folders=True)
    step(many(("/a/x", "1"), ("/a/y", "2"), ("/c/z", "3")), 0)
    step(many(("/a/x", "1"), ("/d/y", "2")), 1)
    got = {r.path: r.vanished for r in CA.read_catalog(spark, root).collect()}
    assert got == {"/a/x": False, "/d/y": False, "/c/z": False}
    step(many(("/d/q", "7")), 2)
    assert {r.path: r.vanished for r in CA.read_catalog(spark, root).collect()}["/d/y"]
