"""Sources, sinks and incremental forms."""

import json

import numpy as np
from pyspark.sql import functions as F

from dupelake.config import ScanConfig, scan_profile
from dupelake.operators import features as FE, ranking as R, selection as K
from dupelake.queries.derive import items
from dupelake.sources import catalog as CA, generate as GE, results as RE
from dupelake.streaming import incremental as IN

SF = "/root/testdata/sf0.001"


def test_catalog_versions(spark, tmp_path):
    root = str(tmp_path / "cat")
    assert CA.read_catalog(spark, root, schema="a int").count() == 0
    CA.write_catalog(spark.range(3), root)
    CA.write_catalog(spark.range(5), root)
    assert CA.read_catalog(spark, root).count() == 5 and CA.read_catalog(spark, root, 1).count() == 3


def test_results_round_trip(spark, tmp_path):
    it = items(spark, SF).withColumn("kbps", F.col("kbps").cast("decimal(18,0)")).withColumn("audio_kbps", F.col("audio_kbps").cast("decimal(18,0)"))
    path = str(tmp_path / "json")
    RE.write_results(it, path)
    back = RE.read_results(spark, path)
    assert back.count() == it.count() and back.select("path").exceptAll(it.select("path")).count() == 0
    for fmt in ("csv", "csv_wide"):
        RE.write_results(it, str(tmp_path / fmt), fmt)
        assert spark.read.option("header", True).csv(str(tmp_path / fmt)).count() == it.count()
    RE.write_results(R.best_flags(it), str(tmp_path / "text"), "text")
    assert spark.read.text(str(tmp_path / "text")).where("value like 'Group %'").count() == it.select("group_id").distinct().count()


def test_not_a_match_shapes_and_envelope(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["x", "y"], ["z"]]))
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "groups": [["x", "y"], ["z"]]}))
    one, two = (sorted(map(tuple, RE.read_not_a_match(spark, str(tmp_path / f)).collect())) for f in ("a.json", "b.json"))
    assert one == two == [(0, "x"), (0, "y"), (1, "z")]
    (tmp_path / "e.json").write_text(json.dumps({"items": [{"group_id": "g", "path": "/a"}, None]}))
    assert [r.path for r in RE.read_envelope(spark, str(tmp_path / "e.json")).collect()] == ["/a"]


def test_generated_catalog_is_reproducible(spark):
    a, b = GE.generate_catalog(spark, 200), GE.generate_catalog(spark, 200)
    assert a.exceptAll(b).count() == 0 and a.count() > 200 and a.select("path").distinct().count() == a.count()


def test_content_key(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"\x01" * 70000)
    (tmp_path / "small.mp4").write_bytes(b"\x01" * 100)
    rows = {r.path.rsplit("/", 1)[1]: r.content_key for r in FE.content_keys(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    word = int.from_bytes(b"\x01" * 8, "little")
    assert rows["small.mp4"] is None and rows["a.mp4"] == f"{(70000 + 2 * 8192 * word) % 2**64:016x}"


def test_stream_refresh_applies_drops_once(spark, tmp_path):
    schema = "file_id long, path string, size long, created timestamp, modified timestamp, content_key string"
    root, drops = str(tmp_path / "cat"), str(tmp_path / "drops")
    row = "select '/a' as path, 5L as size, timestamp'2024-01-01' as created, timestamp'2024-01-01' as modified, 'k' as content_key"
    spark.sql(row).write.mode("append").parquet(drops)
    for _ in range(2):
        s = spark.readStream.schema(spark.read.parquet(drops).schema).parquet(drops)
        IN.stream_refresh(s, root, str(tmp_path / "state"), schema).awaitTermination()
    got = CA.read_catalog(spark, root)
    assert [r.path for r in got.collect()] == ["/a"]
    spark.sql(row.replace("'/a'", "'/b'").replace("5L", "6L")).write.mode("append").parquet(drops)
    s = spark.readStream.schema(spark.read.parquet(drops).schema).parquet(drops)
    IN.stream_refresh(s, root, str(tmp_path / "state"), schema).awaitTermination()
    assert sorted(r.path for r in CA.read_catalog(spark, root).collect()) == ["/a", "/b"]


def test_new_files_match_the_whole_catalog(spark):
    from dupelake.operators.scoring import compare_snapshot
    cfg = ScanConfig(sample_count=2)
    media, frames = GE.generate_compare_corpus(spark, 40)
    snap = compare_snapshot(media, FE.hash_frames(frames), cfg)
    new = snap.where("file_id % 3 = 0")
    got = {(r.a, r.b) for r in IN.match_new(new, snap, cfg).collect()}
    from dupelake.operators.scoring import collapse_copies, matching_pairs
    every = {(r.a, r.b) for r in matching_pairs(collapse_copies(snap, cfg)[0], cfg).collect()}
    assert got == {p for p in every if p[0] % 3 == 0 or p[1] % 3 == 0}


def test_embedding_job_and_profile(spark):
    import numpy as np
    frames = spark.createDataFrame([(1, 0, bytes([3, 4])), (1, 1, bytes([0, 5]))], "file_id long, pos int, rgb binary")
    out = FE.embed_frames(frames, lambda: lambda batch: np.array([list(b) for b in batch], float))
    assert [list(r.vec) for r in out.orderBy("pos").collect()] == [[76, 102], [0, 127]]
    assert scan_profile("deep_clean").use_ai and K.parse_keywords("a，B;\n b") == ["a", "B"]


def test_content_keys_read_both_ends_only(spark, tmp_path):
    """A sparse file of 3 GiB has a key; equal ends of another size have another; small files have none."""
    from dupelake.operators.features import KEY_BYTES, content_keys, head_and_tail, word_sum
    from dupelake.sources.listing import read_listing
    rng = np.random.default_rng(1)
    ends = rng.integers(0, 256, 2 * KEY_BYTES).astype(np.uint8).tobytes()
    big = tmp_path / "a b" / "big.mkv"
    big.parent.mkdir()
    with big.open("wb") as f:
        f.write(ends[:KEY_BYTES])
        f.seek(3 * 2**30 - KEY_BYTES)
        f.write(ends[KEY_BYTES:])
    (tmp_path / "same%20ends.mp4").write_bytes(ends)
    (tmp_path / "one.mp4").write_bytes(ends[:KEY_BYTES])
    (tmp_path / "small.mp4").write_bytes(ends[:KEY_BYTES - 1])
    (tmp_path / "empty.mp4").write_bytes(b"")
    rows = {r.path.rpartition("/")[2]: r for r in read_listing(spark, [str(tmp_path)], with_content_key=True).collect()}
    head, tail = ends[:KEY_BYTES], ends[KEY_BYTES:]
    assert rows["big.mkv"].size == 3 * 2**30 and rows["big.mkv"].content_key == word_sum(3 * 2**30, head, tail)
    assert rows["same%20ends.mp4"].content_key == word_sum(2 * KEY_BYTES, head, tail)
    assert rows["one.mp4"].content_key == word_sum(KEY_BYTES, head, head)
    assert rows["small.mp4"].content_key is None and len(rows) == 4  # file scans leave empty files out
    whole = content_keys(spark.read.format("binaryFile").load(str(tmp_path / "*.mp4"))).collect()
    assert {r.content_key for r in whole} == {rows[n].content_key for n in rows if n != "big.mkv"}

    class Counted:
        asked = 0

        def read_at(self, n, at):
            self.asked += n
            return b"x" * n

    file = Counted()
    head_and_tail(file, 3 * 2**30)
    assert file.asked == 2 * KEY_BYTES


def test_functions_in_sql(spark):
    from dupelake.functions.registry import register_functions
    assert "frame_phash" in register_functions(spark)
    r = spark.sql("""SELECT hash_distance(5, 6) d, hash_similarity(1, NULL) n, int8_similarity(quantize_unit(array(1D, 0D)), quantize_unit(array(1D, 0D))) s,
        frame_phash(NULL) p, frame_is_dark(unhex(repeat('00', 1024))) k, frame_mirror(unhex('01020304')) m""").first()
    assert (r.d, r.n, r.s, r.p, r.k, bytes(r.m)) == (2, None, 1.0, None, True, bytes([2, 1, 4, 3]))
