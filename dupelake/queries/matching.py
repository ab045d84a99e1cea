"""Candidate, scoring and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import vectors as V
from ..functions.kernels import is_dark, phash
from ..functions.registry import register_functions
from ..operators import candidates as C, diagnostics, features as FE, grouping as G, scoring as SC
from ..plans.skew import cut_lineage
from . import query
from .derive import ORDER_MEDIA_SQL, embeddings, order_media, table

O = ORDER_MEDIA_SQL


def _tol(p: float) -> str:
    return f"abs(a.duration_s - b.duration_s) <= least(a.duration_s * {p} / 100.0, b.duration_s * {p} / 100.0)"


@query(f"""SELECT a.file_id AS a, b.file_id AS b, a.duration_s AS duration_a, b.duration_s AS duration_b FROM {O} a JOIN {O} b
 ON a.kind = b.kind AND a.file_id < b.file_id AND b.duration_s BETWEEN a.duration_s * 0.9998 AND a.duration_s * 1.0002 AND {_tol(0.01)}""")
def duration_pairs_tight(spark, sf):
    return C.duration_pairs(order_media(spark, sf), ScanConfig(duration_percent=0.01), ["kind"])


@query(f"""SELECT a.file_id AS a, b.file_id AS b, a.duration_s AS duration_a, b.duration_s AS duration_b FROM {O} a JOIN {O} b
 ON a.folder = b.folder AND a.kind = b.kind AND a.file_id < b.file_id AND {_tol(20.0)}""")
def duration_pairs_same_folder(spark, sf):
    return C.duration_pairs(order_media(spark, sf), ScanConfig(folder_mode="same", folder_depth=1), ["kind"])




@query(f"""SELECT a.file_id AS a, b.file_id AS b FROM {O} a JOIN {O} b ON a.kind = b.kind AND a.file_id < b.file_id AND a.folder <> b.folder
 AND b.duration_s BETWEEN a.duration_s - 0.03 AND a.duration_s + 0.03
 AND abs(a.duration_s - b.duration_s) <= least(least(greatest(a.duration_s * 0.002 / 100.0, 0.01), 0.03), least(greatest(b.duration_s * 0.002 / 100.0, 0.01), 0.03))""")
def duration_pairs_bounded_other_folder(spark, sf):
    cfg = ScanConfig(folder_mode="different", duration_percent=0.002, duration_min_s=0.01, duration_max_s=0.03)
    return C.duration_pairs(order_media(spark, sf), cfg, ["kind"]).select("a", "b")


@query(f"""SELECT s.file_id AS source_id, c.file_id AS clip_id FROM {O} s JOIN {O} c ON s.folder = c.folder AND s.file_id <> c.file_id
 AND s.duration_s >= 1 AND c.duration_s >= 1 AND c.duration_s / s.duration_s >= 0.1 AND c.duration_s / s.duration_s < 0.95""")
def clip_ratio_pairs(spark, sf):
    return C.ratio_pairs(order_media(spark, sf), 0.1, ScanConfig(folder_mode="same"))


def _h(expr: str, spark: bool) -> str:
    if spark:
        return f"CAST(conv(substr(md5(CAST({expr} AS STRING)), 1, 15), 16, 10) AS BIGINT)"
    return f"CAST('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 15) AS BIGINT)"


def _hash_cols(spark: bool) -> dict[str, str]:
    x = (lambda a, b: f"({a} ^ {b})") if spark else (lambda a, b: f"xor({a}, {b})")
    shl = (lambda e: f"shiftleft(CAST(1 AS BIGINT), CAST({e} AS INT))") if spark else (lambda e: f"(CAST(1 AS BIGINT) << CAST({e} AS INT))")
    return {"p0": x(_h("o_custkey", spark), shl("o_orderkey % 60")),
            "p1": x(_h("o_custkey + 1000000", spark), f"CASE WHEN o_orderkey % 3 = 0 THEN {_h('o_orderkey', spark)} ELSE {shl('o_orderkey % 7')} END"),
            "p2": x(_h("o_custkey + 2000000", spark), f"CASE WHEN o_orderkey % 4 = 0 THEN {_h('o_orderkey', spark)} ELSE {shl('o_orderkey % 11')} END")}


_HC = _hash_cols(False)
_HSQL = "(SELECT o_orderkey AS file_id, CAST(o_totalprice / 100 AS DOUBLE) AS duration_s, " + ", ".join(f"{e} AS {n}" for n, e in _HC.items()) + " FROM orders)"


def _hashes(spark, sf):
    cols = [f"{e} AS {n}" for n, e in _hash_cols(True).items()]
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS file_id", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS path", "CAST(o_totalprice / 100 AS DOUBLE) AS duration_s",
        *cols).withColumn("phash", F.array("p0", "p1", "p2"))


@query(f"""WITH h AS MATERIALIZED {_HSQL}, p AS (SELECT a.file_id AS a, b.file_id AS b, bit_count(xor(a.p0, b.p0)) d0, bit_count(xor(a.p1, b.p1)) d1, bit_count(xor(a.p2, b.p2)) d2
 FROM h a JOIN h b ON a.file_id < b.file_id AND {_tol(20.0)} AND bit_count(xor(a.p0, b.p0)) + bit_count(xor(a.p1, b.p1)) + bit_count(xor(a.p2, b.p2)) <= 68)
SELECT a, b, CAST((d0 <= 2)::INT + (d1 <= 2)::INT + (d2 <= 2)::INT AS INT) AS matches, round((d0 + d1 + d2) / 192.0, 5) AS diff FROM p
 WHERE (d0 <= 2)::INT + (d1 <= 2)::INT + (d2 <= 2)::INT >= 2""")
def hash_quorum_pairs(spark, sf):
    cfg = ScanConfig(use_phash=True, sample_count=3)
    return C.hash_pairs(cut_lineage(_hashes(spark, sf)), cfg, 3).select("a", "b", "matches", F.round(F.col("diff").cast("double"), 5).alias("diff"))


# --- frames and vectors from the embeddings -----------------------------------------------------------------------

_Q = "list_transform(embedding, lambda x: CAST(greatest(0, least(255, round_even(128 + CAST(x AS DOUBLE) * 300, 0))) AS INT))"
_E = f"(SELECT vec_id, label, {_Q} AS q, list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 127, 0))) AS INT)) AS v FROM embeddings)"
_SAD = "list_sum(list_transform(range(1, 65), lambda i: abs(a.q[i] - b.q[i]))) * 16"


def vector_media(spark, sf, images: bool):
    """One file per vector: the 64 components are the cells of a 32x32 frame."""
    e = embeddings(spark, sf)
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.lit(128) + x * 300, 0).cast("int"))))
    cell = lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 16)
    media = e.select(F.col("vec_id").alias("file_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("path"),
                     F.concat(F.lit("/l"), F.col("label").cast("string")).alias("folder"), F.lit(images).alias("is_image"),
                     (F.lit(100.0) + F.col("label")).alias("duration_s"), F.lit(0).alias("flags"))
    frames = e.select(F.col("vec_id").alias("file_id"), F.lit(0).alias("pos"), F.lit(0.0).alias("sec"),
                      F.unhex(F.array_join(F.transform(px, cell), "")).alias("gray"))
    return media, frames.withColumn("phash", F.lit(None).cast("bigint")).withColumn("dark", is_dark("gray"))


def _file_pairs(reps, members, cfg):
    """Pairs of all files, copies too, matched by their representatives."""
    reps = cut_lineage(reps)
    return SC.pairs_of_files(SC.matching_pairs(reps, cfg), reps, members, cfg)


@query(f"""WITH e AS MATERIALIZED {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_SAD} / 262144.0 AS diff FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT a, b, CAST(diff AS DOUBLE) AS diff FROM p WHERE diff <= 0.135""")
def gray_image_pairs(spark, sf):
    cfg = ScanConfig(percent=86.5)
    media, frames = vector_media(spark, sf, True)
    reps, members = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg), cfg)
    return _file_pairs(reps, members, cfg).select("a", "b", F.col("diff").cast("double").alias("diff"))


@query(f"""WITH e AS MATERIALIZED {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_SAD} / 262144.0 AS diff FROM e a JOIN e b ON a.vec_id < b.vec_id
  AND a.label = b.label)
SELECT a, b, CAST(diff AS DOUBLE) AS diff FROM p WHERE diff <= 0.145""")
def gray_video_pairs_same_folder(spark, sf):
    cfg = ScanConfig(percent=85.5, folder_mode="same")
    media, frames = vector_media(spark, sf, False)
    reps, members = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg), cfg)
    return _file_pairs(reps, members, cfg).select("a", "b", F.col("diff").cast("double").alias("diff"))


@query(f"""WITH e AS MATERIALIZED {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b,
 list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.q[i] > 32 AND b.q[i] > 32 AND a.q[i] < 240 AND b.q[i] < 240 THEN abs(a.q[i] - b.q[i]) ELSE 0 END)) AS s,
 list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.q[i] > 32 AND b.q[i] > 32 AND a.q[i] < 240 AND b.q[i] < 240 THEN 1 ELSE 0 END)) AS n
 FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT a, b, round(s / n / 256.0, 5) AS diff FROM p WHERE n > 0 AND s / n / 256.0 <= 0.13""")
def gray_pairs_ignoring_black_and_white(spark, sf):
    cfg = ScanConfig(percent=87.0, ignore_black=True, ignore_white=True)
    media, frames = vector_media(spark, sf, True)
    reps, members = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg), cfg)
    return _file_pairs(reps, members, cfg).select("a", "b", F.round(F.col("diff").cast("double"), 5).alias("diff"))


@query(f"""WITH e AS MATERIALIZED {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / 16129.0 AS c
 FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT a, b, round(c, 5) AS similarity FROM p WHERE c >= 0.35""")
def embedding_pairs(spark, sf):
    cfg = ScanConfig(percent=99.9, use_ai=True, ai_percent=35.0)
    media, frames = vector_media(spark, sf, False)
    vecs = embeddings(spark, sf).select(F.col("vec_id").alias("file_id"), F.lit(0).alias("pos"), V.quantize_unit("embedding").alias("vec"))
    reps, _ = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg, vecs), cfg)
    return SC.matching_pairs(cut_lineage(reps), cfg).select("a", "b", F.round(F.lit(1.0) - F.col("diff").cast("double"), 5).alias("similarity"))


def _shared_hash(spark: bool) -> str:
    """One hash per label and sixteenth of the vectors, with one bit that differs between its files."""
    bit = "shiftleft(CAST(1 AS BIGINT), CAST(vec_id % 60 AS INT))" if spark else "(CAST(1 AS BIGINT) << CAST(vec_id % 60 AS INT))"
    base = _h("label * 100 + vec_id % 16", spark)
    return f"({base} ^ {bit})" if spark else f"xor({base}, {bit})"


@query(f"""WITH e AS MATERIALIZED (SELECT *, {_shared_hash(False)} AS ph FROM {_E}),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_SAD} / 262144.0 AS gray, bit_count(xor(a.ph, b.ph)) AS bits FROM e a JOIN e b ON a.vec_id < b.vec_id
  AND abs(a.label - b.label) <= least(100.0 + a.label, 100.0 + b.label) * 0.02)
SELECT a, b, round(CASE WHEN gray <= 0.145 AND bits <= 9 THEN least(gray, bits / 64.0) WHEN gray <= 0.145 THEN gray ELSE bits / 64.0 END, 5) AS diff,
 CAST(CASE WHEN gray <= 0.145 THEN 8 ELSE 0 END + CASE WHEN bits <= 9 THEN 16 ELSE 0 END AS INT) AS flags FROM p WHERE gray <= 0.145 OR bits <= 9""")
def combined_pairs(spark, sf):
    """Videos that match by their frames, by their hashes or by both."""
    cfg = ScanConfig(percent=85.5, combine=True, sample_count=1, duration_percent=2.0)
    media, frames = vector_media(spark, sf, False)
    hashes = table(spark, sf, "embeddings").selectExpr("vec_id AS file_id", f"{_shared_hash(True)} AS phash")
    frames = frames.drop("phash").join(hashes, "file_id")
    reps, members = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg), cfg)
    return _file_pairs(reps, members, cfg).select("a", "b", F.round(F.col("diff").cast("double"), 5).alias("diff"),
                                                            F.col("flags").cast("int").alias("flags"))


@query(f"""WITH h AS MATERIALIZED (SELECT *, p0 AS f0, CASE WHEN file_id % 2 = 0 THEN xor(p1, 2) ELSE p1 END AS f1, xor(p2, -1) AS f2 FROM {_HSQL}),
 p AS (SELECT a.file_id AS a, b.file_id AS b, bit_count(xor(a.f0, b.p0)) d0, bit_count(xor(a.f1, b.p1)) d1, bit_count(xor(a.f2, b.p2)) d2
 FROM h a JOIN h b ON a.file_id < b.file_id AND {_tol(20.0)} AND bit_count(xor(a.f0, b.p0)) <= 2)
SELECT a, b, CAST((d0 <= 2)::INT + (d1 <= 2)::INT + (d2 <= 2)::INT AS INT) AS matches, round((d0 + d1 + d2) / 192.0, 5) AS diff FROM p
 WHERE d1 <= 2 OR d2 <= 2""")
def flipped_hash_pairs(spark, sf):
    """Mirrored hashes of the first file against the hashes of the second; the last position never matches mirrored."""
    cfg = ScanConfig(use_phash=True, sample_count=3)
    files = _hashes(spark, sf).withColumn("phash_flip", F.expr("array(p0, CASE WHEN file_id % 2 = 0 THEN p1 ^ 2 ELSE p1 END, ~p2)"))
    return C.hash_pairs(cut_lineage(files), cfg, 3, mirrored=True).select("a", "b", "matches", F.round(F.col("diff").cast("double"), 5).alias("diff"))


def duplicate_groups_from_frames(spark, sf):
    cfg = ScanConfig(percent=86.0, flip=True)
    media, frames = vector_media(spark, sf, True)
    return G.find_duplicates(SC.compare_snapshot(media, frames, cfg), cfg)


query()(duplicate_groups_from_frames)


@query(f"""WITH e AS MATERIALIZED {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.vec_id % 4 = 0 AS ia, b.vec_id % 4 = 0 AS ib, abs(a.label - b.label) AS gap,
  least(100.0 + a.label, 100.0 + b.label) * 0.01 AS tol, {_SAD} / 262144.0 AS diff FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
 g AS (SELECT *, ia = ib AS type_ok, ia OR gap <= tol AS duration_ok, ia = ib AND diff <= 0.145 AS similarity_ok FROM p)
SELECT a, b, true AS extension_ok, true AS inclusion_ok, type_ok, duration_ok, true AS folder_ok, similarity_ok, true AS hard_link_ok, CAST(NULL AS VARCHAR) AS reason_a, CAST(NULL AS VARCHAR) AS reason_b,
 CAST(gap AS DOUBLE) AS duration_gap, CASE WHEN similarity_ok THEN round(1 - diff, 5) ELSE 0 END AS similarity, false AS flip_used,
 CASE WHEN NOT type_ok THEN 'type' WHEN NOT duration_ok THEN 'duration' WHEN NOT similarity_ok THEN 'similarity' END AS first_failed_gate,
 type_ok AND duration_ok AND similarity_ok AS duplicate FROM g""")
def pair_explanations(spark, sf):
    """Every file with the next one; images and videos of two samples are mixed."""
    cfg = ScanConfig(percent=85.5, duration_percent=1.0, scan_whole_catalog=True, sample_count=2)
    media, frames = vector_media(spark, sf, False)
    image = F.col("file_id") % 4 == 0
    media = media.withColumn("is_image", image).withColumn("path", F.concat("path", F.when(image, ".jpg").otherwise(".mp4"))).withColumn(
        "exists", F.lit(True)).withColumn("size", F.col("file_id") * 1000)
    second = frames.where("file_id % 4 <> 0").withColumn("pos", F.lit(1))
    snap = SC.compare_snapshot(media, frames.unionByName(second), cfg)
    pairs = media.select(F.col("file_id").alias("a"), (F.col("file_id") + 1).alias("b")).join(
        media.select(F.col("file_id").alias("b")), "b", "left_semi").select("a", "b")
    out = diagnostics.explain_pairs(pairs, media, snap, cfg)
    return out.withColumn("similarity", F.round(F.col("similarity").cast("double"), 5))


@query(f"""WITH e AS MATERIALIZED (SELECT *, list_sum(list_transform(q, lambda x: CASE WHEN x <= 32 THEN 1 ELSE 0 END)) >= 0.8 * 64 AS dark FROM {_E}),
 p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / 16129.0 AS c
  FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE a.vec_id % 3 <> 0 AND b.vec_id % 3 <> 0 AND NOT a.dark AND NOT b.dark)
SELECT a, b, round(c, 5) AS similarity FROM p WHERE c >= 0.35""")
def embedding_pairs_with_missing_vectors(spark, sf):
    """A third of the files has no vector, others lack one of three positions; two of three are enough."""
    cfg = ScanConfig(percent=99.9, use_ai=True, ai_percent=35.0, sample_count=3)
    media, frames = vector_media(spark, sf, False)
    third = F.explode(F.sequence(F.lit(0), F.lit(2)))
    frames = frames.drop("pos").withColumn("pos", third)
    vecs = embeddings(spark, sf).where("vec_id % 3 <> 0").select(F.col("vec_id").alias("file_id"), third.alias("pos"), V.quantize_unit("embedding").alias("vec"))
    vecs = vecs.where("file_id % 5 <> 0 or pos <> 1")
    reps, _ = SC.collapse_copies(SC.compare_snapshot(media, frames, cfg, vecs), cfg)
    return SC.matching_pairs(cut_lineage(reps), cfg).select("a", "b", F.round(F.lit(1.0) - F.col("diff").cast("double"), 5).alias("similarity"))


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 127, 0))) AS INT)), ',') AS quantised
 FROM embeddings""")
def quantised_vectors(spark, sf):
    q = F.transform(V.quantize_unit("embedding"), lambda x: x.cast("string"))
    return embeddings(spark, sf).select("vec_id", F.array_join(q, ",").alias("quantised"))


@query("""SELECT vec_id, CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) AS signature,
 CAST(bit_count(CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT)) AS INT) AS negatives
 FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] < 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INT) ELSE CAST(0 AS HUGEINT) END)) AS w FROM embeddings)""")
def sign_signatures(spark, sf):
    w = V.sign_words("embedding", 64)[0]
    return embeddings(spark, sf).select("vec_id", w.alias("signature"), F.bit_count(w).alias("negatives"))


def frame_hashes(spark, sf):
    _, frames = vector_media(spark, sf, True)
    return frames.select("file_id", phash("gray").alias("phash"), V.unsigned_text(phash("gray")).cast("string").alias("unsigned"))


query()(frame_hashes)


def mirrored_frame_hashes(spark, sf):
    _, frames = vector_media(spark, sf, True)
    return FE.backfill_hashes(FE.flip_frames(frames)).select("file_id", "phash")


query()(mirrored_frame_hashes)


@query(f"""SELECT vec_id AS file_id, round(CASE WHEN s > 0 THEN s / 1984.0 ELSE 0 END, 5) AS detail FROM (SELECT vec_id,
 list_sum(list_transform(range(1, 65, 2), lambda i: abs(q[i] - q[i + 1]))) + 16 * list_sum(list_transform(range(1, 63), lambda i: abs(q[i] - q[i + 2]))) AS s FROM {_E})""")
def detail_scores(spark, sf):
    _, frames = vector_media(spark, sf, True)
    return FE.detail_scores(frames).select("file_id", F.round("detail", 5).alias("detail"))


@query(f"""SELECT a.vec_id, round(CASE WHEN s > 0 THEN s / 1984.0 ELSE 0 END, 5) AS detail, dark, CAST(bit_count(xor({_shared_hash(False)}, CAST(label AS BIGINT))) AS INT) AS distance,
 round(list_sum(list_transform(range(1, 65), lambda i: v[i] * v[65 - i])) / 16129.0, 6) AS folded FROM (SELECT *,
 list_sum(list_transform(range(1, 65, 2), lambda i: abs(q[i] - q[i + 1]))) + 16 * list_sum(list_transform(range(1, 63), lambda i: abs(q[i] - q[i + 2]))) AS s,
 list_sum(list_transform(q, lambda x: CASE WHEN x <= 32 THEN 1 ELSE 0 END)) >= 0.8 * 64 AS dark FROM {_E}) a""")
def functions_in_sql(spark, sf):
    """The registered functions, called from SQL text."""
    register_functions(spark)
    _, frames = vector_media(spark, sf, True)
    e = embeddings(spark, sf).selectExpr("vec_id", f"{_shared_hash(True)} AS ph", "CAST(label AS BIGINT) AS label", "embedding")
    return spark.sql("""WITH t AS (SELECT e.*, f.gray, quantize_unit(embedding) AS v FROM {e} e JOIN {f} f ON f.file_id = e.vec_id)
SELECT vec_id, round(frame_detail(frame_mirror(gray)), 5) AS detail, frame_is_dark(gray) AS dark, hash_distance(ph, label) AS distance,
 round(int8_similarity(v, reverse(v)), 6) AS folded FROM t""", e=e, f=frames)


@query(f"SELECT vec_id AS file_id, list_sum(list_transform(q, lambda x: CASE WHEN x <= 32 THEN 1 ELSE 0 END)) >= 0.8 * 64 AS too_dark FROM {_E}")
def dark_files(spark, sf):
    _, frames = vector_media(spark, sf, True)
    return FE.dark_files(frames)


@query(f"""SELECT file_id, i AS pos, round(least(duration_s, 3000.0) * CASE i WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.75 END, 6) AS sec FROM {O}, range(3) t(i)""")
def sample_positions(spark, sf):
    p = FE.sample_positions(order_media(spark, sf), ScanConfig(sample_count=3, max_sampling_s=3000.0))
    return p.select("file_id", "pos", F.round("sec", 6).alias("sec"))


@query(f"SELECT file_id, round(greatest(greatest(5.0, least(15.0, duration_s / 60.0)), duration_s / 400.0), 6) AS interval_s FROM {O}")
def dense_intervals(spark, sf):
    return order_media(spark, sf).select("file_id", F.round(FE.dense_interval("duration_s"), 6).alias("interval_s"))


# --- clustering on given relations --------------------------------------------------------------------------------

@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS u, 'p' || CAST(l_partkey AS VARCHAR) AS v FROM lineitem),
 s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(n, m) USING KEY (n) AS (SELECT DISTINCT u, u FROM s UNION
  SELECT s.v, min(r.m) FROM r JOIN s ON s.u = r.n JOIN recurring.r AS o ON o.n = s.v WHERE r.m < o.m GROUP BY s.v)
SELECT n AS node, m AS component FROM r""")
def linked_components(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr("concat('s', l_suppkey) as a", "concat('p', l_partkey) as b").distinct()
    return G.connected_components(e)


@query("""SELECT md5(text) AS group_id, doc_id AS file_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def exact_text_copies(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("group_id"), F.col("doc_id").alias("file_id"))
    return G.drop_singleton_groups(d)


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS clip_id, l_quantity, l_orderkey, l_linenumber, l_extendedprice FROM lineitem),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY source_id, l_orderkey, l_linenumber, l_extendedprice) rk FROM m) WHERE rk = 1)
SELECT source_id AS group_id, source_id AS file_id, CAST(0 AS DOUBLE) AS diff, 0 AS flags, CAST(0 AS DOUBLE) AS clip_offset_s FROM a GROUP BY 1
UNION ALL SELECT source_id, clip_id + 1000000, round(1 - l_quantity / 50, 5), 2, CAST(l_linenumber AS DOUBLE) FROM a""")
def clip_assignment(spark, sf):
    m = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as source_id", "l_partkey + 1000000 as clip_id", "l_quantity / 50 as sim", "l_linenumber as offset_s", "l_orderkey", "l_extendedprice")
    a = G.assign_clips(m, [F.col("source_id"), F.col("l_orderkey"), F.col("offset_s"), F.col("l_extendedprice")])
    return G.emit_clips(a).select("group_id", "file_id", F.round(F.col("diff").cast("double"), 5).alias("diff"),
                                  F.col("flags").cast("int").alias("flags"), "clip_offset_s")
