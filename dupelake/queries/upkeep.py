"""Snapshot eligibility, feature upkeep, review lists and folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import paths as P
from ..operators import candidates as CA, eligibility as E, features as FE, folders as FO, grouping as G, maintenance as M, quality as QU, stats as S
from ..sources.listing import count_folder_trees
from . import query
from .derive import CATALOG_SQL, ITEMS_SQL, MEDIA_SQL, from_sql, items, media, table

C, D, I = CATALOG_SQL, MEDIA_SQL, ITEMS_SQL

# --- frames: positions 0..2 of every page, some doubled, some missing, some of a wrong length -----------------------
_F = f"""(SELECT file_id, CAST(p AS INT) AS pos, CASE WHEN file_id % 9 = 4 AND p = 1 THEN 256 ELSE 1024 END AS bytes FROM (SELECT file_id FROM {D}), range(3) t(p)
 WHERE NOT (file_id % 5 = 2 AND p = 2) UNION ALL SELECT file_id, 0, 1024 FROM {D} WHERE file_id % 5 = 2)"""


def _frames(spark, sf):
    m = media(spark, sf).select("file_id")
    each = m.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("not (file_id % 5 = 2 and pos = 2)")
    twice = m.where("file_id % 5 = 2").withColumn("pos", F.lit(0))
    size = F.when((F.col("file_id") % 9 == 4) & (F.col("pos") == 1), 256).otherwise(1024)
    return each.unionByName(twice).withColumn("gray", F.repeat(F.lit("x"), size).cast("binary"))


@query(f"""WITH f AS {_F}, g AS (SELECT file_id, count(DISTINCT pos) FILTER (bytes = 1024) AS good, count(*) FILTER (bytes <> 1024) AS odd FROM f GROUP BY 1)
SELECT file_id FROM {D} JOIN g USING (file_id) WHERE odd = 0 AND good >= CASE WHEN is_image THEN 1 ELSE 3 END""")
def complete_snapshots(spark, sf):
    return E.complete_snapshots(media(spark, sf), _frames(spark, sf), ScanConfig(sample_count=3)).select("file_id")


@query(f"SELECT file_id FROM {D} JOIN (SELECT file_id, count(*) AS n FROM {_F} GROUP BY 1) USING (file_id) WHERE (flags & 4) = 0 AND (is_image OR n >= 3)")
def compare_eligible_files(spark, sf):
    return E.compare_eligible(media(spark, sf), _frames(spark, sf), ScanConfig(sample_count=3)).select("file_id")


@query(f"SELECT file_id, pos FROM {_F} WHERE bytes = 1024")
def healed_frames(spark, sf):
    return M.heal_frames(_frames(spark, sf)).select("file_id", "pos")


@query(f"SELECT file_id, pos FROM {_F} WHERE file_id NOT IN (SELECT file_id FROM {D} WHERE is_image AND file_id % 3 = 0)")
def frames_of_current_version(spark, sf):
    m = media(spark, sf).withColumn("feature_version", F.when(F.col("file_id") % 3 == 0, F.lit(None)).otherwise(1).cast("int"))
    return M.invalidate_features(_frames(spark, sf), m).select("file_id", "pos")


@query(f"""SELECT file_id, CAST(CASE WHEN size % 3 = 0 THEN flags & ~252 ELSE flags END AS INT) AS flags FROM {D}""")
def flags_after_clearing_features(spark, sf):
    m = media(spark, sf)
    return M.clear_features(m, _frames(spark, sf), m.where("size % 3 = 0").select("path"))[0].select("file_id", "flags")


@query(f"SELECT file_id, pos FROM {_F} WHERE file_id NOT IN (SELECT file_id FROM {D} WHERE size % 3 = 0)")
def frames_after_clearing_features(spark, sf):
    m = media(spark, sf)
    return M.clear_features(m, _frames(spark, sf), m.where("size % 3 = 0").select("path"))[1].select("file_id", "pos")


@query(f"SELECT file_id, CAST(CASE WHEN file_id % 7 = 0 THEN flags | 2 ELSE flags END AS INT) AS flags FROM {C}")
def excluded_files(spark, sf):
    c = from_sql(spark, sf, C, "part")
    return M.exclude_files(c, c.where("file_id % 7 = 0").select("path")).select("file_id", "flags")


# --- audio --------------------------------------------------------------------------------------------------------
_W = "[CASE WHEN doc_id % 4 = 1 THEN 0 ELSE doc_id % 5 + i END FOR i IN range(0, doc_id % 3 * 2)]"


def _words(spark, sf):
    n = (F.col("doc_id") % 3 * 2).cast("int")
    w = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(F.col("doc_id") % 4 == 1, 0).otherwise(F.col("doc_id") % 5 + i).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.slice(w, F.lit(1), n).alias("words"))


@query(f"SELECT doc_id, len({_W}) > 0 AND len([x FOR x IN {_W} IF x <> 0]) = 0 AS silent FROM documents")
def silent_fingerprints(spark, sf):
    return _words(spark, sf).select("doc_id", E.silent_words("words").alias("silent"))


@query(f"""SELECT file_id, CAST(flags | CASE WHEN file_id % 6 = 5 THEN 0 WHEN file_id % 6 = 4 THEN 64 WHEN len(w) = 0 THEN 32 WHEN len([x FOR x IN w IF x <> 0]) = 0 THEN 128 ELSE 0 END AS INT) AS flags,
 CASE WHEN file_id % 6 IN (4, 5) OR len(w) > 0 AND len([x FOR x IN w IF x <> 0]) = 0 THEN -1 ELSE len(w) END AS n_words
 FROM (SELECT doc_id AS file_id, CAST(doc_id % 2 AS INT) AS flags, {_W} AS w FROM documents)""")
def fingerprint_status(spark, sf):
    w = _words(spark, sf).withColumnRenamed("doc_id", "file_id")
    m = w.select("file_id", (F.col("file_id") % 2).cast("int").alias("flags"))
    audio = w.where("file_id % 6 <> 5").withColumn("words", F.when(F.col("file_id") % 6 != 4, F.col("words")))
    out = FE.fingerprint_status(m, audio)
    return out.select("file_id", F.col("flags").cast("int").alias("flags"), F.coalesce(F.size("words"), F.lit(-1)).alias("n_words")).withColumn(
        "n_words", F.when(F.col("n_words") < 0, -1).otherwise(F.col("n_words")))


# --- folders, names, counters -------------------------------------------------------------------------------------

@query(f"""SELECT DISTINCT folder AS root, (SELECT count(*) FROM {I} j WHERE j.folder = r.folder OR starts_with(j.folder, r.folder || '/')) AS file_count,
 (SELECT CAST(sum(size) AS BIGINT) FROM {I} j WHERE j.folder = r.folder OR starts_with(j.folder, r.folder || '/')) AS total_bytes
 FROM (SELECT DISTINCT regexp_replace(folder, '/d[0-9]+$', '') AS folder FROM {I}) r""")
def folder_tree_counts(spark, sf):
    it = items(spark, sf)
    roots = it.select(F.regexp_replace("folder", "/d[0-9]+$", "").alias("folder")).distinct()
    return count_folder_trees(it, roots).select(F.col("folder").alias("root"), "file_count", "total_bytes")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS media,
 page_id % 5 IN (1, 3) AS image FROM pages""")
def media_kinds(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".MP4", ".jpg", ".txt", ".HEIC", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.regexp_replace("url", "[.#?].*$", ""), ext)
    return table(spark, sf, "pages").select("page_id", path.alias("p")).select("page_id", P.is_media_path("p").alias("media"), P.is_image_path("p").alias("image"))


@query(f"""WITH e AS (SELECT l_orderkey AS g, l_suppkey AS a, l_partkey AS b, CASE l_linenumber % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 24 END AS flags FROM lineitem)
SELECT count(*) FILTER (flags = 24) AS both, count(*) FILTER (flags = 8) AS gray_only, count(*) FILTER (flags = 16) AS hash_only, count(*) FILTER (a % 7 <> b % 7) AS kept_apart FROM e""")
def merge_counters(spark, sf):
    k = F.col("l_linenumber") % 3
    l = table(spark, sf, "lineitem")
    e = l.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.when(k == 0, 8).when(k == 1, 16).otherwise(24).cast("smallint").alias("flags"))
    ids = l.select(F.col("l_suppkey").alias("rep_id")).union(l.select("l_partkey")).distinct()
    return G.merge_counters(e, ids.withColumn("group_id", F.col("rep_id") % 7))


@query(f"""SELECT group_id, count(*) FILTER (size % 3 = 0) AS transcode, count(*) FILTER (size % 3 <> 0) AS watermark FROM {I} GROUP BY 1""")
def quality_warnings(spark, sf):
    found = items(spark, sf).select("group_id", (F.col("size") % 3 == 0).alias("transcode"), (F.col("size") % 3 != 0).alias("watermark"))
    return QU.warning_summary(found)


@query("""SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS path FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)""")
def effective_roots(spark, sf):
    inc = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"))
    exc = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("path"))
    return M.effective_roots(inc, exc)
