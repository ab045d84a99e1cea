"""Catalog queries: eligibility, filters, refresh, relocation, maintenance, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EntryFlag, ScanConfig
from ..functions import formats as T, paths as P
from ..functions.media import display_streams, display_width, fps_value, hdr_class
from ..operators import eligibility as E, maintenance as M, ranking as R, relocate as L, stats as S
from ..operators.features import missing_from_cache
from ..sources.probe import parse_probe
from . import query
from .derive import CATALOG_SQL, ITEMS_SQL, LISTING_SQL, MEDIA_SQL, from_sql, items, media, table

D, I, C, N = MEDIA_SQL, ITEMS_SQL, CATALOG_SQL, LISTING_SQL

_CFG = ScanConfig(include=("/web",), include_images=False, excluded_directories=("/web/blog.ththan.example.net", "spam-*", "*/fr"),
                  filter_by_size=True, min_size_mb=2, max_size_mb=60, path_contains=("*example.*",), path_not_contains=("*page=?*",))
_REASON = """CASE WHEN is_image THEN 'images_disabled'
 WHEN lower(folder) = '/web/blog.ththan.example.net' OR starts_with(lower(folder), '/web/blog.ththan.example.net/') OR regexp_matches(folder, '(?i)/spam-[^/]*(/|$)')
  OR regexp_matches(folder, '(?i)^.*/fr$') THEN 'excluded_directory'
 WHEN NOT (folder = '/web' OR starts_with(folder, '/web/')) THEN 'out_of_scope'
 WHEN (flags & 2) <> 0 THEN 'manually_excluded' WHEN (flags & 16) <> 0 THEN 'too_dark' WHEN NOT exists_ THEN 'missing'
 WHEN CAST(floor(size / 1048576.0) AS BIGINT) > 60 OR CAST(floor(size / 1048576.0) AS BIGINT) < 2 THEN 'size_out_of_range'
 WHEN NOT regexp_matches(path, '(?i)^.*example[.].*$') THEN 'path_pattern_missing'
 WHEN regexp_matches(path, '(?i)^.*page=..*$') THEN 'path_pattern_excluded' END"""
_DX = D.replace('AS "exists"', "AS exists_")


@query(f"SELECT file_id, {_REASON} AS exclude_reason FROM {_DX}")
def scan_eligibility(spark, sf):
    return E.scan_eligibility(media(spark, sf), _CFG).select("file_id", "exclude_reason")


@query(f"""WITH r AS (SELECT path, {_REASON} AS exclude_reason FROM {_DX}), b AS (SELECT *, row_number() OVER (PARTITION BY exclude_reason ORDER BY path) rk FROM r
 WHERE exclude_reason IS NOT NULL)
SELECT exclude_reason, count(*) AS files, array_to_string(list(path ORDER BY path) FILTER (rk <= 3), '|') AS examples FROM b GROUP BY 1""")
def exclusion_summary(spark, sf):
    out = E.exclusion_summary(E.scan_eligibility(media(spark, sf), _CFG))
    return out.select("exclude_reason", "files", F.array_join("examples", "|").alias("examples"))


@query(f"SELECT file_id FROM {D} WHERE (flags & 1) = 0 AND (flags & 92) <> 0 AND contains(lower(path), 'example.net')")
def filtered_catalog(spark, sf):
    return E.filter_catalog(media(spark, sf), "videos", errors_only=True, search="Example.NET").select("file_id")


@query(f"SELECT file_id FROM {D} WHERE (flags & 2) <> 0")
def catalog_rows_with_flag(spark, sf):
    return E.filter_catalog(media(spark, sf), flag=int(EntryFlag.MANUALLY_EXCLUDED)).select("file_id")


@query(f"""SELECT CAST(count(*) FILTER ((flags & 1) <> 0) AS BIGINT) AS image, count(*) FILTER ((flags & 2) <> 0) AS manually_excluded, count(*) FILTER ((flags & 4) <> 0) AS thumbnail_error,
 0 AS metadata_error, count(*) FILTER ((flags & 16) <> 0) AS too_dark, 0 AS no_audio_track, count(*) FILTER ((flags & 64) <> 0) AS audio_fingerprint_error,
 0 AS silent_audio_track, 0 AS reparse_point, 0 AS reparse_point_checked, count(*) FILTER ((flags & 92) <> 0) AS errors FROM {D}""")
def flag_counts(spark, sf):
    return S.flag_counts(media(spark, sf))


@query(f"SELECT file_id, row_number() OVER (ORDER BY (flags & 16) <> 0 DESC, size DESC, lower(path), path) AS place FROM {D}")
def catalog_order(spark, sf):
    from ..plans.skew import rank_all
    m = media(spark, sf)
    return rank_all(m, [(F.col("flags").bitwiseAND(16) != 0).desc(), F.col("size").desc(), F.lower("path"), F.col("path")], "place").select("file_id", "place")


@query(f"SELECT count(*) AS files FROM {D} WHERE lower(folder) = '/web/theres.example.com' OR starts_with(lower(folder), '/web/th')")
def entries_under_hosts(spark, sf):
    m = media(spark, sf).withColumn("folder", F.regexp_replace("folder", "^/web/th", "/web/th/"))
    return S.entries_under(m, "/WEB/Th")


@query(f"SELECT file_id, NOT is_image AND file_id % 3 <> 0 AND (flags & 224) = 0 AS needs_audio FROM {D}")
def needs_fingerprint(spark, sf):
    return media(spark, sf).withColumn("has_words", F.col("file_id") % 3 == 0).select("file_id", E.needs_fingerprint("has_words").alias("needs_audio"))


# --- refresh and relocation ---------------------------------------------------------------------------------------

def _catalog(spark, sf):
    return from_sql(spark, sf, C, "part")


def _listing(spark, sf):
    return from_sql(spark, sf, N, "part")


_MOVES = f"""mv AS (SELECT old_path, new_path FROM (SELECT size, content_key, min(path) AS old_path FROM {C} WHERE path NOT IN (SELECT path FROM {N}) GROUP BY 1, 2 HAVING count(*) = 1)
 JOIN (SELECT size, content_key, min(path) AS new_path FROM {N} WHERE path NOT IN (SELECT path FROM {C}) GROUP BY 1, 2) USING (size, content_key))"""


@query(f"WITH {_MOVES} SELECT old_path, new_path FROM mv")
def moved_files(spark, sf):
    return L.moved_files(_catalog(spark, sf), _listing(spark, sf))


@query(f"""WITH {_MOVES}, c AS (SELECT coalesce(new_path, path) AS path, size, created, modified, content_key, file_id, new_path IS NOT NULL AS moved FROM {C} LEFT JOIN mv ON old_path = path)
SELECT coalesce(c.path, l.path) AS path, CASE WHEN c.path IS NULL THEN 'new' WHEN moved THEN 'relinked' WHEN l.path IS NULL THEN 'missing'
 WHEN c.size = l.size AND c.created = l.created AND c.modified = l.modified THEN 'kept' WHEN c.size = l.size AND c.content_key = l.content_key THEN 'redated' ELSE 'replaced' END AS change,
 coalesce(l.size, c.size) AS size, coalesce(l.created, c.created) AS created FROM c FULL JOIN {N} l ON c.path = l.path""")
def catalog_refresh(spark, sf):
    return M.refresh(_catalog(spark, sf), _listing(spark, sf)).select("path", "change", "size", "created")


@query(f"""WITH m AS (SELECT * FROM {C} WHERE path NOT IN (SELECT path FROM {N})), s AS (SELECT size, count(*) n, min(path) p FROM {N} GROUP BY 1),
 h AS (SELECT m.path, count(*) n, min(l.path) p FROM m JOIN {N} l ON m.size = l.size AND abs(m.modified - l.modified) <= 2 GROUP BY 1)
SELECT m.path, CASE WHEN coalesce(s.n, 0) <= 1 THEN s.p WHEN h.n = 1 THEN h.p END AS new_path, CASE WHEN s.n IS NULL THEN 'not_found' WHEN s.n = 1 THEN 'size_only'
 WHEN h.n = 1 THEN 'size_and_modified' WHEN h.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS confidence,
 CAST(CASE WHEN coalesce(s.n, 0) <= 1 THEN coalesce(s.n, 0) ELSE coalesce(h.n, 0) END AS BIGINT) AS candidates
FROM m LEFT JOIN s ON s.size = m.size LEFT JOIN h ON h.path = m.path""")
def relocation_by_rescan(spark, sf):
    l = _listing(spark, sf)
    gone = _catalog(spark, sf).join(l.select("path"), "path", "left_anti")
    return L.relocation_candidates(gone, l)


@query(f"SELECT file_id, CASE WHEN starts_with(path, '/m/Brand#1/') THEN '/n/first/' || substr(path, 12) ELSE path END AS path FROM {C}")
def relocated_prefix(spark, sf):
    return L.relocate_prefix(_catalog(spark, sf), "/m/Brand#1", "/n/first/").select("file_id", "path")


_VOL = "(VALUES ('/web'), ('/web/therin.example.net'), ('/web/m.ththth.example.net/en'), ('/other')) v(root)"


@query(f"""WITH v AS (SELECT * FROM {_VOL}), a AS (SELECT file_id, size, exists_, (SELECT root FROM v WHERE lower(folder) = root OR starts_with(lower(folder), root || '/')
 ORDER BY length(root) DESC LIMIT 1) AS r FROM {_DX})
SELECT coalesce(r, '/') AS volume_root, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (exists_) AS done_files,
 CAST(sum(CASE WHEN exists_ THEN size ELSE 0 END) AS BIGINT) AS done_bytes FROM a GROUP BY 1""")
def volume_totals(spark, sf):
    roots = spark.createDataFrame([("/web",), ("/web/therin.example.net",), ("/web/m.ththth.example.net/en",), ("/other",)], "root string")
    return L.volume_totals(media(spark, sf), roots, "exists")


@query(f"""SELECT file_id, CASE WHEN exists_ THEN 'on_disk' WHEN starts_with(folder, '/web/m.') THEN 'offline' ELSE 'tombstone' END AS status FROM
 (SELECT *, regexp_extract(folder, '^(/web/[^/]*)', 1) AS host FROM {_DX})""")
def missing_or_offline(spark, sf):
    m = media(spark, sf)
    host = F.regexp_extract("folder", "^(/web/[^/]*)", 1)
    vols = m.select(host.alias("root")).distinct().withColumn("ready", ~F.col("root").startswith("/web/m."))
    return E.offline_status(m, m.where("exists").select("path"), vols).select("file_id", "status")


_SETS = f"(SELECT CAST(l_orderkey % 97 AS BIGINT) AS set_id, path FROM {I} JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON CAST(l_orderkey AS VARCHAR) = group_id WHERE l_orderkey % 3 = 0 AND size % 10 < 9)"


@query(f"""WITH s AS {_SETS}, n AS (SELECT group_id, count(*) AS n FROM {I} GROUP BY 1)
SELECT DISTINCT h.group_id FROM (SELECT i.group_id, set_id, count(*) AS c FROM {I} i JOIN s ON s.path = i.path GROUP BY 1, 2) h JOIN n ON n.group_id = h.group_id AND n.n = h.c""")
def not_a_match_groups(spark, sf):
    it = items(spark, sf)
    k = F.col("group_id").cast("bigint")
    sets = it.where((k % 3 == 0) & (F.col("size") % 10 < 9)).select((k % 97).alias("set_id"), "path")
    return L.hidden_groups(it, sets)


@query(f"""SELECT CAST(group_id AS BIGINT) AS set_id, path FROM {I} WHERE group_id NOT IN (SELECT group_id FROM {I} WHERE size % 7 = 0)""")
def pruned_not_a_match_sets(spark, sf):
    it = items(spark, sf)
    return L.prune_not_a_match(it.select(F.col("group_id").cast("bigint").alias("set_id"), "path"), it.where("size % 7 <> 0").select("path"))


@query(f"""WITH a AS (SELECT l_partkey AS k, CASE WHEN l_linestatus = 'O' THEN 'audio' ELSE 'sampling' END AS phase,
  arg_max(CASE WHEN l_quantity > 25 THEN 'end' ELSE 'begin' END, (l_orderkey * 10 + l_linenumber) * 2 + CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END) AS ev FROM lineitem GROUP BY 1, 2),
 f AS (SELECT k, bit_or(CASE phase WHEN 'audio' THEN 32 * 2 ELSE 4 END) AS f FROM a WHERE ev = 'begin' GROUP BY 1)
SELECT file_id, CAST(flags | coalesce(f, 0) AS INT) AS flags FROM {C} LEFT JOIN f ON k = file_id""")
def quarantined_files(spark, sf):
    """Attempts on every part, in order of their lines."""
    c = _catalog(spark, sf)
    a = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"),
        F.when(F.col("l_linestatus") == "O", "audio").otherwise("sampling").alias("phase"),
        F.when(F.col("l_quantity") > 25, "end").otherwise("begin").alias("event"))
    return L.quarantine(c, a.join(c.select("file_id", "path"), "file_id")).select("file_id", "flags")


# --- maintenance --------------------------------------------------------------------------------------------------

@query(f"SELECT file_id FROM {_DX} WHERE (flags & 12) = 0 AND exists_")
def cleaned_catalog(spark, sf):
    m = media(spark, sf)
    return M.clean(m, m.where("exists").select("path")).select("file_id")


@query(f"SELECT file_id FROM {_DX} WHERE (flags & 12) = 0 AND (exists_ OR starts_with(folder, '/web/m.') OR file_id % 4 = 1)")
def cleaned_catalog_remembering_deleted(spark, sf):
    m = media(spark, sf)
    vols = m.select(F.regexp_extract("folder", "^(/web/[^/]*)", 1).alias("root")).distinct().withColumn("ready", ~F.col("root").startswith("/web/m."))
    feats = m.where("file_id % 4 = 1").select("file_id")
    return M.clean(m, m.where("exists").select("path"), True, vols, feats).select("file_id")


@query(f"""WITH k AS (SELECT path, flags FROM {C} WHERE file_id % 7 = 0), a AS (SELECT bool_and((flags & 2) <> 0) AS al FROM k)
SELECT file_id, CAST(CASE WHEN file_id % 7 = 0 THEN CASE WHEN al THEN flags & ~2 ELSE flags | 2 END ELSE flags END AS INT) AS flags FROM {C}, a""")
def toggled_exclusion(spark, sf):
    c = _catalog(spark, sf)
    return M.toggle_exclusion(c, c.where("file_id % 7 = 0").select("path")).select("file_id", "flags")


@query(f"SELECT file_id, CASE WHEN file_id % 5 = 0 THEN '/new' || path ELSE path END AS path FROM {C}")
def repathed_catalog(spark, sf):
    c = _catalog(spark, sf)
    return M.repath(c, c.where("file_id % 5 = 0").select("path", F.concat(F.lit("/new"), "path").alias("new_path"))).select("file_id", "path")


@query(f"""SELECT (SELECT count(*) FROM {N}) AS source_rows, (SELECT CAST(sum(size) AS BIGINT) FROM {N}) AS source_bytes,
 (SELECT count(*) FROM {N} WHERE size % 3 = 0 AND created % 2 = 0) AS outdated_images, (SELECT count(*) FROM {C}) AS current_rows, (SELECT CAST(sum(size) AS BIGINT) FROM {C}) AS current_bytes,
 (SELECT count(*) FROM {N} WHERE path NOT IN (SELECT path FROM {C})) AS new_rows, (SELECT CAST(sum(size) AS BIGINT) FROM {N} WHERE path NOT IN (SELECT path FROM {C})) AS new_bytes,
 (SELECT count(*) FROM {N} WHERE path IN (SELECT path FROM {C})) AS existing_rows""")
def import_preview(spark, sf):
    n = _listing(spark, sf).withColumn("is_image", F.col("size") % 3 == 0).withColumn("feature_version", (F.col("created") % 2).cast("int"))
    return M.import_preview(_catalog(spark, sf), n)


@query(f"SELECT path, size FROM {C} UNION ALL SELECT path, size FROM {N} WHERE path NOT IN (SELECT path FROM {C})")
def imported_catalog(spark, sf):
    c = _catalog(spark, sf).select("path", "size")
    return M.import_rows(c, _listing(spark, sf).select("path", "size"))


@query(f"SELECT path FROM {C} WHERE (path, size, modified) NOT IN (SELECT path, size, modified FROM {N})")
def features_to_compute(spark, sf):
    return missing_from_cache(_catalog(spark, sf), _listing(spark, sf)).select("path")


@query(f"SELECT path FROM {N} WHERE (path, size, modified) IN (SELECT path, size, modified FROM {C})")
def pruned_feature_cache(spark, sf):
    return M.prune_cache(_listing(spark, sf), _catalog(spark, sf)).select("path")


@query(f"SELECT file_id FROM {C} WHERE NOT (size > 20000 AND duration_s < 300)")
def deleted_by_filter(spark, sf):
    return M.delete_rows(_catalog(spark, sf), F.expr("size > 20000 AND duration_s < 300")).select("file_id")


@query(f"SELECT path FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM {I} WHERE kbps <= 2500) WHERE n > 1")
def results_after_removal(spark, sf):
    it = items(spark, sf)
    return M.remove_results(it, it.where("kbps > 2500")).select("path")


@query(f"""WITH k AS (SELECT group_id, path FROM {I} WHERE NOT (checked AND size % 5 <> 0))
SELECT 'left' AS part, group_id, path, NULL AS removed, NULL AS freed_bytes FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM k) WHERE n > 1
UNION ALL SELECT 'freed', NULL, NULL, count(*), CAST(sum(greatest(size, 0)) AS BIGINT) FROM {I} WHERE checked AND size % 5 <> 0""")
def deletion_outcome(spark, sf):
    """The result rows that stay after the deletions, and one row of totals."""
    it = items(spark, sf)
    left, freed = S.deletion_outcome(it, it.where("checked").select("path", (F.col("size") % 5 != 0).alias("ok")))
    return left.select(F.lit("left").alias("part"), "group_id", "path").unionByName(freed.withColumn("part", F.lit("freed")), allowMissingColumns=True)


# --- text and metadata functions ----------------------------------------------------------------------------------

@query("""SELECT page_id, regexp_replace(u, '^.*[/\\\\]', '') AS name, lower(regexp_extract(u, '([.][^./\\\\]*)$', 1)) AS ext,
 len(list_filter(string_split(u, '/'), lambda s: s <> '')) AS depth, length(u) - length(replace(u, '/', '')) AS separators,
 array_to_string(list_filter(string_split(u, '/'), lambda s: s <> '')[-2:], '/') AS tail
 FROM (SELECT page_id, regexp_replace(replace(url, ':', ''), '/+$', '') AS u FROM pages)""")
def path_parts(spark, sf):
    u = F.regexp_replace(F.replace("url", F.lit(":"), F.lit("")), "/+$", "")
    return table(spark, sf, "pages").select("page_id", u.alias("u")).select(
        "page_id", P.file_name("u").alias("name"), P.extension("u").alias("ext"), P.path_depth("u").alias("depth"),
        P.separator_depth("u").alias("separators"), F.array_join(F.slice(P.path_segments("u"), F.greatest(F.size(P.path_segments("u")) - 1, F.lit(1)), F.lit(2)), "/").alias("tail"))


@query("""SELECT event_id, regexp_replace(regexp_replace(m, '"[^"]*"', '"*"', 'g'), '[0-9]+', '#', 'g') AS message_key FROM
 (SELECT event_id, event_type || ' of user ' || CAST(user_id AS VARCHAR) || ' with ' || props AS m FROM events)""")
def message_keys(spark, sf):
    m = F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" with "), "props")
    return table(spark, sf, "events").select("event_id", T.normalize_message(m).alias("message_key"))


@query("""SELECT doc_id, CASE WHEN contains(t, 'could not load') OR contains(t, 'version mismatch') THEN 'library_load' WHEN contains(t, 'moov atom not found') OR contains(t, 'truncat') THEN 'corrupt_or_truncated'
 WHEN contains(t, 'permission denied') THEN 'file_access' ELSE 'unknown' END AS category FROM (SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN ' Permission DENIED, moov atom not found' WHEN 1 THEN 'Could not LOAD'
  WHEN 2 THEN 'permission denied' WHEN 3 THEN 'file is Truncated' ELSE '' END) AS t FROM documents)""")
def error_categories(spark, sf):
    k = F.col("doc_id") % 5
    t = F.concat("text", F.when(k == 0, " Permission DENIED, moov atom not found").when(k == 1, "Could not LOAD").when(k == 2, "permission denied").when(
        k == 3, "file is Truncated").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", T.error_category(t).alias("category"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 9 = 0 OR l_partkey % 60000 = 0 THEN -1.0 ELSE round(l_partkey % 60000 / (l_suppkey % 9)::DOUBLE, 3) END AS fps,
 CASE l_linenumber % 4 WHEN 0 THEN 'HLG' WHEN 1 THEN 'HDR10+' WHEN 2 THEN 'HDR10' ELSE '' END AS hdr,
 CASE WHEN l_suppkey % 9 = 0 OR l_linenumber = l_suppkey % 9 OR round_even(l_partkey * l_linenumber / (l_suppkey % 9)::DOUBLE, 0) <= 0
   OR round_even(l_partkey * l_linenumber / (l_suppkey % 9)::DOUBLE, 0) > 65536 THEN l_partkey ELSE CAST(round_even(l_partkey * l_linenumber / (l_suppkey % 9)::DOUBLE, 0) AS BIGINT) END AS shown_width
 FROM lineitem""")
def stream_values(spark, sf):
    l = table(spark, sf, "lineitem")
    k = F.col("l_linenumber") % 4
    return l.select("l_orderkey", "l_linenumber", "l_partkey",
                    F.round(fps_value(F.concat_ws("/", (F.col("l_partkey") % 60000).cast("string"), (F.col("l_suppkey") % 9).cast("string"))).cast("double"), 3).alias("fps"),
                    hdr_class(F.when(k == 0, "ARIB-STD-B67").when(k == 3, "bt709").otherwise("smpte2084"), F.when(k == 1, "smpte2094-40").otherwise("")).alias("hdr"),
                    display_width("l_partkey", "l_linenumber", F.col("l_suppkey") % 9).alias("shown_width"))


@query("""SELECT p_partkey, CAST(floor(p_retailprice) AS DOUBLE) AS duration_s, 1920 + p_size AS w, 1080 AS h, 'h264' AS format, round(30000 / 1001.0, 4) AS fps,
 CAST(round_even((1000000 + p_partkey * 500) / 1000.0, 0) AS BIGINT) AS kbps, 'HDR10' AS hdr, 'aac' AS audio_format, 48000 AS audio_sample_rate FROM part""")
def probe_documents(spark, sf):
    js = F.format_string(
        '{"streams":[{"index":0,"codec_name":"mjpeg","codec_type":"video","width":320,"height":180,"r_frame_rate":"1/0"},'
        '{"index":1,"codec_name":"h264","codec_type":"video","width":%d,"height":1080,"bit_rate":"%d","r_frame_rate":"30000/1001","color_transfer":"smpte2084"},'
        '{"index":2,"codec_name":"aac","codec_type":"audio","channels":2,"sample_rate":"48000","channel_layout":"stereo"},'
        '{"index":3,"codec_name":"ac3","codec_type":"audio","channels":2,"sample_rate":"44100"}],"format":{"duration":"%s","bit_rate":"77"}}',
        F.lit(1920) + F.col("p_size"), F.lit(1000000).cast("bigint") + F.col("p_partkey") * 500, F.col("p_retailprice").cast("string"))
    d = display_streams(parse_probe(table(spark, sf, "part").select("p_partkey", js.alias("probe_json"))))
    return d.select("p_partkey", "duration_s", "w", "h", "format", F.round(F.col("fps").cast("double"), 4).alias("fps"), F.col("kbps").cast("bigint").alias("kbps"),
                    "hdr", "audio_format", "audio_sample_rate")


@query(f"""SELECT GroupId, Similarity, Path, Size, Duration, FrameSize, Fps, Flags, PartialClipOffset FROM (SELECT group_id AS GroupId, printf('%.1f', similarity) AS Similarity, path AS Path, size AS Size,
 printf('%.3f', duration_s) AS Duration, CAST(w AS VARCHAR) || 'x' || CAST(h AS VARCHAR) AS FrameSize, printf('%.2f', fps) AS Fps,
 CASE flags WHEN 0 THEN 'None' WHEN 2 THEN 'PartialClip' WHEN 4 THEN 'AiMatched' WHEN 8 THEN 'GrayscaleMatched' ELSE 'GrayscaleMatched, PHashMatched' END AS Flags,
 printf('%.0f', clip_offset_s) AS PartialClipOffset FROM {I})""")
def results_as_csv(spark, sf):
    from ..sources.results import results_csv
    return results_csv(items(spark, sf)).select("GroupId", "Similarity", "Path", "Size", "Duration", "FrameSize", "Fps", "Flags", "PartialClipOffset")


@query(f"""SELECT group_id, 0 AS part, count(*) AS items, array_to_string(list(path ORDER BY similarity DESC, path), '|') AS paths FROM {I} GROUP BY 1""")
def results_as_json(spark, sf):
    from ..sources.results import results_json
    return results_json(items(spark, sf)).select("group_id", "part", F.size("items").alias("items"),
                                                 F.array_join(F.transform("items", lambda x: x["path"]), "|").alias("paths"))


@query(f"""WITH g AS (SELECT group_id, count(*) n, row_number() OVER (ORDER BY group_id) AS no FROM {I} GROUP BY 1)
SELECT no, 0 AS sub, 'Group ' || CAST(no AS VARCHAR) || ' (' || CAST(n AS VARCHAR) || ' files):' AS first_line FROM g
UNION ALL SELECT no, row_number() OVER (PARTITION BY i.group_id ORDER BY similarity DESC, path), '  ' || lpad(printf('%.1f', similarity), 6, ' ') || '%  ' || path
 || CASE WHEN kbps = max(kbps) OVER (PARTITION BY i.group_id) AND max(CAST(is_image AS INT)) OVER (PARTITION BY i.group_id) = 0
   OR frame_size_int = max(frame_size_int) OVER (PARTITION BY i.group_id) THEN ' [best]' ELSE '' END
 || CASE WHEN (flags & 2) <> 0 AND clip_offset_s > 0 THEN ' [partial clip @ ' || printf('%02d:%02d:%02d', CAST(floor(clip_offset_s / 3600) AS BIGINT), CAST(floor(clip_offset_s / 60) AS BIGINT) % 60,
   CAST(clip_offset_s AS BIGINT) % 60) || ']' ELSE '' END || CASE WHEN (flags & 4) <> 0 THEN ' [AI]' ELSE '' END FROM {I} i JOIN g ON g.group_id = i.group_id""")
def results_as_text(spark, sf):
    from ..sources.results import results_text
    t = results_text(R.best_flags(items(spark, sf)))
    return t.where("no > 0 and line <> ''").select("no", "sub", F.substring_index("line", "\n", 1).alias("first_line"))
