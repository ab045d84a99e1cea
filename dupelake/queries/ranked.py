"""Statistics, ranking and sorting queries over result items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as T
from ..functions.media import bits_per_pixel
from ..operators import ranking as R, stats as S
from ..operators.eligibility import filter_results
from . import query
from .derive import ITEMS_SQL, items

I = ITEMS_SQL


@query(f"""WITH g AS (SELECT group_id, count(*) n FROM {I} GROUP BY 1)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS items, round(avg(n), 6) AS avg_size, max(n) AS max_size,
 count(*) FILTER (n > 5) AS over_5, count(*) FILTER (n > 10) AS over_10 FROM g""")
def group_statistics(spark, sf):
    return S.group_statistics(items(spark, sf)).withColumn("avg_size", F.round("avg_size", 6))


@query(f"""WITH g AS (SELECT group_id, count(*) n, sum(greatest(size, 0)) t, max(greatest(size, 0)) m FROM {I} GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS groups, CAST(sum(t) AS BIGINT) AS total_bytes,
 CAST(sum(t - m) AS BIGINT) AS savings FROM g""")
def result_totals(spark, sf):
    return S.result_totals(items(spark, sf))


@query(f"""SELECT group_id, count(*) AS files, CAST(sum(greatest(size, 0)) AS BIGINT) AS total_bytes,
 CAST(sum(greatest(size, 0)) - max(greatest(size, 0)) AS BIGINT) AS wasted_bytes, min(similarity) AS sim_min,
 max(similarity) AS sim_max, count(*) AS on_disk, false AS any_tombstone, false AS any_offline,
 bool_or(checked) AS any_checked, bool_or((flags & 8) <> 0) AS any_gray, bool_or((flags & 16) <> 0) AS any_hash
 FROM {I} GROUP BY group_id HAVING count(*) > 1""")
def group_headers(spark, sf):
    return S.group_headers(items(spark, sf))


@query(f"""SELECT count(*) AS checked_items, CAST(coalesce(sum(greatest(size, 0)), 0) AS BIGINT) AS checked_bytes,
 count(DISTINCT group_id) AS checked_groups FROM {I} WHERE checked""")
def checked_totals(spark, sf):
    return S.checked_totals(items(spark, sf))


@query(f"""SELECT group_id, count(*) FILTER (checked) AS removed, count(*) FILTER (NOT checked) AS kept,
 CAST(sum(CASE WHEN checked THEN greatest(size, 0) ELSE 0 END) AS BIGINT) AS savings,
 min(CASE WHEN NOT checked THEN path END) AS first_kept FROM {I} GROUP BY 1 HAVING count(*) FILTER (checked) > 0""")
def cleanup_report(spark, sf):
    return S.cleanup_report(items(spark, sf))


@query(f"""SELECT group_id, path, size, CASE WHEN checked THEN 'remove' ELSE 'keep' END AS action FROM {I}
 WHERE group_id IN (SELECT group_id FROM {I} WHERE checked)""")
def cleanup_lines(spark, sf):
    return S.cleanup_lines(items(spark, sf))


@query(f"""WITH w AS (SELECT group_id, min(path) AS winner, min(size) % 2 = 0 AS confirmed FROM {I} GROUP BY 1)
SELECT folder, count(*) AS files, CAST(sum(greatest(size, 0)) AS BIGINT) AS bytes, count(DISTINCT i.group_id) AS groups,
 count(*) FILTER (path = winner) AS best, count(*) FILTER (path = winner AND confirmed) AS confirmed,
 count(*) FILTER (path = winner AND NOT confirmed) AS review
 FROM {I} i JOIN w ON i.group_id = w.group_id GROUP BY folder""")
def folder_content(spark, sf):
    it = items(spark, sf)
    w = it.groupBy("group_id").agg(F.min("path").alias("winner"), (F.min("size") % 2 == 0).alias("confirmed"))
    return S.folder_content(it, w)


@query(f"""WITH g AS (SELECT group_id, bool_and(NOT is_image) AS vid, max(duration_s) d, min(size) s, max(fps) f, max(kbps) k,
 max(audio_sample_rate) r, max(audio_kbps) a, max(CASE hdr WHEN 'HDR10' THEN 2 ELSE 0 END) hh, max(frame_size_int) z
 FROM {I} GROUP BY 1)
SELECT i.path, vid AND duration_s = d AS best_duration, size = s AS best_size, vid AND fps = f AS best_fps,
 vid AND kbps = k AS best_kbps, vid AND audio_sample_rate = r AS best_audio_rate, vid AND audio_kbps = a AS best_audio_kbps,
 vid AND (CASE hdr WHEN 'HDR10' THEN 2 ELSE 0 END) = hh AS best_hdr, frame_size_int = z AS best_frame_size
 FROM {I} i JOIN g ON i.group_id = g.group_id""")
def best_flags(spark, sf):
    return R.best_flags(items(spark, sf)).select("path", *R.BEST_COLUMNS)


def keeper_sql(source: str, steps: list[tuple[str, str, bool, bool, str]], order: str = "path") -> str:
    """Keeper by sequential elimination as a chain of CTEs. Steps: (name, value, video_only, ascending, tie on a, b)."""
    ctes = [f"s0 AS (SELECT *, true AS alive, CAST(NULL AS VARCHAR) AS by_, first_value(path) OVER (PARTITION BY group_id "
            f"ORDER BY {order}) AS keep_, first_value(is_image) OVER (PARTITION BY group_id ORDER BY {order}) AS kimg FROM {source})"]
    for k, (name, value, video, asc, tie) in enumerate(steps):
        agg = "min" if asc else "max"
        w = "OVER (PARTITION BY group_id)"
        ctes.append(f"a{k} AS (SELECT *, {value} AS v_, count(*) FILTER (alive) {w} AS n_, {agg}({value}) FILTER (alive) {w} AS b_ FROM s{k})")
        cond = tie.replace("$a", "v_").replace("$b", "b_")
        ctes.append(f"b{k} AS (SELECT *, alive AND ({cond}) AS tied_, (n_ > 1 AND NOT ({str(video).lower()} AND kimg)) AS on_ FROM a{k})")
        pick = f"min(CASE WHEN alive AND v_ = b_ THEN {order} END) {w}"
        img = f"bool_or(is_image) FILTER (alive AND v_ = b_) {w}"
        ctes.append(f"c{k} AS (SELECT *, count(*) FILTER (tied_) {w} AS t_, {pick} AS kk_, {img} AS ki_ FROM b{k})")
        ctes.append(f"s{k + 1} AS (SELECT * EXCLUDE (alive, by_, keep_, kimg, v_, n_, b_, tied_, on_, t_, kk_, ki_), "
                    f"CASE WHEN on_ THEN tied_ ELSE alive END AS alive, "
                    f"CASE WHEN on_ AND t_ <= 1 AND by_ IS NULL THEN '{name}' ELSE by_ END AS by_, "
                    f"CASE WHEN on_ THEN kk_ ELSE keep_ END AS keep_, CASE WHEN on_ THEN ki_ ELSE kimg END AS kimg FROM c{k})")
    return "WITH " + ",\n".join(ctes)


BPP = "CASE WHEN kbps > 0 AND fps > 0 AND w > 0 AND h > 0 THEN CAST(kbps AS DOUBLE) * 1000.0 / (CAST(w AS DOUBLE) * h * fps) ELSE 0.0 END"
RATE_TIE = "abs($a - $b) <= greatest($a, $b) * 0.05"
STEPS = {
    "Duration": ("Duration", "duration_s", True, False, "abs($a - $b) <= 1 OR abs($a - $b) <= greatest($a, $b) * 0.01"),
    "Resolution": ("Resolution", "frame_size_int", False, False, "$a = $b"),
    "Bitrate": ("Bitrate", "CAST(kbps AS DOUBLE)", True, False, RATE_TIE),
    "FPS": ("FPS", "fps", True, False, "abs($a - $b) <= 0.5"),
    "Bits per pixel": ("Bits per pixel", BPP, True, False, RATE_TIE),
    "Audio Bitrate": ("Audio Bitrate", "CAST(audio_kbps AS DOUBLE)", True, False, RATE_TIE),
    "Size": ("Size", "size", False, True, "$a = $b"),
}


@query(keeper_sql(I, [STEPS[n] for n in STEPS]) + f"\nSELECT group_id, path, by_ AS decided_by FROM s{len(STEPS)} WHERE path = keep_")
def pick_keeper_default_order(spark, sf):
    return R.pick_keeper(items(spark, sf), R.resolve_criteria([])).where("is_keeper").select("group_id", "path", "decided_by")


_ORDER = ["Bitrate", "FPS", "Duration", "Resolution", "Bits per pixel", "Audio Bitrate", "Size"]


@query(keeper_sql(I, [STEPS[n] for n in _ORDER]) + f"\nSELECT group_id, path, by_ AS decided_by FROM s{len(STEPS)} WHERE path = keep_")
def pick_keeper_user_order(spark, sf):
    return R.pick_keeper(items(spark, sf), R.resolve_criteria(["Bitrate", "FPS"])).where("is_keeper").select(
        "group_id", "path", "decided_by")


REVIEW_SQL = f"""SELECT group_id, (count(*) < 2 OR bool_or((flags & 7) <> 0) OR (bool_or(is_image) AND bool_or(NOT is_image)) OR
 CASE WHEN bool_or(is_image) THEN bool_or(frame_size_int <= 0) OR count(DISTINCT lower(trim(format))) > 1
 ELSE bool_or(duration_s <= 0) OR max(duration_s) - min(duration_s) > greatest(1.0, max(duration_s) * 0.01)
  OR count(DISTINCT lower(trim(hdr))) > 1 OR count(DISTINCT audio_channel) > 1 OR count(DISTINCT lower(trim(format))) > 1
  OR count(DISTINCT audio_format) > 1 OR coalesce(max(fps) FILTER (fps > 0) - min(fps) FILTER (fps > 0) > 0.5, false) END)
 AS review_only FROM {I} GROUP BY group_id"""


@query(REVIEW_SQL)
def review_only_groups(spark, sf):
    return R.review_only(items(spark, sf)).select("group_id", "review_only")


def smooth(df):
    """Items whose frame rates and dynamic range agree, so that dominance can be decided."""
    return df.withColumn("fps", F.lit(25.0)).withColumn("hdr", F.lit("")).withColumn(
        "duration_s", F.expr("CAST(60 + CAST(group_id AS BIGINT) % 600 AS DOUBLE)")).withColumn("format", F.lit("h264"))


SMOOTH_SQL = f"""(SELECT * REPLACE (CAST(25.0 AS DOUBLE) AS fps, '' AS hdr, CAST(60 + CAST(group_id AS BIGINT) % 600 AS DOUBLE) AS duration_s,
 'h264' AS format) FROM {I})"""
DOM = """(a.frame_size_int >= b.frame_size_int AND a.kbps + greatest(a.kbps, b.kbps) * 0.05 >= b.kbps
 AND a.fps + 0.5 >= b.fps AND a.bpp + greatest(a.bpp, b.bpp) * 0.05 >= b.bpp
 AND a.audio_kbps + greatest(a.audio_kbps, b.audio_kbps) * 0.05 >= b.audio_kbps AND a.audio_sample_rate >= b.audio_sample_rate
 AND (a.frame_size_int > b.frame_size_int OR a.kbps > b.kbps + greatest(a.kbps, b.kbps) * 0.05 OR a.fps > b.fps + 0.5
  OR a.bpp > b.bpp + greatest(a.bpp, b.bpp) * 0.05 OR a.audio_kbps > b.audio_kbps + greatest(a.audio_kbps, b.audio_kbps) * 0.05
  OR a.audio_sample_rate > b.audio_sample_rate))"""


def decisive_sql(source: str) -> str:
    return f"""it AS (SELECT *, {BPP} AS bpp FROM {source}),
rv AS (SELECT group_id FROM it GROUP BY 1 HAVING NOT (count(*) < 2 OR bool_or((flags & 7) <> 0) OR bool_or(is_image))),
dw AS (SELECT a.group_id, a.path AS winner FROM it a JOIN rv ON rv.group_id = a.group_id JOIN it b
 ON a.group_id = b.group_id AND a.path <> b.path GROUP BY 1, 2 HAVING bool_and({DOM}))"""


@query(f"WITH {decisive_sql(SMOOTH_SQL)} SELECT group_id, winner FROM dw")
def decisive_winner(spark, sf):
    return R.decisive_winner(smooth(items(spark, sf)))


def _cmp(col: str, weight: float, positive: bool, rel: float, absolute: float) -> str:
    a, b = f"CAST(a.{col} AS DOUBLE)", f"CAST(b.{col} AS DOUBLE)"
    guard = f"{a} <= 0 OR {b} <= 0 OR " if positive else ""
    return (f"(CASE WHEN {guard}abs({a} - {b}) <= greatest({absolute}, greatest(abs({a}), abs({b})) * {rel}) THEN 0 "
            f"WHEN {a} > {b} THEN {weight} ELSE -{weight} END)")


_SCORE = " + ".join([_cmp("frame_size_int", 6.0, True, 0.0, 0.0), _cmp("hr", 2.0, False, 0.0, 0.0), _cmp("kbps", 4.0, True, 0.05, 0.0),
                     _cmp("fps", 1.5, True, 0.0, 0.5), _cmp("bpp", 2.5, True, 0.05, 0.0), _cmp("audio_kbps", 1.0, True, 0.05, 0.0),
                     _cmp("audio_sample_rate", 0.75, True, 0.0, 0.0), _cmp("size", 0.15, True, 0.03, 0.0)])
SCORES_SQL = f"""sc0 AS (SELECT *, {BPP} AS bpp, CASE hdr WHEN 'HDR10' THEN 2 ELSE 0 END AS hr FROM {I}),
sc AS (SELECT a.group_id, a.path, round(sum(CASE WHEN b.path = a.path THEN 0 ELSE {_SCORE} END), 4) AS score
 FROM sc0 a JOIN sc0 b ON a.group_id = b.group_id GROUP BY 1, 2)"""


@query(f"WITH {SCORES_SQL} SELECT group_id, path, CAST(score AS DOUBLE) AS score FROM sc")
def weighted_scores(spark, sf):
    return R.weighted_scores(items(spark, sf)).withColumn("score", F.round("score", 4))


_BEST_STEPS = [STEPS[n] for n in ("Resolution", "Bitrate", "Duration", "FPS", "Bits per pixel", "Audio Bitrate")]


@query(keeper_sql(SMOOTH_SQL, _BEST_STEPS) + f""", {decisive_sql(SMOOTH_SQL)},
n AS (SELECT group_id, count(*) c FROM it GROUP BY 1)
SELECT s.group_id, s.path AS winner, (c = 1 OR coalesce(s.path = dw.winner, false)) AS confirmed
FROM s{len(_BEST_STEPS)} s JOIN n ON n.group_id = s.group_id LEFT JOIN dw ON dw.group_id = s.group_id WHERE s.path = s.keep_""")
def recommend_best_user_order(spark, sf):
    return R.recommend_best(smooth(items(spark, sf)), ["Resolution", "Bitrate"]).select("group_id", "winner", "confirmed")


@query(f"""WITH {SCORES_SQL}, {decisive_sql(I)}, r AS (SELECT sc.group_id, sc.path, row_number() OVER (PARTITION BY sc.group_id ORDER BY score DESC,
 frame_size_int DESC, hr DESC, kbps DESC, greatest(size, 0) DESC, sc.path) AS rk FROM sc JOIN sc0 ON sc.path = sc0.path)
SELECT r.group_id, r.path AS winner FROM r WHERE rk = 1""")
def likely_winner(spark, sf):
    return R.likely_winner(items(spark, sf))


def _leads(name: str, col: str, rel: float, absolute: float, positive: bool = True) -> str:
    """The name if the winner ``w`` has the group's highest value and clearly more than the lowest known one."""
    low = f"min(CASE WHEN {col} > 0 THEN {col} END)" if positive else f"min({col})"
    of = lambda agg: f"(SELECT {agg} FROM sc0 x WHERE x.group_id = w.group_id)"
    known = f"w.{col} > 0 AND " if positive else ""
    return f"CASE WHEN {known}w.{col} = {of(f'max({col})')} AND w.{col} > {of(low)} * (1 + {rel}) + {absolute} THEN '{name}' END"


_STRENGTHS = ", ".join([_leads("resolution", "frame_size_int", 0.0, 0.0), _leads("dynamic_range", "hr", 0.0, 0.0, False), _leads("bitrate", "kbps", 0.05, 0.0),
                        _leads("bits_per_pixel", "bpp", 0.05, 0.0), _leads("frame_rate", "fps", 0.0, 0.5), _leads("audio_bitrate", "audio_kbps", 0.05, 0.0)])


@query(f"""WITH {SCORES_SQL}, ra AS (SELECT group_id, count(*) AS n, bool_or((flags & 4) <> 0) AS ai, bool_or((flags & 2) <> 0) AS clip, bool_or((flags & 1) <> 0) AS flip, bool_or(is_image) AS img,
  max(duration_s) - min(duration_s) > greatest(1.0, max(duration_s) * 0.01) AS spread, min(format) <> max(format) AS codecs, min(hdr) <> max(hdr) AS mixed_hdr, max(fps) - min(fps) > 0.5 AS rates
  FROM sc0 GROUP BY 1),
 dw AS (SELECT a.group_id, a.path AS winner FROM sc0 a JOIN ra ON ra.group_id = a.group_id AND NOT (n < 2 OR ai OR clip OR flip OR img OR spread OR codecs OR mixed_hdr OR rates)
  JOIN sc0 b ON a.group_id = b.group_id AND a.path <> b.path GROUP BY 1, 2 HAVING bool_and({DOM})),
 l AS (SELECT sc.group_id, sc.path FROM sc JOIN sc0 ON sc.path = sc0.path QUALIFY row_number() OVER (PARTITION BY sc.group_id ORDER BY score DESC, frame_size_int DESC, hr DESC, kbps DESC,
  greatest(size, 0) DESC, sc.path) = 1),
 e AS (SELECT ra.*, coalesce(dw.winner, l.path) AS winner, n = 1 OR dw.winner IS NOT NULL AS confirmed FROM ra JOIN l USING (group_id) LEFT JOIN dw USING (group_id)),
 t AS (SELECT e.*, list_filter([{_STRENGTHS}], lambda v: v IS NOT NULL)[1:4] AS found, w.size = (SELECT max(size) FROM sc0 x WHERE x.group_id = w.group_id) AND w.size > (SELECT min(size) FROM sc0 x
  WHERE x.group_id = w.group_id) AS largest FROM e JOIN sc0 w ON w.group_id = e.group_id AND w.path = e.winner)
SELECT group_id, winner, confirmed, CASE WHEN n = 1 THEN 'only_copy' WHEN confirmed THEN 'dominates' WHEN clip THEN 'partial_clip' WHEN ai THEN 'ai_match' WHEN flip THEN 'flipped'
 WHEN img AND codecs THEN 'image_formats' WHEN img THEN 'image_unproven' WHEN spread THEN 'duration_spread' WHEN codecs THEN 'codecs' WHEN mixed_hdr THEN 'hdr' ELSE 'trade_off' END AS reason,
 CASE WHEN len(found) > 0 THEN array_to_string(found, ',') WHEN largest THEN 'size' ELSE 'tied' END AS strengths FROM t""")
def recommend_best_with_reasons(spark, sf):
    it = items(spark, sf)
    return R.winner_strengths(it, R.recommend_best(it)).withColumn("strengths", F.array_join("strengths", ","))


@query(f"""SELECT path, round(CASE WHEN m1 > 0 THEN size * 100.0 / m1 END, 4) AS size_pct, round(duration_s * 100.0 / m2, 4) AS duration_s_pct,
 round(kbps * 100.0 / m3, 4) AS kbps_pct, round(fps * 100.0 / m4, 4) AS fps_pct, round(frame_size_int * 100.0 / m5, 4) AS frame_size_int_pct
 FROM (SELECT *, max(size) OVER w m1, max(duration_s) OVER w m2, max(kbps) OVER w m3, max(fps) OVER w m4, max(frame_size_int) OVER w m5
 FROM {I} WINDOW w AS (PARTITION BY group_id))""")
def relative_to_best(spark, sf):
    out = R.relative_to_best(items(spark, sf))
    return out.select("path", *[F.round(c, 4).alias(c) for c in out.columns if c.endswith("_pct")])


@query(f"""WITH g AS (SELECT group_id, sum(greatest(size, 0)) - max(greatest(size, 0)) AS wst,
  min(CASE hdr WHEN 'HDR10' THEN 2 ELSE 0 END) AS mh, min(path) AS win FROM {I} GROUP BY 1),
 n AS (SELECT *, row_number() OVER (ORDER BY wst DESC, group_id) AS group_number FROM g)
SELECT path, group_number, row_number() OVER (PARTITION BY i.group_id ORDER BY path = win DESC, size DESC, path) AS member_rank,
 (CASE hdr WHEN 'HDR10' THEN 2 ELSE 0 END) > mh AS hdr_is_upgrade FROM {I} i JOIN n ON i.group_id = n.group_id""")
def display_ranks(spark, sf):
    it = items(spark, sf)
    w = it.groupBy("group_id").agg(F.min("path").alias("winner"))
    return R.display_ranks(it, w).select("path", "group_number", "member_rank", "hdr_is_upgrade")


@query(f"""SELECT path, row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, path) AS by_similarity,
 row_number() OVER (PARTITION BY group_id ORDER BY kbps ASC, path) AS by_bitrate FROM {I}""")
def member_ranks(spark, sf):
    it = R.rank_members(items(spark, sf), "similarity", True, name="by_similarity")
    return R.rank_members(it, "bitrate", False, name="by_bitrate").select("path", "by_similarity", "by_bitrate")


def _group_sort_sql() -> str:
    parts = []
    for mode in ("wasted", "total", "largest", "count", "similarity", "duration", "resolution", "checked"):
        expr = R.GROUP_SORTS[mode]
        parts.append(f"SELECT '{mode}' AS sort_mode, group_id, CAST({expr} AS DOUBLE) AS sort_key FROM {I} GROUP BY group_id")
    return " UNION ALL ".join(parts)


@query(_group_sort_sql())
def group_sort_keys(spark, sf):
    it = items(spark, sf)
    out = None
    for mode in ("wasted", "total", "largest", "count", "similarity", "duration", "resolution", "checked"):
        part = R.sort_groups(it, mode).select(F.lit(mode).alias("sort_mode"), "group_id", F.col("sort_key").cast("double").alias("sort_key"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""SELECT group_id, path, rk AS place FROM (SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, path) rk
 FROM {I}) WHERE rk <= 2""")
def two_largest_per_group(spark, sf):
    it = items(spark, sf)
    top = R.top_per_group(it, "group_id", [F.col("size").desc(), F.col("path")], 2)
    return R.rank_members(top, "size", True, name="place").select("group_id", "path", "place")


@query(f"""WITH c AS (SELECT group_id, duration_s, min(path) AS lead, count(*) n FROM {I} GROUP BY 1, 2 HAVING count(*) > 1),
 f AS (SELECT group_id, min(lead) AS lead FROM c GROUP BY 1)
SELECT i.group_id, i.path, i.path = f.lead AS is_leader FROM {I} i JOIN f ON f.group_id = i.group_id
 JOIN c ON c.group_id = i.group_id AND c.lead = f.lead AND c.duration_s = i.duration_s""")
def leading_cluster_same_length(spark, sf):
    return R.leading_cluster(items(spark, sf), "length").select("group_id", "path", "is_leader")


@query(f"""WITH h AS (SELECT group_id FROM {I} WHERE path LIKE '%/s1%/%7.mp4%' GROUP BY 1), c AS (SELECT group_id FROM {I} WHERE checked GROUP BY 1)
SELECT path FROM {I} WHERE group_id IN (SELECT group_id FROM h) AND group_id IN (SELECT group_id FROM c)
 AND NOT is_image AND similarity BETWEEN 90 AND 96""")
def filtered_results(spark, sf):
    return filter_results(items(spark, sf), "/s1*/*7.mp4", "videos", (90, 96), True).select("path")


@query(f"""SELECT path, CASE WHEN size = 0 THEN '0 B' ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) || u END AS size_text,
 CASE WHEN similarity = round(similarity) THEN printf('%.0f %%', similarity) ELSE printf('%.1f %%', similarity) END AS similarity_text,
 CASE WHEN kbps >= 1000 THEN printf('%.1f Mb/s', floor(kbps / 100.0 + 0.5) / 10) ELSE printf('%d kb/s', kbps) END AS bitrate_text,
 printf('%02d:%02d:%02d', CAST(floor(duration_s / 3600) AS BIGINT), CAST(floor(duration_s / 60) AS BIGINT) % 60, CAST(duration_s AS BIGINT) % 60) AS clock,
 CASE WHEN (flags & 2) <> 0 AND clip_offset_s > 0 THEN '@ ' || printf('%02d:%02d:%02d', CAST(floor(clip_offset_s / 3600) AS BIGINT),
   CAST(floor(clip_offset_s / 60) AS BIGINT) % 60, CAST(clip_offset_s AS BIGINT) % 60) ELSE '' END AS offset_text,
 CASE flags WHEN 0 THEN 'None' WHEN 2 THEN 'PartialClip' WHEN 4 THEN 'AiMatched' WHEN 8 THEN 'GrayscaleMatched'
  ELSE 'GrayscaleMatched, PHashMatched' END AS flag_text,
 round({BPP}, 6) AS bits_per_pixel
 FROM (SELECT *, CASE WHEN size >= 1048576 THEN size / 1048576.0 WHEN size >= 1024 THEN size / 1024.0 ELSE size END AS v,
  CASE WHEN size >= 1048576 THEN ' MB' WHEN size >= 1024 THEN ' KB' ELSE ' B' END AS u FROM {I})""")
def display_texts(spark, sf):
    return items(spark, sf).select(
        "path", T.bytes_text("size").alias("size_text"), T.similarity_text("similarity").alias("similarity_text"),
        T.bitrate_text("kbps").alias("bitrate_text"), T.clock_text("duration_s").alias("clock"),
        T.clip_offset_text("flags", "clip_offset_s").alias("offset_text"), T.flag_names("flags").alias("flag_text"),
        F.round(bits_per_pixel(), 6).alias("bits_per_pixel"))
