"""Keep/remove plan queries over result items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R, selection as K
from ..operators.eligibility import custom_criteria
from . import query
from .derive import ITEMS_SQL, items
from .ranked import STEPS, keeper_sql

I = ITEMS_SQL
OUT = ("group_id", "path", "action")


def first_sql(order: str, where: str = "true", source: str = I) -> str:
    return f"""SELECT group_id, path, CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END AS action FROM (SELECT group_id, path,
 row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS rk, count(*) OVER (PARTITION BY group_id) AS n FROM {source} WHERE {where}) WHERE n > 1"""


_BF = f"""(SELECT *, (max(CAST(is_image AS INT)) OVER w) = 0 AND kbps = max(kbps) OVER w AS bk, frame_size_int = max(frame_size_int) OVER w AS bf
 FROM {I} WINDOW w AS (PARTITION BY group_id))"""
_QUALITY = ("CASE WHEN bk THEN 0 WHEN bf THEN 1 ELSE 2 END, CASE WHEN NOT bk AND NOT bf THEN -kbps ELSE 0 END, path")


@query(first_sql(_QUALITY, source=_BF))
def mark_lowest_quality(spark, sf):
    return K.mark(R.best_flags(items(spark, sf)), "lowest-quality").select(*OUT)


@query(first_sql(_QUALITY, f"group_id IN (SELECT group_id FROM {I} GROUP BY 1 HAVING min(similarity) >= 95)", source=_BF))
def mark_identical_only(spark, sf):
    it = R.best_flags(items(spark, sf)).withColumn("similarity", F.col("similarity") + 5)
    return K.mark(it, "100-percent-only").select(*OUT)


@query(first_sql("size DESC, path"))
def mark_smallest_file(spark, sf):
    return K.mark(items(spark, sf), "smallest-file").select(*OUT)


@query(first_sql("duration_s DESC, path"))
def mark_shortest_duration(spark, sf):
    return K.mark(items(spark, sf), "shortest-duration").select(*OUT)


@query(first_sql("frame_size_int DESC, path"))
def mark_worst_resolution(spark, sf):
    return K.mark(items(spark, sf), "worst-resolution").select(*OUT)


@query(first_sql("path", f"group_id IN (SELECT group_id FROM {I} GROUP BY 1 HAVING min(similarity) >= 95)"))
def quick_select_identical(spark, sf):
    return K.auto_select(items(spark, sf).withColumn("similarity", F.col("similarity") + 5), "identical").select(*OUT)


_QUICK = [("Duration", "duration_s", True, False, "$a = $b"), ("Resolution", "frame_size_int", False, False, "$a = $b"),
          ("Bitrate", "kbps", True, False, "$a = $b"), ("FPS", "fps", True, False, "$a = $b"),
          ("Audio Bitrate", "audio_sample_rate", True, False, "$a = $b"), ("Size", "size", False, True, "$a = $b")]


@query(keeper_sql(f"(SELECT * FROM {I} QUALIFY count(*) OVER (PARTITION BY group_id) > 1)", _QUICK)
       + "\nSELECT group_id, path, CASE WHEN path = keep_ THEN 'keep' ELSE 'remove' END AS action FROM s6")
def quick_select_lowest_quality(spark, sf):
    return K.auto_select(items(spark, sf), "lowest_quality").select(*OUT)


@query(first_sql("size DESC, path"))
def quick_select_smallest(spark, sf):
    return K.auto_select(items(spark, sf), "smallest").select(*OUT)


@query(first_sql("created DESC, path"))
def quick_select_oldest(spark, sf):
    return K.auto_select(items(spark, sf), "oldest").select(*OUT)


@query(first_sql("created, path"))
def quick_select_newest(spark, sf):
    return K.auto_select(items(spark, sf), "newest").select(*OUT)


def cluster_sql(key: str) -> str:
    return f"""SELECT group_id, path, CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END AS action FROM (SELECT group_id, path, row_number() OVER
 (PARTITION BY group_id ORDER BY {key}, CASE WHEN path = lead THEN 1 ELSE 0 END, path) AS rk FROM (SELECT *, min(path) OVER (PARTITION BY group_id) AS lead,
 count(*) OVER (PARTITION BY group_id) n FROM {I}) WHERE n > 1)"""


@query(cluster_sql("size"))
def cluster_keep_smallest(spark, sf):
    return K.cluster_select(items(spark, sf), "identical_but_size").select(*OUT)


@query(cluster_sql("created DESC"))
def cluster_mark_oldest(spark, sf):
    return K.cluster_select(items(spark, sf), "oldest").select(*OUT)


@query(cluster_sql("created"))
def cluster_mark_newest(spark, sf):
    return K.cluster_select(items(spark, sf), "newest").select(*OUT)


def _coarse(df):
    """Items reduced to few distinct values, so that equal copies exist."""
    return (df.withColumn("size", F.col("size") % 2).withColumn("duration_s", F.lit(60.0)).withColumn("frame_size_int", F.col("frame_size_int") % 2)
            .withColumn("kbps", F.col("kbps") % 2).withColumn("fps", F.col("fps") % 2).withColumn("audio_sample_rate", F.lit(44100)).withColumn("format", F.lit("h264")))


COARSE = f"""(SELECT * REPLACE (size % 2 AS size, 60.0::DOUBLE AS duration_s, frame_size_int % 2 AS frame_size_int, kbps % 2 AS kbps,
 fps % 2 AS fps, 44100 AS audio_sample_rate, 'h264' AS format) FROM {I})"""
_FULL = "size, frame_size_int, kbps, fps"


@query(f"""WITH c AS (SELECT group_id, {_FULL}, min(path) AS lead FROM {COARSE} GROUP BY ALL HAVING count(*) > 1),
 f AS (SELECT group_id, min(lead) AS lead FROM c GROUP BY 1)
SELECT i.group_id, i.path, CASE WHEN i.path = f.lead THEN 'keep' ELSE 'remove' END AS action FROM {COARSE} i JOIN f USING (group_id)
 JOIN c ON c.group_id = i.group_id AND c.lead = f.lead AND (c.size, c.frame_size_int, c.kbps, c.fps) = (i.size, i.frame_size_int, i.kbps, i.fps)""")
def cluster_mark_identical(spark, sf):
    return K.cluster_select(_coarse(items(spark, sf)), "identical").select(*OUT)


_CRIT = "NOT is_image AND path LIKE '%/s%' AND path NOT LIKE '%_1_p%' AND similarity BETWEEN 90 AND 95 AND CAST(floor(size / 1048576.0) AS BIGINT) BETWEEN 1 AND 6"


def _criteria():
    return custom_criteria("videos", 1, 6, ["*/s*"], ["*_1_p*"], (90, 95))


@query(f"""WITH v AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS gs FROM {I}), m AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS ms,
 min(path) OVER (PARTITION BY group_id) AS kp FROM v WHERE {_CRIT})
SELECT group_id, path, CASE WHEN ms < gs THEN 'remove' WHEN path = kp THEN 'keep' ELSE 'remove' END AS action FROM m""")
def custom_selection(spark, sf):
    return K.custom_select(items(spark, sf), _criteria()).select(*OUT)


@query(f"""WITH v AS (SELECT *, bool_or(checked) OVER (PARTITION BY group_id) AS c FROM {I}), m AS (SELECT *, row_number() OVER (PARTITION BY group_id
 ORDER BY created, path) AS rk FROM v WHERE {_CRIT} AND NOT c)
SELECT group_id, path, CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END AS action FROM m""")
def custom_selection_by_date(spark, sf):
    return K.custom_select(items(spark, sf), _criteria(), by_date=1, skip_groups_with_checked=True).select(*OUT)


@query(f"""WITH m AS (SELECT *, min(path) OVER (PARTITION BY group_id) AS f FROM {COARSE})
SELECT m.group_id, m.path, CASE WHEN m.path = m.f THEN 'keep' ELSE 'remove' END AS action FROM m JOIN m l ON l.path = m.f
 WHERE m.path = m.f OR NOT ((m.size, m.frame_size_int, m.kbps, m.fps) = (l.size, l.frame_size_int, l.kbps, l.fps))""")
def custom_selection_not_identical(spark, sf):
    return K.custom_select(_coarse(items(spark, sf)), F.lit(True), identical=3).select(*OUT)


@query(f"""SELECT group_id, path, CASE WHEN al THEN 'review' ELSE 'remove' END AS action FROM (SELECT *, bool_and(hit) OVER (PARTITION BY group_id) AS al
 FROM (SELECT *, kbps < 2200 AND fps > 10 AS hit FROM {I})) WHERE hit""")
def expression_selection(spark, sf):
    return K.expression_select(items(spark, sf), K.expression_preset({"weak": "kbps < 2200 and fps > 10"}, "weak")).select(*OUT)


_NAME = "length(regexp_replace(path, '^.*/', ''))"
for _rule, _key in {"newest": "created DESC", "oldest": "created", "largest": "size DESC", "smallest": "size", "shortest_file_name": _NAME,
                    "longest_file_name": _NAME + " DESC", "shortest_path": "length(path)", "longest_path": "length(path) DESC"}.items():
    def _keep(spark, sf, rule=_rule):
        return K.keep_rule(items(spark, sf), rule).select(*OUT)
    _keep.__name__ = f"keep_{_rule}"
    query(first_sql(f"{_key}, path"))(_keep)


@query(f"""SELECT group_id, path, CASE WHEN path = kp THEN 'keep' ELSE 'remove' END AS action FROM (SELECT *, min(CASE WHEN contains(lower(path), '/n/s1')
 THEN path END) OVER w AS kp, count(*) OVER w AS n FROM {I} WINDOW w AS (PARTITION BY group_id)) WHERE kp IS NOT NULL AND n > 1""")
def keyword_keep(spark, sf):
    return K.keyword_keep(items(spark, sf), " /N/S1 ", True).select(*OUT)


@query(f"SELECT group_id, path, 'remove' AS action FROM {I} WHERE contains(regexp_replace(path, '^.*/', ''), '_3_p1')")
def keyword_mark(spark, sf):
    return K.keyword_mark(items(spark, sf), "_3_P1", False).select(*OUT)


@query(f"""SELECT group_id, path, CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY group_id, folder
 ORDER BY path) AS rk, count(*) OVER (PARTITION BY group_id, folder) AS n FROM (SELECT * REPLACE (regexp_replace(folder, '/d[0-9]*$', '') AS folder) FROM {I}
 )) WHERE n > 1""")
def same_folder_extras(spark, sf):
    it = items(spark, sf).withColumn("true_path", F.col("path")).withColumn(
        "path", F.regexp_replace("path", r"/d[0-9]+/", "/"))
    plan = K.same_folder_extras(it.withColumn("o", F.col("true_path")), ("o",))
    return plan.select("group_id", F.col("true_path").alias("path"), "action")


@query(f"""SELECT group_id, path, 'remove' AS action FROM (SELECT *, bool_or(i_) OVER w AS a, bool_and(i_) OVER w AS b FROM (SELECT *,
 starts_with(path, '/vault/A/') OR starts_with(path, '/vault/N/s7/') AS i_ FROM {I}) WINDOW w AS (PARTITION BY group_id)) WHERE a AND NOT b AND i_""")
def path_scope_inside(spark, sf):
    return K.path_scope_select(items(spark, sf), K.target_paths("/vault/A/\n/VAULT/n/s7;/vault/a"), True).select(*OUT)


_RULES = [K.Rule("delete_path_containing", "/s3，/s5"), K.Rule("keep_path_containing", "/A/"), K.Rule("lower_resolution"),
          K.Rule("lower_bitrate"), K.Rule("older_created", enabled=False), K.Rule("delete_file_name_containing", "")]
_LOSS = """CASE WHEN contains(lower(folder), '/s3') OR contains(lower(folder), '/s5') THEN 1 ELSE 0 END AS r1,
 CASE WHEN contains(lower(folder), '/a/') THEN 0 ELSE 1 END AS r2, -frame_size_int AS r3, -kbps AS r4"""


@query(f"""SELECT group_id, path, CASE WHEN rk = 1 THEN 'keep' ELSE 'remove' END AS action, rk > 1 AND (r1, r2, r3, r4) = (k1, k2, k3, k4) AS tie_break
 FROM (SELECT *, row_number() OVER o AS rk, first_value(r1) OVER o k1, first_value(r2) OVER o k2, first_value(r3) OVER o k3, first_value(r4) OVER o k4,
 count(*) OVER (PARTITION BY group_id) AS n FROM (SELECT *, {_LOSS} FROM {I})
 WINDOW o AS (PARTITION BY group_id ORDER BY r1, r2, r3, r4, lower(path), path)) WHERE n > 1""")
def rule_assistant(spark, sf):
    return K.rule_assistant(items(spark, sf), _RULES).select(*OUT, "tie_break")


_BEST = [STEPS[n] for n in STEPS if n != "Size"]


@query(keeper_sql(I, _BEST) + f""", l AS (SELECT *, CASE WHEN path = keep_ THEN 0 ELSE 1 END AS r0, {_LOSS}, count(*) OVER (PARTITION BY group_id) AS n FROM s{len(_BEST)}),
 k AS (SELECT *, first_value({{'r': [r0, r1, r2, r3, r4], 'p': path}}) OVER (PARTITION BY group_id ORDER BY r0, r1, r2, r3, r4, lower(path), path) AS f FROM l WHERE n > 1),
 m AS (SELECT group_id, size, [r0, r1, r2, r3, r4] <> f.r AS gone FROM k), g AS (SELECT group_id, count(*) FILTER (gone) AS marks, sum(CASE WHEN gone THEN greatest(size, 0) ELSE 0 END) AS bytes FROM m GROUP BY 1)
SELECT count(*) AS processed_groups, count(*) FILTER (marks > 0) AS groups_with_marks, 0 AS tied_groups, 0 AS tie_break_selections, CAST(sum(marks) AS BIGINT) AS selected,
 CAST(sum(bytes) AS BIGINT) AS selected_bytes FROM g""")
def rule_assistant_summary(spark, sf):
    return K.rule_assistant_summary(K.rule_assistant(items(spark, sf), [K.Rule("non_best"), *_RULES], rules_only=True, best_criteria=[]))


@query(keeper_sql(I, _BEST) + f"""\nSELECT s.group_id, s.path FROM s{len(_BEST)} s WHERE s.path <> s.keep_ AND contains(lower(s.path), '.mp4')
 AND (contains(lower(folder), '/r/') OR contains(lower(folder), '/s2'))""")
def smart_non_best(spark, sf):
    return K.smart_non_best(items(spark, sf), ".MP4", "/r/; /S2", best_criteria=[]).select("group_id", "path")


@query(f"""WITH p AS ({first_sql("size DESC, path")}) SELECT i.path, CASE p.action WHEN 'remove' THEN true WHEN 'keep' THEN false ELSE i.checked END AS checked
 FROM {I} i LEFT JOIN p ON p.path = i.path""")
def apply_plan_to_marks(spark, sf):
    it = items(spark, sf)
    return K.apply_plan(it, K.mark(it, "smallest-file").select("path", "action"), preserve=True).select("path", "checked")


@query(f"SELECT path, CASE WHEN kbps > 2000 THEN NOT checked ELSE checked END AS inverted, CASE WHEN kbps > 2000 THEN false ELSE checked END AS cleared FROM {I}")
def clear_and_invert_marks(spark, sf):
    it = items(spark, sf).withColumn("keep_checked", F.col("checked"))
    inv = K.invert_marks(it, F.col("kbps") > 2000).withColumnRenamed("checked", "inverted").withColumnRenamed("keep_checked", "checked")
    return K.clear_marks(inv, F.col("kbps") > 2000).select("path", "inverted", F.col("checked").alias("cleared"))


@query(f"""WITH i AS (SELECT *, size % 17 <> 0 AS there FROM {I}), k AS (SELECT group_id, path FROM (SELECT *, row_number() OVER (PARTITION BY group_id
 ORDER BY similarity DESC, path) rk FROM i WHERE NOT checked AND there) WHERE rk = 1)
SELECT i.group_id, i.path, CASE WHEN there THEN k.path END AS link_to, CASE WHEN NOT there THEN 'already_gone' WHEN k.path IS NULL THEN 'error' ELSE 'link' END AS action,
 CAST(CASE WHEN there AND k.path IS NOT NULL THEN greatest(size, 0) ELSE 0 END AS BIGINT) AS freed_bytes FROM i LEFT JOIN k USING (group_id) WHERE checked""")
def link_plan(spark, sf):
    it = items(spark, sf).withColumn("status", F.when(F.col("size") % 17 != 0, "on_disk").otherwise("tombstone"))
    return K.link_plan(it, it.where("checked"))


@query(f"""WITH p AS ({first_sql("size DESC, path")}) SELECT group_id, path FROM {I} WHERE path NOT IN (SELECT path FROM p WHERE action = 'remove')""")
def kept_items(spark, sf):
    it = items(spark, sf)
    return K.kept_items(it, K.mark(it, "smallest-file")).select("group_id", "path")


@query(f"""WITH k AS (SELECT group_id, max(path) AS kp FROM {I} WHERE kbps > 2000 GROUP BY 1)
SELECT group_id, path, CASE WHEN kp IS NULL THEN 'review' WHEN path = kp THEN 'keep' ELSE 'remove' END AS action FROM {I} LEFT JOIN k USING (group_id)""")
def pluggable_keeper(spark, sf):
    return K.custom_keeper(items(spark, sf), lambda df: df.where("kbps > 2000").groupBy("group_id").agg(F.max("path").alias("path"))).select(*OUT)


@query("""SELECT c_custkey, array_to_string(list_filter(list_transform(string_split_regex(t, '[\\r\\n,;，；]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords
 FROM (SELECT c_custkey, replace(c_name, '#', '，') || '; ' || c_mktsegment || ',' || chr(10) || ' ' AS t FROM customer)""")
def keyword_lists(spark, sf):
    from .derive import table
    t = F.concat(F.replace("c_name", F.lit("#"), F.lit("，")), F.lit("; "), F.col("c_mktsegment"), F.lit(",\n "))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(K.keywords_column(t), "|").alias("keywords"))
