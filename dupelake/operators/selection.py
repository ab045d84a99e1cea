"""Keep/remove plans. Every function returns item rows with ``action`` (keep, remove, review); nothing is deleted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P
from ..plans.skew import GroupPasses, attach_group, by_heat, descending, first_per_group
from .ranking import (EQUALITY, Criterion, _with_ratios, best_of_group, keeper_step, leading_cluster, pick_keeper,
                      resolve_criteria)


def keep_first(items: DataFrame, order: Sequence[Column], group: str = "group_id", key: str = "path") -> DataFrame:
    """Keep the first item of each group in ``order`` and remove the rest; groups of one are left alone."""
    best = items.groupBy(group).agg(F.min_by(key, F.struct(*order)).alias("__k"), F.count("*").alias("__n")).where("__n > 1")
    return items.join(best, group).withColumn(
        "action", F.when(F.col(key) == F.col("__k"), "keep").otherwise("remove")).drop("__k", "__n")


def mark(items: DataFrame, strategy: str, order: Sequence[str] = ("path",), group: str = "group_id") -> DataFrame:
    """Command-line strategies; items carry the best flags for the quality ones."""
    tail = [F.col(o) for o in order]
    orders = {
        "smallest-file": [descending("size"), *tail],
        "shortest-duration": [descending("duration_s"), *tail],
        "worst-resolution": [descending("frame_size_int"), *tail],
    }
    if strategy in orders:
        return keep_first(items, orders[strategy], group)
    tier = F.when(F.col("best_kbps"), 0).when(F.col("best_frame_size"), 1).otherwise(2)
    rate = F.when(tier == 2, descending("kbps")).otherwise(0.0)
    frame = F.when(tier == 2, descending("frame_size_int")).otherwise(0.0)
    size = F.when(tier == 2, descending("size")).otherwise(0.0)
    df = items
    if strategy == "100-percent-only":
        ok = items.groupBy(group).agg(F.min("similarity").alias("m")).where("m >= 100").select(group)
        df = items.join(ok, group, "left_semi")
    elif strategy != "lowest-quality":
        raise ValueError(f"unknown strategy: {strategy}")
    return keep_first(df, [tier, rate, frame, size, *tail], group)


#: Criteria of the one-click quality choice: no near ties, and its audio step compares the sample rate.
QUICK_CRITERIA = (
    Criterion("Duration", "duration_s", True), Criterion("Resolution", "frame_size_int"),
    Criterion("Bitrate", "kbps", True), Criterion("FPS", "fps", True),
    Criterion("Audio Bitrate", "audio_sample_rate", True), Criterion("Size", "size", ascending=True),
)


def auto_select(items: DataFrame, mode: str, order: Sequence[str] = ("path",), group: str = "group_id") -> DataFrame:
    """One-click selections: identical, lowest_quality, smallest, oldest, newest."""
    tail = [F.col(o) for o in order]
    if mode == "identical":
        ok = items.groupBy(group).agg(F.min("similarity").alias("m")).where("m >= 100").select(group)
        return keep_first(items.join(ok, group, "left_semi"), tail, group)
    if mode == "lowest_quality":
        sized = attach_group(items, group, __n=F.count("*")).where("__n > 1").drop("__n")
        marked = pick_keeper(sized, QUICK_CRITERIA, order, group)
        return marked.withColumn("action", F.when(F.col("is_keeper"), "keep").otherwise("remove"))
    keys = {"smallest": descending("size"), "oldest": descending("created"), "newest": F.col("created").cast("double")}
    return keep_first(items, [keys[mode], *tail], group)


def cluster_select(items: DataFrame, mode: str, order: Sequence[str] = ("path",), group: str = "group_id",
                   criteria: Sequence[str] = ()) -> DataFrame:
    """Marks on the first cluster of each group: identical, identical_but_size, oldest, newest, lowest_quality."""
    equality = "full" if mode == "identical" else "same_group"
    cl = leading_cluster(items, equality, order, group)
    lead_last = F.when(F.col("is_leader"), 1).otherwise(0)  # the leader is appended after its peers
    tail = [F.col(o) for o in order]
    if mode == "identical":
        return cl.withColumn("action", F.when(F.col("is_leader"), "keep").otherwise("remove")).drop("is_leader")
    if mode == "lowest_quality":
        marked = pick_keeper(cl, resolve_criteria(criteria), order, group)
        return marked.withColumn("action", F.when(F.col("is_keeper"), "keep").otherwise("remove"))
    keys = {"identical_but_size": F.col("size").cast("double"), "oldest": descending("created"),
            "newest": F.col("created").cast("double")}
    return keep_first(cl, [keys[mode], lead_last, *tail], group).drop("is_leader")


def missing_select(items: DataFrame) -> DataFrame:
    """Mark files that are no longer on disk (``status`` from offline_status)."""
    return items.where(F.col("status") != "on_disk").withColumn("action", F.lit("remove"))


def custom_select(items: DataFrame, criteria: Column, identical: int = 0, by_date: int = 0,
                  skip_groups_with_checked: bool = False, order: Sequence[str] = ("path",),
                  group: str = "group_id") -> DataFrame:
    """Criteria-driven selection.

    identical: 0 any, 1 equal to the first match, 2 equal but size, 3 not equal. by_date: 0 none, 1 remove newer,
    2 remove older. Without a date and identity rule a partial match marks every matched item.
    """
    me = F.struct(*order)
    visible = attach_group(items, group, __size=F.count("*"), __chk=F.bool_or("checked"))
    hit = visible.where(criteria & (~F.col("__chk") if skip_groups_with_checked else F.lit(True)))
    cols = sorted(set(EQUALITY["full"]))
    lead = hit.groupBy(group).agg(F.min_by(F.struct(me.alias("__me"), *cols), me).alias("__f"))
    j = hit.join(lead, group)
    first = F.struct(*order) == F.col("__f.__me")
    equal = lambda names: _all([F.col(c).eqNullSafe(F.col(f"__f.{c}")) for c in names])
    keep_cluster = {0: F.lit(True), 1: first | equal(EQUALITY["full"]), 2: first | equal(EQUALITY["but_size"]),
                    3: first | ~equal(EQUALITY["full"])}[identical]
    cluster = attach_group(j.where(keep_cluster).drop("__f"), group, __m=F.count("*"), __keep=F.min_by(
        me, F.struct(*({1: [F.col("created").cast("double")], 2: [descending("created")]}.get(by_date, [])), *order)))
    everything = (F.lit(by_date == 0 and identical == 0)) & (F.col("__m") < F.col("__size"))
    return cluster.withColumn("action", F.when(everything, "remove").when(me == F.col("__keep"), "keep").otherwise(
        "remove")).drop("__m", "__keep", "__size", "__chk")


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def expression_select(items: DataFrame, expression: str, group: str = "group_id") -> DataFrame:
    """User SQL predicate. Partly matching groups are marked; fully matching ones come back as ``review``."""
    j = attach_group(items.withColumn("__hit", F.coalesce(F.expr(expression).cast("boolean"), F.lit(False))), group,
                     __all=F.bool_and("__hit"))
    return j.where("__hit").withColumn("action", F.when(F.col("__all"), "review").otherwise("remove")).drop("__hit", "__all")


def expression_preset(presets: dict[str, str], name: str) -> str:
    """Named SQL predicates."""
    return presets[name]


KEEP_RULES = ("newest", "oldest", "largest", "smallest", "shortest_file_name", "longest_file_name", "shortest_path",
              "longest_path")


def _rule_key(rule: str) -> Column:
    name, path = F.length(P.file_name("path")), F.length("path")
    return {"newest": descending("created"), "oldest": F.col("created").cast("double"), "largest": descending("size"),
            "smallest": F.col("size").cast("double"), "shortest_file_name": name.cast("double"),
            "longest_file_name": descending(name), "shortest_path": path.cast("double"),
            "longest_path": descending(path)}[rule]


def keep_rule(items: DataFrame, rule: str, order: Sequence[str] = ("path",), group: str = "group_id") -> DataFrame:
    """Keep by one attribute; the first item wins ties."""
    return keep_first(items, [_rule_key(rule), *[F.col(o) for o in order]], group)


def keyword_keep(items: DataFrame, keyword: str, path_mode: bool, order: Sequence[str] = ("path",),
                 group: str = "group_id") -> DataFrame:
    """Keep the first item whose path (or file name) contains the keyword; groups without one are left alone."""
    hay = F.lower(F.col("path") if path_mode else P.file_name("path"))
    hit = F.contains(hay, F.lit(keyword.strip().lower()))
    me = F.struct(*order)
    j = attach_group(items.withColumn("__hit", hit), group, __keep=F.min(F.when(F.col("__hit"), me)), __n=F.count("*"))
    return (j.where(F.col("__keep").isNotNull() & (F.col("__n") > 1))
            .withColumn("action", F.when(me == F.col("__keep"), "keep").otherwise("remove"))
            .drop("__hit", "__keep", "__n"))


def keyword_mark(items: DataFrame, keyword: str, path_mode: bool) -> DataFrame:
    """Mark every item whose path (or file name) contains the keyword."""
    hay = F.lower(F.col("path") if path_mode else P.file_name("path"))
    return items.where(F.contains(hay, F.lit(keyword.strip().lower()))).withColumn("action", F.lit("remove"))


def same_folder_extras(items: DataFrame, order: Sequence[str] = ("path",), group: str = "group_id") -> DataFrame:
    """Keep the first copy per group and folder, remove further copies in the same folder."""
    df = items.withColumn("__fold", F.lower(P.folder_of("path")))
    me = F.struct(*order)
    j = attach_group(df, [group, "__fold"], __keep=F.min(me), __n=F.count("*")).where("__n > 1")
    return j.withColumn("action", F.when(me == F.col("__keep"), "keep").otherwise("remove")).drop("__fold", "__keep", "__n")


def target_paths(text: str) -> list[str]:
    """Newline or semicolon separated target folders, normalised and distinct regardless of case."""
    import re
    out: dict[str, str] = {}
    for part in re.split(r"[\r\n;]", text or ""):
        p = part.strip().replace("\\", "/")
        while len(p) > 1 and p.endswith("/"):
            p = p[:-1]
        if p:
            out.setdefault(p.lower(), p)
    return list(out.values())


def path_scope_select(items: DataFrame, targets: Sequence[str], inside: bool, group: str = "group_id") -> DataFrame:
    """Mark the members inside (or outside) the targets in groups that have members on both sides."""
    scope = F.lit(False)
    for t in targets:
        scope = scope | P.is_within("path", F.lit(t))
    j = attach_group(items.withColumn("__in", scope), group, __any=F.bool_or("__in"), __all=F.bool_and("__in"),
                     __n=F.count("*"))
    return (j.where(F.col("__any") & ~F.col("__all") & (F.col("__n") > 1) & (F.col("__in") == F.lit(inside)))
            .withColumn("action", F.lit("remove")).drop("__in", "__any", "__all", "__n"))


# --- ordered preference rules -------------------------------------------------------------------------------------

#: Rule kinds (fixed values).
RULE_KINDS = ("non_best", "keep_path_containing", "delete_path_containing", "delete_file_name_containing",
              "lower_resolution", "lower_bitrate", "lower_fps", "shorter_duration", "lower_audio_bitrate",
              "smaller_file", "older_created", "newer_created", "longer_path", "longer_file_name", "deeper_folder")
_KEYWORD_RULES = RULE_KINDS[1:4]


@dataclass(frozen=True)
class Rule:
    kind: str
    value: str = ""
    enabled: bool = True


def parse_keywords(text: str | None) -> list[str]:
    """Split on newlines, commas and semicolons (ASCII and full-width); distinct regardless of case."""
    import re
    out: dict[str, str] = {}
    for part in re.split(r"[\r\n,;，；]", text or ""):
        p = part.strip()
        if p:
            out.setdefault(p.lower(), p)
    return list(out.values())


def keywords_column(text) -> Column:
    """Column form of :func:`parse_keywords` (case kept, duplicates removed by folded value)."""
    parts = F.filter(F.transform(F.split(P._col(text), "[\\r\\n,;，；]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(parts, lambda s, i: F.array_position(F.transform(parts, lambda x: F.lower(x)), F.lower(s)) == i + 1)


def _contains_any(target: Column, keywords: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(F.lower(target), F.lit(k.lower()))
    return out


def _loss(rule: Rule) -> Column:
    """Higher means more disposable."""
    folder = F.when(F.trim(F.coalesce("folder", F.lit(""))) != "", F.col("folder")).otherwise(P.folder_of("path"))
    kw = parse_keywords(rule.value)
    d = lambda c: F.col(c).cast("double")
    return {
        "non_best": lambda: F.when(F.col("__is_best"), 0.0).otherwise(1.0),
        "keep_path_containing": lambda: F.when(_contains_any(folder, kw), 0.0).otherwise(1.0),
        "delete_path_containing": lambda: F.when(_contains_any(folder, kw), 1.0).otherwise(0.0),
        "delete_file_name_containing": lambda: F.when(_contains_any(P.file_name("path"), kw), 1.0).otherwise(0.0),
        "lower_resolution": lambda: -d("frame_size_int"), "lower_bitrate": lambda: -d("kbps"),
        "lower_fps": lambda: -d("fps"), "shorter_duration": lambda: -d("duration_s"),
        "lower_audio_bitrate": lambda: -d("audio_kbps"), "smaller_file": lambda: -d("size"),
        "older_created": lambda: -d("created"), "newer_created": lambda: d("created"),
        "longer_path": lambda: F.length("path").cast("double"),
        "longer_file_name": lambda: F.length(P.file_name("path")).cast("double"),
        "deeper_folder": lambda: P.separator_depth("path").cast("double"),
    }[rule.kind]()


def rule_assistant(items: DataFrame, rules: Sequence[Rule], rules_only: bool = False, group: str = "group_id",
                   best_criteria: Sequence[str] | None = None) -> DataFrame:
    """Lexicographic preference rules: the least disposable item is kept, the path breaks ties.

    With ``rules_only`` items that tie the keeper on every rule stay. ``tie_break`` tells which removals were ties.
    """
    active = [r for r in rules if r.enabled and (r.kind not in _KEYWORD_RULES or parse_keywords(r.value))]
    if not active:
        return items.limit(0).withColumn("action", F.lit(None).cast("string")).withColumn("tie_break", F.lit(False))
    non_best = any(r.kind == "non_best" for r in active)
    kept = items.columns

    def step(rows: DataFrame, passes: GroupPasses) -> DataFrame:
        df = passes.add(rows if passes.hot else rows.repartition(group), __size=F.count("*")).where("__size > 1")
        if non_best and best_criteria is not None:
            df = keeper_step(df.withColumn("__lower", F.lower("path")), passes, resolve_criteria(best_criteria, best=True), ("__lower", "path"))
            df = df.withColumnRenamed("is_keeper", "__is_best")
        df = df.withColumn("__loss", F.array(*[_loss(r) for r in active]))
        me = F.struct("__loss", F.lower("path").alias("__l"), F.col("path").alias("__p"))
        j = passes.add(df.withColumn("__me", me), __keep=F.min("__me"))
        tie = F.col("__loss") == F.col("__keep.__loss")
        act = F.when(F.col("__me") == F.col("__keep"), "keep")
        act = act.when(tie, "untouched").otherwise("remove") if rules_only else act.otherwise("remove")
        return j.withColumn("action", act).withColumn("tie_break", tie & (F.col("action") == "remove")).select(*kept, "action", "tie_break")

    df = items
    if non_best:
        df = _with_ratios(df.where(F.col(group).isNotNull()))
        if best_criteria is None:
            best = best_of_group(df, None, group).select(group, F.col("winner").alias("__w"))
            df = df.join(best, group).withColumn("__is_best", F.col("path") == F.col("__w")).drop("__w")
    return by_heat(df, group, step)


def rule_assistant_summary(plan: DataFrame, group: str = "group_id") -> DataFrame:
    size = F.greatest(F.col("size"), F.lit(0))
    rem = F.col("action") == "remove"
    g = plan.groupBy(group).agg(F.count_if(rem).alias("marks"), F.count_if(F.col("tie_break")).alias("ties"),
                                F.sum(F.when(rem, size).otherwise(0)).alias("bytes"))
    return g.agg(F.count("*").alias("processed_groups"), F.count_if(F.col("marks") > 0).alias("groups_with_marks"),
                 F.count_if(F.col("ties") > 0).alias("tied_groups"), F.sum("ties").alias("tie_break_selections"),
                 F.sum("marks").alias("selected"), F.sum("bytes").alias("selected_bytes"))


def smart_non_best(items: DataFrame, file_keywords: str = "", path_keywords: str = "", group: str = "group_id",
                   best_criteria: Sequence[str] | None = None) -> DataFrame:
    """Mark the items that are not the recommended best and match both keyword lists (an empty list matches all)."""
    folder = F.when(F.trim(F.coalesce("folder", F.lit(""))) != "", F.col("folder")).otherwise(P.folder_of("path"))
    fk, pk = parse_keywords(file_keywords), parse_keywords(path_keywords)
    cond = F.lit(True)
    if fk:
        cond = cond & _contains_any(P.file_name("path"), fk)
    if pk:
        cond = cond & _contains_any(folder, pk)
    kept = items.columns
    df = _with_ratios(items.where(F.col(group).isNotNull()))
    if best_criteria is None:
        best = best_of_group(df, None, group).select(group, F.col("winner").alias("__w"))
        rest = df.join(best, group).where(F.col("path") != F.col("__w"))  # a group of one has no other item
    else:
        steps = resolve_criteria(best_criteria, best=True)

        def step(rows: DataFrame, passes: GroupPasses) -> DataFrame:
            rows = (rows if passes.hot else rows.repartition(group)).withColumn("__lower", F.lower("path"))
            return keeper_step(rows, passes, steps, ("__lower", "path"))

        rest = by_heat(df, group, step).where("not is_keeper")
    return rest.where(cond).select(*kept).withColumn("action", F.lit("remove"))


def apply_plan(items: DataFrame, plan: DataFrame, preserve: bool = False, key: str = "path") -> DataFrame:
    """Write a plan into ``checked``: touched rows are cleared unless preserved, keepers always, removals set."""
    p = plan.groupBy(key).agg(F.max(F.when(F.col("action") == "remove", 2).when(F.col("action") == "keep", 1)
                                    .otherwise(0)).alias("__a"))
    new = (F.when(F.col("__a") == 2, True).when(F.col("__a") == 1, False)
           .when(F.col("__a").isNotNull(), F.col("checked") if preserve else F.lit(False)).otherwise(F.col("checked")))
    return items.join(p, key, "left").withColumn("checked", new).drop("__a")


def clear_marks(items: DataFrame, visible: Column) -> DataFrame:
    return items.withColumn("checked", F.when(visible, False).otherwise(F.col("checked")))


def invert_marks(items: DataFrame, visible: Column) -> DataFrame:
    return items.withColumn("checked", F.when(visible, ~F.col("checked")).otherwise(F.col("checked")))


def kept_items(items: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """Group members that no plan row removes."""
    return items.join(plan.where("action = 'remove'").select(key).distinct(), key, "left_anti")


def link_plan(items: DataFrame, selected: DataFrame, group: str = "group_id") -> DataFrame:
    """Link each selected file to the most similar unselected existing file of its group; none left is an error row.

    ``items`` carries ``status``; selected files already gone are only dropped.
    """
    sel = selected.select("path").distinct()
    keepers = items.join(sel, "path", "left_anti").where("status = 'on_disk'")
    target = first_per_group(keepers, group, [descending("similarity"), F.col("path")], ["path"]).withColumnRenamed(
        "path", "link_to")
    j = items.join(sel, "path", "left_semi").join(target, group, "left")
    gone = F.col("status") != "on_disk"
    return j.select(group, "path", F.when(~gone, F.col("link_to")).alias("link_to"),
                    F.when(gone, "already_gone").when(F.col("link_to").isNull(), "error").otherwise("link").alias("action"),
                    F.when(~gone & F.col("link_to").isNotNull(), F.greatest("size", F.lit(0))).otherwise(0).alias("freed_bytes"))


def custom_keeper(items: DataFrame, picker, group: str = "group_id") -> DataFrame:
    """Pluggable keeper: ``picker(items) -> (group, path)`` as DataFrames; groups without an answer are ``review``."""
    chosen = picker(items).select(group, F.col("path").alias("__k"))
    return items.join(chosen, group, "left").withColumn(
        "action", F.when(F.col("__k").isNull(), "review").when(F.col("path") == F.col("__k"), "keep").otherwise(
            "remove")).drop("__k")
