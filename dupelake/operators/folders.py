"""Folder containment: statistics, folder pairs, relations and consolidation plans as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P
from ..plans.skew import attach_group, cut_lineage, descending, first_per_group, rank_all, store_alone
from .grouping import connected_components
from .ranking import decisive_winner, judge, judge_parts, part_summaries, recommend_best

WHOLE_SOURCE_COVERAGE = 90.0
PROMOTED_MIN_MATCH = 50.0
_MAX_BYTES = 2**63 - 1


def _size() -> Column:
    return F.greatest(F.col("size"), F.lit(0))


def _bytes(total: Column) -> Column:
    """Sum in wide decimals, capped at the largest 64-bit value."""
    return F.least(total, F.lit(_MAX_BYTES).cast("decimal(38,0)")).cast("bigint")


def _with_folder(media: DataFrame) -> DataFrame:
    return media.withColumn("folder", P.normalize_path("folder") if "folder" in media.columns else P.folder_of("path"))


def folder_stats(media: DataFrame) -> DataFrame:
    """Files and bytes directly in each folder."""
    return _with_folder(media).groupBy("folder").agg(
        F.count_if(F.col("folder") != "").alias("file_count"), _bytes(F.sum(_size().cast("decimal(38,0)"))).alias("total_bytes")).where("file_count > 0")


def recursive_folder_stats(media: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Files and bytes in a folder or below it; restricted to the requested folders when given.

    Files are counted per direct folder first, so only one row per folder is sent up its ancestor chain.
    """
    direct = folder_stats(media)
    up = direct.select(F.explode(P.ancestors("folder")).alias("folder"), "file_count", "total_bytes")
    if folders is not None:
        want = folders.select(P.normalize_path("folder").alias("folder")).where("folder <> ''").distinct()
        up = up.join(want, "folder", "left_semi")
    out = up.groupBy("folder").agg(F.sum("file_count").alias("file_count"),
                                   _bytes(F.sum(F.col("total_bytes").cast("decimal(38,0)"))).alias("total_bytes"))
    if folders is None:
        return out
    return want.join(out, "folder", "left").select(
        "folder", F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def series_folders(folders: DataFrame, include: tuple[str, ...] = (), levels: int = 4) -> DataFrame:
    """Requested folders plus up to four ancestors each, below the include root and never a volume root."""
    base = folders.select(P.normalize_path("folder").alias("folder")).where("folder <> ''").distinct()
    boundary = F.lit(None).cast("string")
    for root in sorted({r.replace("\\", "/").rstrip("/") or "/" for r in include}, key=len):
        boundary = F.when(P.is_within("folder", F.lit(root), case_sensitive=True), F.lit(root)).otherwise(boundary)
    up = base.withColumn("stop", boundary).withColumn("chain", P.ancestors("folder"))
    # nearest ancestors first; the walk ends at the boundary or a volume root
    near = F.reverse(F.slice("chain", F.lit(1), F.size("chain") - 1))
    stops = F.transform(near, lambda a: F.coalesce(a == F.col("stop"), F.lit(False)) | P.is_volume_root(a))
    cut = F.array_position(stops, F.lit(True))
    n = F.least(F.lit(levels), F.when(cut > 0, cut - 1).otherwise(F.size("chain") - 1)).cast("int")
    promoted = up.select(F.explode(F.slice(near, F.lit(1), n)).alias("folder"))
    return base.unionByName(promoted).distinct()


def series_stats(media: DataFrame, folders: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    return recursive_folder_stats(media, series_folders(folders, include))


def folder_files(media: DataFrame, folder: str, recursive: bool = False) -> DataFrame:
    """Files directly in a folder or in its tree; sizes floored at 0."""
    root = folder.replace("\\", "/").rstrip("/") or "/"
    m = _with_folder(media)
    hit = P.is_within("folder", F.lit(root), case_sensitive=True) if recursive else F.col("folder") == root
    return m.where(hit).select("path", _size().alias("size"))


# --- pairs --------------------------------------------------------------------------------------------------------

def resource_estimate(total: Column, matched_files: Column, matched_groups: Column) -> Column:
    """Distinct resources in a folder: extra copies inside matched groups collapse."""
    extras = F.greatest(F.lit(0), matched_files - matched_groups)
    return F.greatest(matched_groups, F.greatest(F.lit(0), total - extras))


def coverage_percent(matched: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.least(F.lit(100.0), matched * 100.0 / total))


def memberships(items: DataFrame, promoted: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """(group, root, path): each visible item under its direct folder and, when given, its promoted ancestors."""
    sized = attach_group(items, group, __n=F.count("*")).where("__n > 1")
    base = sized.select(group, "path", P.folder_of("path").alias("root")).where("root <> ''")
    if promoted is None:
        return base
    want = promoted.select(P.normalize_path("folder").alias("root")).distinct()
    up = base.select(group, "path", F.explode(F.filter(P.ancestors("root"), lambda a: a != F.col("root"))).alias("root"))
    return base.unionByName(up.join(want, "root", "left_semi").select(group, "path", "root")).distinct()


def _disjoint_folders() -> Column:
    """Folder ``a.root`` comes before ``b.root`` and neither holds the other."""
    la, lb = F.lower("a.root"), F.lower("b.root")
    return ((F.struct(la, F.col("a.root")) < F.struct(lb, F.col("b.root"))) & (la != lb)
            & ~lb.startswith(F.concat(la, F.lit("/"))) & ~la.startswith(F.concat(lb, F.lit("/"))))


def group_folder_pairs(member: DataFrame, group: str = "group_id") -> DataFrame:
    """Unordered pairs of distinct folders that share a group, ancestors and descendants excluded.

    One row per (group, pair): the output itself. The self join runs on distinct (group, folder) rows, and adaptive
    skew splitting spreads a group that touches very many folders.
    """
    f = member.select(group, "root").distinct()
    a, b = f.alias("a"), f.alias("b")
    return (a.join(b, F.col(f"a.{group}") == F.col(f"b.{group}")).where(_disjoint_folders())
            .select(F.col(f"a.{group}").alias(group), F.col("a.root").alias("folder_a"), F.col("b.root").alias("folder_b")))


#: Items up to which the folders of a group are judged from one summary each; larger groups go row by row.
PAIR_GROUP = 64
_JUDGED = ["size", "is_image", "flags", "duration_s", "frame_size_int", "kbps", "fps", "w", "h", "hdr", "format", "audio_format",
           "audio_channel", "audio_kbps", "audio_sample_rate"]


def folder_pair_matches(items: DataFrame, promoted: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """(folder_a, folder_b, group, files_a, files_b, review_only, auto_review) per shared group.

    Items are dealt by group once and folded to one summary per folder; two summaries of a group give the verdict of
    their pair in the same partition, so no row per pair and file is shuffled. Groups above ``PAIR_GROUP`` items go
    row by row.
    """
    need = [*_JUDGED, *[c for c in ("penalty", "bits_per_pixel") if c in items.columns]]
    rows = items.select(group, "path", *need)
    big = rows.groupBy(group).count().where(F.col("count") > PAIR_GROUP).select(group)
    if not big.limit(1).count():
        return _matches_of_summaries(rows, promoted, group)
    big = cut_lineage(big)
    return _matches_of_summaries(rows.join(big, group, "left_anti"), promoted, group).unionByName(
        _matches_of_rows(rows.join(big, group, "left_semi"), promoted, group))


def _matches_of_summaries(rows: DataFrame, promoted: DataFrame | None, group: str) -> DataFrame:
    rows = rows.drop("size").repartition(group).withColumn("root", P.folder_of("path"))
    if promoted is not None:
        want = promoted.select(P.normalize_path("folder").alias("root")).distinct()
        up = rows.withColumn("root", F.explode(F.filter(P.ancestors("root"), lambda x: x != F.col("root"))))
        rows = rows.unionByName(up.join(want, "root", "left_semi").select(*rows.columns)).repartition(group)
    parts = part_summaries(rows, [group, "root"])
    a, b = parts.alias("a"), parts.alias("b")
    # no filter on one side's folder: it would be pushed below the exchange, where each mention spells the path anew
    some = F.least(F.length("a.root"), F.length("b.root")) > 0
    pairs = a.join(b, F.col(f"a.{group}") == F.col(f"b.{group}")).where(_disjoint_folders() & some)
    out = judge_parts(pairs, "a", "b", [F.col("a.root").alias("folder_a"), F.col("b.root").alias("folder_b"), F.col(f"a.{group}").alias(group),
                                        F.col("a.r_n").alias("files_a"), F.col("b.r_n").alias("files_b")])
    return out.withColumn("auto_review", F.col("review_only") | F.col("winner").isNull())


def _matches_of_rows(items: DataFrame, promoted: DataFrame | None, group: str) -> DataFrame:
    member = memberships(items, promoted, group).distinct()
    pairs = group_folder_pairs(member, group)
    keys = ["folder_a", "folder_b", group]
    side = lambda c, n: pairs.join(member.withColumnRenamed("root", c), [group, c]).select(*keys, "path", F.lit(n).alias("side"))
    rows = side("folder_a", 0).unionByName(side("folder_b", 1))
    judged = judge(rows.join(items, [group, "path"]), keys)
    return judged.groupBy(*keys).agg(
        F.count_if(F.col("side") == 0).alias("files_a"), F.count_if(F.col("side") == 1).alias("files_b"),
        F.bool_or("review_only").alias("review_only"), F.max("winner").alias("winner")).withColumn(
        "auto_review", F.col("review_only") | F.col("winner").isNull())


def _participants(items: DataFrame, group: str) -> DataFrame:
    """Items of groups with company per direct folder: all items less those that are alone in their group."""
    rows = items.select(group, P.folder_of("path").alias("root"))
    alone = rows.groupBy(group).agg(F.count("*").alias("__n"), F.min("root").alias("root")).where("__n = 1").select("root", F.lit(-1).alias("__c"))
    counts = rows.groupBy("root").agg(F.count("*").alias("__c")).unionByName(alone.groupBy("root").agg(F.sum("__c").alias("__c")))
    return counts.groupBy("root").agg(F.sum(F.when(F.col("root") != "", F.col("__c"))).alias("participants")).where("participants > 0")


def folder_pairs(matches: DataFrame, items: DataFrame, stats: DataFrame | None = None,
                 promoted: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """Folder pairs with coverage, direction suggestion and display rank."""
    if promoted is None:
        part = _participants(items, group)
    else:
        part = memberships(items, promoted, group).groupBy("root").agg(F.count("*").alias("participants"))
        direct = memberships(items, None, group).select("root").distinct()
    confirmed = ~F.col("review_only")
    g = matches.groupBy("folder_a", "folder_b").agg(
        F.count("*").alias("groups"), F.count_if(confirmed).alias("confirmed_groups"),
        F.count_if("auto_review").alias("auto_review_groups"),
        F.sum("files_a").alias("matched_a"), F.sum("files_b").alias("matched_b"),
        F.sum(F.when(confirmed, F.col("files_a")).otherwise(0)).alias("confirmed_a"),
        F.sum(F.when(confirmed, F.col("files_b")).otherwise(0)).alias("confirmed_b"))
    g = g.withColumn("review_groups", F.col("groups") - F.col("confirmed_groups"))
    for s in ("a", "b"):
        f = f"folder_{s}"
        g = g.join(part.select(F.col("root").alias(f), F.col("participants").alias(f"part_{s}")), f, "left")
        if stats is not None:
            g = g.join(stats.select(F.col("folder").alias(f), F.col("file_count").alias(f"fc_{s}"),
                                 F.col("total_bytes").alias(f"bytes_{s}")), f, "left")
        else:
            g = g.withColumn(f"fc_{s}", F.lit(0)).withColumn(f"bytes_{s}", F.lit(0).cast("bigint"))
        g = (g.withColumn(f"total_{s}", F.greatest(F.coalesce(f"fc_{s}", F.lit(0)), F.coalesce(f"part_{s}", f"matched_{s}"),
                                                   F.col(f"matched_{s}")))
             .withColumn(f"bytes_{s}", F.greatest(F.coalesce(f"bytes_{s}", F.lit(0)), F.lit(0)))
             .withColumn(f"resources_{s}", resource_estimate(F.col(f"total_{s}"), F.col(f"confirmed_{s}"), F.col("confirmed_groups")))
             .withColumn(f"coverage_{s}", coverage_percent(F.col("confirmed_groups"), F.col(f"resources_{s}")))
             .drop(f"fc_{s}", f"part_{s}"))
    g = g.withColumn("match_percent", F.least("coverage_a", "coverage_b"))
    gap = F.abs(F.col("coverage_a") - F.col("coverage_b")) > 0.0001
    suggest_a = (F.when(gap, F.col("coverage_a") < F.col("coverage_b"))
                 .when(F.col("resources_a") != F.col("resources_b"), F.col("resources_a") > F.col("resources_b"))
                 .when(F.col("total_a") != F.col("total_b"), F.col("total_a") > F.col("total_b")).otherwise(True))
    g = g.withColumn("suggest_a", suggest_a)
    if promoted is not None:
        d = direct.withColumn("__d", F.lit(True))
        g = (g.join(d.select(F.col("root").alias("folder_a"), F.col("__d").alias("da")), "folder_a", "left")
             .join(d.select(F.col("root").alias("folder_b"), F.col("__d").alias("db")), "folder_b", "left")
             .where((F.col("da") & F.col("db")) | (F.col("match_percent") + 0.0001 >= PROMOTED_MIN_MATCH)).drop("da", "db"))
    return g


def pair_order(promoted: bool) -> list[Column]:
    """Display order of folder pairs: series roots that explain most first, or strongest one-sided coverage first."""
    tail = [F.lower("folder_a"), F.lower("folder_b"), F.col("folder_a"), F.col("folder_b")]
    if promoted:
        return [F.col("confirmed_groups").desc(), F.col("groups").desc(),
                P.path_depth("folder_a") + P.path_depth("folder_b"), F.col("match_percent").desc(),
                F.col("review_groups"), *tail]
    return [F.greatest("coverage_a", "coverage_b").desc(), F.col("confirmed_groups").desc(), F.col("review_groups"),
            F.least("coverage_a", "coverage_b").desc(), F.greatest("resources_a", "resources_b").desc(), *tail]


def rank_folder_pairs(pairs: DataFrame, promoted: bool = False) -> DataFrame:
    return rank_all(pairs, pair_order(promoted), "pair_rank")


def may_merge_whole_source(coverage: Column, review_groups: Column) -> Column:
    return (coverage >= WHOLE_SOURCE_COVERAGE) & (review_groups == 0)


def target_is_a() -> Column:
    """Directed relation: the side that is no subset (90 %) is the target; then coverage, size, suggestion."""
    a_sub, b_sub = F.col("coverage_a") >= WHOLE_SOURCE_COVERAGE, F.col("coverage_b") >= WHOLE_SOURCE_COVERAGE
    gap = F.abs(F.col("coverage_a") - F.col("coverage_b")) > 0.0001
    return (F.when(a_sub != b_sub, ~a_sub).when(~a_sub & ~b_sub & gap, F.col("coverage_a") > F.col("coverage_b"))
            .when(F.col("resources_a") != F.col("resources_b"), F.col("resources_a") > F.col("resources_b"))
            .when(F.col("total_a") != F.col("total_b"), F.col("total_a") > F.col("total_b")).otherwise(F.col("suggest_a")))


def directed_relations(ranked: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Pairs at or above the match threshold with target/source columns."""
    df = ranked.where(F.col("match_percent") + 0.0001 >= threshold).withColumn("to_a", target_is_a())
    for name, col in (("folder", "folder"), ("files", "total"), ("bytes", "bytes"), ("resources", "resources"),
                      ("coverage", "coverage")):
        df = (df.withColumn(f"target_{name}", F.when(F.col("to_a"), F.col(f"{col}_a")).otherwise(F.col(f"{col}_b")))
              .withColumn(f"source_{name}", F.when(F.col("to_a"), F.col(f"{col}_b")).otherwise(F.col(f"{col}_a"))))
    return df.withColumn("whole_source", may_merge_whole_source(F.col("source_coverage"), F.col("auto_review_groups")))


def relation_sets(relations: DataFrame, matches: DataFrame, group: str = "group_id") -> DataFrame:
    """Split the relations of one target by shared groups: adds ``set_id`` and ``set_order``.

    Relations and their groups form a bipartite graph (two edges per match instead of relation pairs).
    """
    target = F.lower("target_folder")
    rel_node = F.concat(F.lit("r|"), target, F.lit("|"), F.col("pair_rank").cast("string"))
    m = relations.join(matches.select("folder_a", "folder_b", group), ["folder_a", "folder_b"])
    edges = m.select(rel_node.alias("a"), F.concat(F.lit("g|"), target, F.lit("|"), F.col(group).cast("string")).alias("b"))
    comp = connected_components(edges)
    j = relations.withColumn("__n", rel_node).join(comp, F.col("__n") == F.col("node"))
    by_target = j.groupBy(target.alias("__t")).agg(F.min("pair_rank").alias("target_first"))
    j = attach_group(j.withColumn("__t", target), "component", set_first=F.min("pair_rank")).join(by_target, "__t")
    return j.withColumnRenamed("component", "set_id").drop("__n", "__t", "node")


def assign_groups(sets: DataFrame, matches: DataFrame, group: str = "group_id") -> DataFrame:
    """Each group goes to the first relation set that holds it: (group, set_id)."""
    m = sets.select("folder_a", "folder_b", "set_id", "target_first", "set_first").join(
        matches.select("folder_a", "folder_b", group), ["folder_a", "folder_b"])
    return m.groupBy(group).agg(F.min_by("set_id", F.struct("target_first", "set_first", "set_id")).alias("set_id"))


def relation_headers(sets: DataFrame, matches: DataFrame, assigned: DataFrame, group: str = "group_id") -> DataFrame:
    """Per relation set: best relation per source folder, sums, lowest coverages, review counts, whole-source flag."""
    mm = sets.select("set_id", "folder_a", "folder_b").join(matches, ["folder_a", "folder_b"])
    shown = mm.join(assigned, [group, "set_id"])
    used = shown.select("set_id", "folder_a", "folder_b").distinct()
    rel = sets.join(used, ["set_id", "folder_a", "folder_b"], "left_semi")
    best = first_per_group(rel.withColumn("__src", F.lower("source_folder")), ["set_id", "__src"],
                           [descending("match_percent"), descending("source_coverage"), descending("confirmed_groups"),
                            F.col("pair_rank")])
    per_group = shown.groupBy("set_id", group).agg(F.bool_or("auto_review").alias("rev"))
    reviews = per_group.groupBy("set_id").agg(F.count("*").alias("displayed_groups"), F.count_if("rev").alias("review_matches"))
    all_groups = mm.select("set_id", group).distinct().groupBy("set_id").agg(F.count("*").alias("relation_groups"))
    tgt = rel.groupBy("set_id").agg(F.min("target_folder").alias("target_folder"), F.max("target_files").alias("target_files"),
                                    F.max("target_bytes").alias("target_bytes"),
                                    F.max("target_resources").alias("target_resources"))
    src = best.groupBy("set_id").agg(
        F.count("*").alias("sources"), F.sum("source_files").alias("source_files"),
        F.sum("source_bytes").alias("source_bytes"), F.sum("source_resources").alias("source_resources"),
        F.min("target_coverage").alias("target_coverage"), F.min("source_coverage").alias("source_coverage"),
        F.min("match_percent").alias("min_match"), F.bool_and("whole_source").alias("__ws"))
    out = tgt.join(src, "set_id").join(reviews, "set_id").join(all_groups, "set_id")
    return (out.withColumn("confirmed_matches", F.col("displayed_groups") - F.col("review_matches"))
            .withColumn("whole_source", F.col("__ws") & (F.col("review_matches") == 0)).drop("__ws"))


def folder_rows(items: DataFrame, sets: DataFrame, assigned: DataFrame, group: str = "group_id") -> DataFrame:
    """Items of assigned groups under their actual folder with the owning root and role of their relation set."""
    roots = (sets.select("set_id", F.col("target_folder").alias("root"), F.lit(0).alias("root_order"), F.lit("target").alias("role"))
             .unionByName(sets.select("set_id", F.col("source_folder").alias("root"), F.col("pair_rank").cast("int").alias("root_order"),
                                      F.lit("source").alias("role"))))
    roots = roots.groupBy("set_id", F.lower("root").alias("rk")).agg(
        F.min(F.struct("root_order", "role", "root")).alias("r"))
    rows = items.join(assigned, group).withColumn("folder", P.folder_of("path"))
    hops = rows.select("set_id", "folder").distinct().withColumn("rk", F.explode(F.transform(P.ancestors("folder"), lambda x: F.lower(x))))
    own = hops.join(roots, ["set_id", "rk"]).groupBy("set_id", "folder").agg(F.max_by("r", F.length("rk")).alias("r"))
    return rows.join(own, ["set_id", "folder"], "left").select(
        *[c for c in rows.columns], F.coalesce("r.role", F.lit("related")).alias("role"),
        F.coalesce("r.root", "folder").alias("relation_root"), F.coalesce("r.root_order", F.lit(2**31 - 1)).alias("root_order"))


# --- plans --------------------------------------------------------------------------------------------------------

def pair_candidates(relations: DataFrame, matches: DataFrame, items: DataFrame, group: str = "group_id") -> DataFrame:
    """Items of every shared group of directed relations with ``in_source``."""
    m = relations.select("folder_a", "folder_b", "target_folder", "source_folder", "source_coverage", "pair_rank").join(
        matches, ["folder_a", "folder_b"])
    it = items.withColumn("__f", P.folder_of("path"))
    j = m.join(it, group)
    src, tgt = P.is_within("__f", F.col("source_folder")), P.is_within("__f", F.col("target_folder"))
    return j.where(src | tgt).withColumn("in_source", src).drop("__f")


def pair_merge_selection(candidates: DataFrame, rule: str, group: str = "group_id") -> DataFrame:
    """Keep one copy per shared group of a folder pair: target, source, best, largest, smallest, newest, oldest or
    manual. Review-only groups (and groups without a decisive best) come back as ``review``."""
    keys = ["pair_rank", group]
    tail = [F.col("in_source"), F.col("path")]  # target members come first
    if rule == "manual":
        return candidates.withColumn("action", F.lit("review"))
    order = {"target": tail, "source": [~F.col("in_source"), F.col("path")], "largest": [descending("size"), *tail],
             "smallest": [F.col("size").cast("double"), *tail], "newest": [descending("created"), *tail],
             "oldest": [F.col("created").cast("double"), *tail]}
    if rule == "best":
        k = candidates.select(*keys, F.col("winner").alias("__k")).distinct()
    else:
        k = candidates.groupBy(*keys).agg(F.min_by("path", F.struct(*order[rule])).alias("__k"))
    j = candidates.join(k, keys)
    return j.withColumn("action", F.when(F.col("review_only") | F.col("__k").isNull(), "review").when(
        F.col("path") == F.col("__k"), "keep").otherwise("remove")).drop("__k")


def pair_consolidation(candidates: DataFrame, media: DataFrame, group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """Plan for folder pairs: (group rows, unique source files to bring along).

    Decisive keepers that sit in the source move under the target's file stem with their own extension; groups
    without one are manual. Sources covered to 90 % with nothing manual also bring their unmatched files.
    """
    keys = ["pair_rank", group]
    first_target = candidates.where(~F.col("in_source")).groupBy(*keys).agg(F.min("path").alias("__t"))
    j = candidates.join(first_target, keys, "left")
    manual = F.col("auto_review") | F.col("winner").isNull()
    keep = F.col("path") == F.col("winner")
    rows = j.select(
        *keys, "target_folder", "source_folder", "path", "size",
        F.when(manual, "review").when(keep, "keep").otherwise("remove").alias("action"),
        F.when(~manual & keep, F.col("in_source")).otherwise(False).alias("move"),
        F.when(~manual & keep & F.col("in_source"), F.concat(P.file_stem("__t"), P.extension("path"))).alias("new_name"))
    open_pairs = j.groupBy("pair_rank").agg(F.count_if(manual).alias("manual"), F.first("source_coverage").alias("cov"),
                                            F.first("source_folder").alias("source_folder"))
    whole = open_pairs.where(may_merge_whole_source(F.col("cov"), F.col("manual"))).select(
        "pair_rank", F.lower("source_folder").alias("__f"))
    matched = candidates.where("in_source").select("pair_rank", "path").distinct()
    files = _with_folder(media).select("path", "size", F.lower("folder").alias("__f"))
    unique = files.join(whole, "__f").join(matched, ["pair_rank", "path"], "left_anti").select(
        "pair_rank", "path", _size().alias("size"))
    return rows, unique


def preserved_destination(source_root, path, destination_root) -> Column:
    """Path below the source root re-rooted at the destination; null for the root itself and for escapes."""
    root, p = P.normalize_path(source_root), P.normalize_path(path)
    rel = F.substring(p, F.length(root) + 2, F.lit(2**31 - 1))
    inside = p.startswith(F.concat(root, F.lit("/"))) & (rel != "")
    bad = rel.rlike(r"(^|/)\.\.(/|$)")
    return F.when(inside & ~bad, F.concat_ws("/", P.normalize_path(destination_root), rel))


def series_destinations(targets: DataFrame, base: str) -> DataFrame:
    """(set_id, destination): the base itself for one series, base/name for many; a clash rejects all of them."""
    total = targets.agg(F.count("*").alias("__n"))
    name = P.file_name(P.normalize_path("target_folder"))
    root = P.normalize_path(F.lit(base))
    d = targets.crossJoin(F.broadcast(total)).withColumn(  # one aggregate row
        "destination", F.when(F.col("__n") == 1, root).otherwise(F.concat_ws("/", root, name)))
    clash = d.groupBy("destination").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("__c"))
    return d.crossJoin(F.broadcast(clash)).where("__c = 0").select("set_id", "destination")


def _taken(listing: DataFrame, destinations: DataFrame, name: str, mark: str) -> DataFrame:
    """Listed paths that a destination can meet, once each: all destinations lie between the least root and the last path below one."""
    root = P.normalize_path("destination")
    reach = destinations.agg(F.min(root).alias("__lo"), F.max(F.concat(root, F.lit("0"))).alias("__hi"))  # "0" follows "/"
    near = listing.select(F.col("path").alias(name)).join(F.broadcast(reach), (F.col(name) >= F.col("__lo")) & (F.col(name) < F.col("__hi")))
    return near.select(name).distinct().withColumn(mark, F.lit(True))


def series_plan(items: DataFrame, sets: DataFrame, assigned: DataFrame, matches: DataFrame, destinations: DataFrame,
                listing: DataFrame, overrides: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """Consolidation rows of many relations at once.

    Columns: set_id, group, path, size, action (keep/remove/review), reason, source_root, destination, move.
    Destinations keep the path below the owning root; an occupied or doubly planned destination is a conflict and
    the group goes to review. ``overrides`` (group, path) replace a missing winner when the path is a candidate.
    """
    rows = folder_rows(items, sets, assigned, group).where("role <> 'related'")
    keys = ["set_id", group]
    seen = (sets.select("set_id", "folder_a", "folder_b").join(matches, ["folder_a", "folder_b"]).join(assigned, keys)
            .groupBy(*keys).agg(F.bool_or("review_only").alias("__rev")))
    win = decisive_winner(rows, keys)
    g = rows.join(seen, keys).join(win, keys, "left").withColumn(
        "__k", F.when(~F.col("__rev"), F.col("winner"))).drop("winner")
    if overrides is not None:
        ok = overrides.select(group, F.col("path").alias("__o")).join(
            rows.select(group, F.col("path").alias("__o")), [group, "__o"], "left_semi")
        g = g.join(ok, group, "left").withColumn("__k", F.coalesce("__k", "__o")).drop("__o")
    g = g.join(destinations, "set_id").withColumn("destination", F.when(
        F.col("path") == F.col("__k"), preserved_destination("relation_root", "path", "destination")))
    keep = g.where(F.col("path") == F.col("__k")).select(*keys, "path", "destination", "root_order")
    there = _taken(listing, destinations, "destination", "__there")
    own = rows.select(*keys, F.col("path").alias("destination")).distinct().withColumn("__own", F.lit(True))
    keep = keep.join(there, "destination", "left").join(own, [*keys, "destination"], "left")
    first = keep.where("destination is not null").groupBy("set_id", "destination").agg(F.min(group).alias("__first"))
    keep = keep.join(first, ["set_id", "destination"], "left")
    conflict = (F.coalesce("__there", F.lit(False)) & ~F.coalesce("__own", F.lit(False))) | (F.col("__first") != F.col(group))
    state = keep.select(*keys, F.when(F.col("destination").isNull(), "no_destination").when(conflict, "path_conflict").alias("__bad"))
    out = g.join(state, keys, "left")
    reason = (F.when(F.col("__k").isNull(), F.when(F.col("__rev"), "review_only").otherwise("no_decisive_best"))
              .when(F.col("__bad").isNotNull(), F.col("__bad")))
    out = out.withColumn("reason", reason)
    action = F.when(F.col("reason").isNotNull(), "review").when(F.col("path") == F.col("__k"), "keep").otherwise("remove")
    return out.select(*keys, "path", "size", action.alias("action"), "reason", F.col("relation_root").alias("source_root"),
                      F.when(action == "keep", F.col("destination")).alias("destination"),
                      ((action == "keep") & (F.col("destination") != F.col("path"))).alias("move"))


def series_unique_files(media: DataFrame, sets: DataFrame, plan: DataFrame, destinations: DataFrame,
                        listing: DataFrame, group: str = "group_id") -> DataFrame:
    """Files of the relation roots that match nothing: moved along from the target and whole-source roots
    (``move``), already in place, conflicting, or left because coverage is too low (``skipped``)."""
    roots = (sets.select("set_id", F.col("target_folder").alias("root"), F.lit(True).alias("bring"))
             .unionByName(sets.select("set_id", F.col("source_folder").alias("root"), F.col("whole_source").alias("bring"))))
    roots = roots.groupBy("set_id", F.lower("root").alias("rk")).agg(F.min("root").alias("root"), F.bool_or("bring").alias("bring"))
    m = _with_folder(media).select("path", _size().alias("size"), "folder")
    hops = m.select("folder").distinct().withColumn("rk", F.explode(F.transform(P.ancestors("folder"), lambda x: F.lower(x))))
    # a row per folder and set, in files that show their size: few of them do not shuffle the files
    own = store_alone(hops.join(roots, "rk").groupBy("folder", "set_id").agg(F.max_by(F.struct("root", "bring"), F.length("rk")).alias("r")))
    files = m.join(own, "folder").join(plan.select("set_id", "path").distinct(), ["set_id", "path"], "left_anti")
    f = files.join(destinations, "set_id").withColumn("target", preserved_destination("r.root", "path", "destination"))
    planned = plan.where("destination is not null").select("set_id", F.col("destination").alias("target")).distinct().withColumn("__p", F.lit(True))
    there = _taken(listing, destinations, "target", "__t")
    first = f.where(F.col("r.bring")).groupBy("set_id", "target").agg(F.min("path").alias("__first"))
    f = f.join(planned, ["set_id", "target"], "left").join(there, "target", "left").join(first, ["set_id", "target"], "left")
    state = (F.when(~F.col("r.bring"), "skipped").when(F.col("target") == F.col("path"), "in_place")
             .when(F.col("target").isNull() | F.col("__p") | F.col("__t") | (F.col("__first") != F.col("path")), "conflict")
             .otherwise("move"))
    return f.select("set_id", "path", "size", state.alias("state"), F.when(state == "move", F.col("target")).alias("destination"))


def consolidation_preview(plan: DataFrame, unique: DataFrame, confirmed_by_user: DataFrame | None = None,
                          group: str = "group_id") -> DataFrame:
    """Totals of a plan: files and bytes before and after, reclaimable bytes (automatic and user confirmed), moves,
    reviews and conflicts."""
    size = F.greatest("size", F.lit(0))
    p = plan
    if confirmed_by_user is not None:
        p = p.join(confirmed_by_user.select(group).distinct().withColumn("__h", F.lit(True)), group, "left")
    else:
        p = p.withColumn("__h", F.lit(False))
    human = F.coalesce("__h", F.lit(False))
    per_file = p.groupBy("path").agg(
        F.max(size).alias("size"), F.bool_or(F.col("action") == "remove").alias("rm"),
        F.bool_or((F.col("action") == "remove") & human).alias("hrm"))
    files = per_file.agg(F.count("*").alias("matched_files"), F.sum("size").alias("matched_bytes"),
                         F.count_if("rm").alias("remove_files"), F.sum(F.when(F.col("rm"), F.col("size")).otherwise(0)).alias("reclaim_bytes"),
                         F.coalesce(F.sum(F.when(F.col("hrm"), F.col("size")).otherwise(0)), F.lit(0)).cast("bigint").alias("reclaim_user_bytes"))
    grp = p.groupBy("set_id", group).agg(F.bool_or("move").alias("mv"), F.bool_or(F.col("action") == "keep").alias("ok"),
                                         F.bool_or(F.coalesce(F.col("reason") == "path_conflict", F.lit(False))).alias("cf"))
    groups = grp.agg(F.count("*").alias("groups"), F.count_if("ok").alias("executable_groups"),
                     F.count_if("mv").alias("keeper_moves"), F.count_if(~F.col("ok")).alias("review_groups"),
                     F.count_if("cf").alias("conflict_groups"))
    uni = unique.agg(F.count_if(F.col("state") == "move").alias("unique_moves"),
                     F.count_if(F.col("state") == "skipped").alias("unique_skipped"),
                     F.count_if(F.col("state") == "conflict").alias("unique_conflicts"),
                     F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.count("*").alias("unique_files"))
    out = files.crossJoin(groups).crossJoin(uni)  # one row each
    return (out.withColumn("before_files", F.col("matched_files") + F.col("unique_files"))
            .withColumn("before_bytes", F.col("matched_bytes") + F.col("unique_bytes"))
            .withColumn("after_files", F.col("before_files") - F.col("remove_files"))
            .withColumn("after_bytes", F.col("before_bytes") - F.col("reclaim_bytes"))
            .withColumn("reclaim_auto_bytes", F.col("reclaim_bytes") - F.col("reclaim_user_bytes")))


def review_list(items: DataFrame, plan: DataFrame, automatic: bool, criteria=None, group: str = "group_id") -> DataFrame:
    """Groups for the manual (or the confirmed) review list with the recommended winner, reason and candidate count."""
    state = plan.groupBy(group).agg(F.bool_or(F.col("action") == "keep").alias("auto"),
                                    F.max(F.when(F.col("action") == "keep", F.col("path"))).alias("keeper"),
                                    F.count("*").alias("candidates")).where("candidates > 1")
    chosen = state.where(F.col("auto") == F.lit(automatic))
    part = items.join(plan.select(group, "path").distinct(), [group, "path"], "left_semi").join(chosen.select(group), group, "left_semi")
    rec = recommend_best(part, criteria, group)
    return chosen.join(rec, group).select(group, "keeper", "winner", "confirmed", "reason", "candidates")


def validate_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Check plan rows (change_id, path, action, destination) against the catalog: (change_id, error or null).

    The keeper must exist; its destination must be free or belong to a file of the same change.
    """
    keep = changes.where("action = 'keep'").withColumn("destination", F.coalesce("destination", "path"))
    rows = catalog.select(P.normalize_path("path").alias("__p")).distinct().withColumn("__in", F.lit(True))
    own = changes.select("change_id", P.normalize_path("path").alias("__d")).distinct().withColumn("__own", F.lit(True))
    k = keep.withColumn("__k", P.normalize_path("path")).withColumn("__d", P.normalize_path("destination"))
    k = (k.join(rows.withColumnRenamed("__p", "__k").withColumnRenamed("__in", "__has"), "__k", "left")
         .join(rows.withColumnRenamed("__p", "__d").withColumnRenamed("__in", "__occ"), "__d", "left")
         .join(own, ["change_id", "__d"], "left"))
    err = (F.when(F.col("__has").isNull(), "keeper_missing")
           .when(F.col("__occ") & F.col("__own").isNull(), "destination_occupied"))
    return k.select("change_id", err.alias("error"))


def commit_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Next catalog version: losers of valid changes removed, keepers re-pathed. Invalid changes do nothing."""
    ok = validate_changes(catalog, changes).where("error is null").select("change_id")
    good = changes.join(ok, "change_id", "left_semi")
    kept = good.where("action = 'keep'").select("path", F.coalesce("destination", "path").alias("__new"))
    gone = good.where("action = 'remove'").select("path").join(kept.select("path"), "path", "left_anti").distinct()
    out = catalog.join(gone, "path", "left_anti").join(kept, "path", "left").withColumn("path", F.coalesce("__new", "path")).drop("__new")
    return out.withColumn("folder", P.folder_of("path")).select(*catalog.columns) if "folder" in catalog.columns else out


def single_group_plan(items: DataFrame, choices: DataFrame, listing: DataFrame, group: str = "group_id") -> DataFrame:
    """Validate keeper choices (group, path, destination): error code, in-place flag and reclaimable bytes."""
    there = listing.select("path").distinct().withColumn("__on", F.lit(True))
    it = items.join(there, "path", "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    dest = listing.select(F.col("path").alias("destination")).distinct().withColumn("__occ", F.lit(True))
    c = choices.select(group, F.col("path").alias("keeper"), "destination").join(dest, "destination", "left")
    j = it.join(c, group)
    agg = j.groupBy(group, "keeper", "destination", "__occ").agg(
        F.count("*").alias("n"), F.count_if("__on").alias("on_disk"),
        F.bool_or((F.col("path") == F.col("keeper")) & F.col("__on")).alias("keeper_on"),
        F.bool_or(F.col("path") == F.col("destination")).alias("dest_member"),
        F.sum(F.when((F.col("path") != F.col("keeper")) & F.col("__on"), _size()).otherwise(0)).alias("reclaim_bytes"))
    err = (F.when(F.col("n") < 2, "single_item").when(F.col("on_disk") == 0, "nothing_on_disk")
           .when(~F.col("keeper_on"), "keeper_missing")
           .when(F.coalesce("__occ", F.lit(False)) & ~F.col("dest_member"), "destination_occupied"))
    return agg.select(group, "keeper", "destination", err.alias("error"),
                      (F.col("keeper") == F.col("destination")).alias("in_place"), "reclaim_bytes")


def anchor_suggestion(items: DataFrame, winners: DataFrame, relations: DataFrame, matches: DataFrame,
                      threshold: float = 50.0, group: str = "group_id") -> DataFrame:
    """Where the best copy of a group should go: (group, anchor, destination), only when all relations agree."""
    rel = relations.where(F.col("match_percent") + 0.0001 >= max(50.0, threshold))
    m = rel.select("folder_a", "folder_b", "target_folder", "pair_rank").join(
        matches.select("folder_a", "folder_b", group), ["folder_a", "folder_b"])
    w = winners.select(group, F.col("winner").alias("best"))
    j = m.join(w, group).join(items.select(group, "path"), group)
    inside = P.is_within("path", F.col("target_folder"))
    s = j.groupBy(group, "pair_rank", "target_folder", "best").agg(
        F.count_if(inside & (F.col("path") != F.col("best"))).alias("n"),
        F.min(F.when(inside & (F.col("path") != F.col("best")), F.col("path"))).alias("one"))
    best_in = P.is_within("best", F.col("target_folder"))
    anchored = F.concat(P.folder_of("one"), F.lit("/"), P.file_stem("one"), P.extension("best"))
    s = s.withColumn("destination", F.when(best_in, F.col("best")).when(F.col("n") == 1, anchored)).withColumn(
        "anchor", F.when(~best_in & (F.col("n") == 1), F.col("one"))).where("destination is not null")
    norm = P.normalize_path("destination")
    return (s.groupBy(group).agg(F.min(norm).alias("lo"), F.max(norm).alias("hi"),
                                 F.min_by(F.struct("anchor", "destination"), "pair_rank").alias("f"))
            .where("lo = hi").select(group, "f.anchor", "f.destination"))
