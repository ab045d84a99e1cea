"""Moved files, volume assignment, hidden groups and path rewriting as equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P


def moved_files(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """(old_path, new_path): a new path whose size and content key match exactly one vanished catalog row.

    Several new copies of one vanished file: the first path takes it, the others stay new.
    """
    fresh = listing.join(catalog.select("path"), "path", "left_anti").where("content_key is not null")
    gone = catalog.where("content_key is not null").join(listing.select("path"), "path", "left_anti")
    sole = (gone.groupBy("size", "content_key").agg(F.count("*").alias("n"), F.min("path").alias("old_path"))
            .where("n = 1"))
    takers = fresh.groupBy("size", "content_key").agg(F.min("path").alias("new_path"))
    return sole.join(takers, ["size", "content_key"]).select("old_path", "new_path")


def relocation_candidates(missing: DataFrame, found: DataFrame, use_modified: bool = True,
                          use_duration: bool = False) -> DataFrame:
    """Classify vanished rows against found files of the same size: (path, new_path, confidence, candidates).

    Refinement keys are bucketed (2 s of modification time, 0.5 s of duration), so a common size does not pair
    every missing row with every found file.
    """
    sizes = found.groupBy("size").agg(F.count("*").alias("same_size"), F.min("path").alias("only_path"))
    base = missing.join(sizes, "size", "left")
    easy = (base.where(F.coalesce("same_size", F.lit(0)) <= 1)
            .select("path", F.col("only_path").alias("new_path"),
                    F.when(F.col("same_size") == 1, "size_only").otherwise("not_found").alias("confidence"),
                    F.coalesce("same_size", F.lit(0)).cast("bigint").alias("candidates")))
    hard = base.where(F.col("same_size") > 1)
    left = hard.select(F.col("path").alias("m_path"), "size", F.col("modified").alias("m_mod"),
                       F.round("duration_s", 2).alias("m_dur"))
    right = found.select(F.col("path").alias("f_path"), "size", F.col("modified").alias("f_mod"),
                         F.col("duration_s").alias("f_dur"))
    keys, cond = ["size"], F.lit(True)
    if use_modified:
        left = left.withColumn("mb", F.explode(F.array(*[F.floor(F.col("m_mod").cast("double") / 2) + d for d in (-1, 0, 1)])))
        right = right.withColumn("mb", F.floor(F.col("f_mod").cast("double") / 2))
        keys.append("mb")
        cond = cond & (F.abs(F.col("f_mod").cast("double") - F.col("m_mod").cast("double")) <= 2)
    if use_duration:
        near = F.abs(F.col("f_dur") - F.col("m_dur")) <= 0.5
        cond = cond & (F.col("m_dur").isNull() | near)
        if not use_modified:
            # a missing row without a duration keeps every same-size file, so only rows with one are bucketed
            left = left.withColumn("db", F.explode(F.array(*[F.floor(F.col("m_dur") * 2) + d for d in (-1, 0, 1)])))
            right = right.withColumn("db", F.floor(F.col("f_dur") * 2))
            keys.append("db")
    hits = left.join(right, keys).where(cond).groupBy("m_path").agg(
        F.count("*").alias("n"), F.min("f_path").alias("one"))
    resolved = "size_modified_duration" if use_duration else "size_and_modified" if use_modified else "size_only"
    refined = (hard.select("path", "same_size", "duration_s").join(hits, F.col("path") == F.col("m_path"), "left")
               .withColumn("n", F.when(F.lit(use_duration and not use_modified) & F.col("duration_s").isNull(),
                                       F.col("same_size")).otherwise(F.coalesce("n", F.lit(0))))
               .select("path", F.when(F.col("n") == 1, F.col("one")).alias("new_path"),
                       F.when(F.col("n") == 1, resolved).when(F.col("n") > 1, "ambiguous").otherwise(
                           "not_found").alias("confidence"), F.col("n").cast("bigint").alias("candidates")))
    return easy.unionByName(refined)


def relocate_prefix(media: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """Rewrite a path prefix; other rows stay."""
    old = old_prefix.rstrip("/\\") + "/"
    new = new_prefix.rstrip("/\\") + "/"
    hit = F.col("path").startswith(old)
    moved = F.concat(F.lit(new), F.substring(F.col("path"), len(old) + 1, 2**31 - 1))
    out = media.withColumn("path", F.when(hit, moved).otherwise(F.col("path")))
    return out.withColumn("folder", P.folder_of("path")) if "folder" in media.columns else out


def longest_root(rows: DataFrame, roots: DataFrame, path: str, root: str, out: str) -> DataFrame:
    """Longest root that equals or contains the path, by joining the ancestor chain of the distinct paths."""
    r = roots.select(F.lower(P.normalize_path(root)).alias("__rk"), F.col(root).alias("__root")).groupBy("__rk").agg(
        F.min("__root").alias("__root"))
    distinct = rows.select(F.col(path).alias("__p")).distinct()
    hops = distinct.select("__p", F.explode(F.array_union(P.ancestors("__p"), F.array(F.lit("/")))).alias("__a"))
    best = (hops.withColumn("__rk", F.lower("__a")).join(r, "__rk").groupBy("__p")
            .agg(F.max_by("__root", F.length("__rk")).alias(out)))
    return rows.join(best, F.col(path) == F.col("__p"), "left").drop("__p")


def assign_volume(media: DataFrame, volumes: DataFrame) -> DataFrame:
    """``volume_root`` per file: the longest mounted root, else the root of the path itself."""
    base = media if "folder" in media.columns else media.withColumn("folder", P.folder_of("path"))
    j = longest_root(base, volumes, "folder", "root", "volume_root")
    own = (F.when(F.col("path").startswith("/"), "/")
           .when(F.col("path").rlike(r"^[A-Za-z]:"), F.concat(F.substring("path", 1, 2), F.lit("\\")))
           .otherwise("?"))
    return j.withColumn("volume_root", F.coalesce("volume_root", own))


def volume_totals(media: DataFrame, volumes: DataFrame, done: str | None = None) -> DataFrame:
    """Files and bytes per volume, total and done."""
    d = F.col(done) if done else F.lit(False)
    return assign_volume(media, volumes).groupBy("volume_root").agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_bytes"), F.count_if(d).alias("done_files"),
        F.sum(F.when(d, F.col("size")).otherwise(0)).alias("done_bytes"))


def owning_root(items: DataFrame, roots: DataFrame) -> DataFrame:
    """``owner`` per item: the longest relation root that contains its folder."""
    return longest_root(items, roots, "folder", "root", "owner")


def hidden_groups(items: DataFrame, not_a_match: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups whose every path lies in one not-a-match set (relational division by counting)."""
    need = items.select(group, "path").distinct().groupBy(group).agg(F.count("*").alias("need"))
    sets = not_a_match.select("set_id", "path").distinct()
    have = (items.select(group, "path").distinct().join(sets, "path").groupBy(group, "set_id")
            .agg(F.count("*").alias("have")))
    return have.join(need, group).where("have = need").select(group).distinct()


def hide_not_a_match(items: DataFrame, not_a_match: DataFrame, group: str = "group_id") -> DataFrame:
    return items.join(hidden_groups(items, not_a_match, group), group, "left_anti")


def prune_not_a_match(not_a_match: DataFrame, listing: DataFrame) -> DataFrame:
    """Drop sets with any path that is no longer listed."""
    broken = not_a_match.join(listing.select("path"), "path", "left_anti").select("set_id").distinct()
    return not_a_match.join(broken, "set_id", "left_anti")


def quarantine(catalog: DataFrame, attempts: DataFrame) -> DataFrame:
    """Flag files whose last attempt began but never ended: audio phases get the audio error, others the frame error."""
    from ..config import EntryFlag
    # at one time a begin counts as the later event, so that a file is rather looked at again than lost
    last = attempts.groupBy("phase", "path").agg(F.max_by("event", F.struct("ts", F.col("event") == "begin")).alias("event"))
    bad = last.where("event = 'begin'").groupBy("path").agg(
        F.bit_or(F.when(F.col("phase") == "audio", int(EntryFlag.AUDIO_FINGERPRINT_ERROR)).otherwise(
            int(EntryFlag.THUMBNAIL_ERROR))).alias("__f"))
    return catalog.join(bad, "path", "left").withColumn(
        "flags", F.col("flags").bitwiseOR(F.coalesce("__f", F.lit(0)))).drop("__f")
