"""Aggregate reports over result groups and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EntryFlag, MatchFlag
from ..functions.media import has_flag


def _size() -> Column:
    return F.greatest(F.col("size"), F.lit(0))


def group_statistics(items: DataFrame, group: str = "group_id") -> DataFrame:
    g = items.groupBy(group).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("items"), F.avg("n").alias("avg_size"),
                 F.max("n").alias("max_size"), F.count_if(F.col("n") > 5).alias("over_5"),
                 F.count_if(F.col("n") > 10).alias("over_10"))


def result_totals(items: DataFrame, group: str = "group_id") -> DataFrame:
    g = items.groupBy(group).agg(F.count("*").alias("n"), F.sum(_size()).alias("total"), F.max(_size()).alias("largest"))
    return g.agg(F.sum("n").alias("items"), F.count("*").alias("groups"), F.sum("total").alias("total_bytes"),
                 F.sum(F.col("total") - F.col("largest")).alias("savings"))


def group_headers(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Per group of two or more: totals, wasted bytes, similarity range and any-of marks."""
    status = F.col("status") if "status" in items.columns else F.lit("on_disk")
    return items.groupBy(group).agg(
        F.count("*").alias("files"), F.sum(_size()).alias("total_bytes"),
        (F.sum(_size()) - F.max(_size())).alias("wasted_bytes"),
        F.min("similarity").alias("sim_min"), F.max("similarity").alias("sim_max"),
        F.count_if(status == "on_disk").alias("on_disk"), F.bool_or(status == "tombstone").alias("any_tombstone"),
        F.bool_or(status == "offline").alias("any_offline"), F.bool_or("checked").alias("any_checked"),
        F.bool_or(has_flag("flags", MatchFlag.GRAYSCALE)).alias("any_gray"),
        F.bool_or(has_flag("flags", MatchFlag.PHASH)).alias("any_hash")).where("files > 1")


def flag_counts(media: DataFrame) -> DataFrame:
    """Rows per catalog flag plus the number of rows with any error, in one pass."""
    errors = EntryFlag.ALL_ERRORS | EntryFlag.AUDIO_FINGERPRINT_ERROR
    single = [f for f in EntryFlag if bin(f.value).count("1") == 1]
    return media.agg(*[F.count_if(has_flag("flags", f)).alias(f.name.lower()) for f in single],
                     F.count_if(has_flag("flags", errors)).alias("errors"))


def checked_totals(items: DataFrame, group: str = "group_id") -> DataFrame:
    c = F.col("checked")
    per = items.where(c).groupBy(group).agg(F.count("*").alias("n"), F.sum(_size()).alias("b"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked_items"),
                   F.coalesce(F.sum("b"), F.lit(0)).alias("checked_bytes"), F.count("*").alias("checked_groups"))


def cleanup_report(items: DataFrame, remove: Column | str = "checked", group: str = "group_id") -> DataFrame:
    """Dry run per group: how many and which share goes, and what it saves."""
    r = F.col(remove) if isinstance(remove, str) else remove
    return items.groupBy(group).agg(
        F.count_if(r).alias("removed"), F.count_if(~r).alias("kept"),
        F.sum(F.when(r, _size()).otherwise(0)).alias("savings"),
        F.min(F.when(~r, F.col("path"))).alias("first_kept")).where("removed > 0")


def cleanup_lines(items: DataFrame, remove: Column | str = "checked", group: str = "group_id") -> DataFrame:
    """Dry-run detail rows (one per file, keep or remove) - groups are never collected into arrays."""
    r = F.col(remove) if isinstance(remove, str) else remove
    hit = items.groupBy(group).agg(F.bool_or(r).alias("h")).where("h").select(group)
    return items.join(hit, group, "left_semi").select(
        group, "path", "size", F.when(r, "remove").otherwise("keep").alias("action"))


def entries_under(media: DataFrame, folder: str) -> DataFrame:
    from ..functions.paths import is_within
    return media.where(is_within("folder", F.lit(folder))).agg(F.count("*").alias("files"))


def unassigned_summary(items: DataFrame, assigned_groups: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups, files and bytes no folder relation covers."""
    per = (items.join(assigned_groups.select(group).distinct(), group, "left_anti").groupBy(group)
           .agg(F.count("*").alias("n"), F.sum(_size()).alias("b")))
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
                   F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def folder_content(items: DataFrame, winners: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """Participating files, bytes and distinct groups per folder, with best / confirmed / review counts."""
    df = items
    if winners is not None:
        df = df.join(winners.select(group, F.col("winner").alias("__w"), "confirmed"), group, "left")
        best = F.coalesce(F.col("path") == F.col("__w"), F.lit(False))
    else:
        best, df = F.lit(False), df.withColumn("confirmed", F.lit(False))
    # distinct groups per folder as two map-side combined steps instead of one wide count-distinct
    per = df.groupBy("folder", group).agg(
        F.count("*").alias("n"), F.sum(_size()).alias("b"), F.count_if(best).alias("best"),
        F.count_if(best & F.col("confirmed")).alias("conf"))
    return per.groupBy("folder").agg(
        F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.count("*").alias("groups"),
        F.sum("best").alias("best"), F.sum("conf").alias("confirmed"),
        (F.sum("best") - F.sum("conf")).alias("review"))


def deletion_outcome(items: DataFrame, outcome: DataFrame, group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """Apply a table of deletion results (path, ok): remaining result rows without singletons, and freed bytes."""
    from .grouping import drop_singleton_groups
    gone = outcome.where("ok").select("path").distinct()
    freed = items.join(gone, "path", "left_semi").agg(
        F.count("*").alias("removed"), F.coalesce(F.sum(_size()), F.lit(0)).alias("freed_bytes"))
    return drop_singleton_groups(items.join(gone, "path", "left_anti"), group), freed
