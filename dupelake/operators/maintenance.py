"""Catalog maintenance: each function maps catalog DataFrames to the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FRAME_PIXELS, EntryFlag
from ..functions.media import has_flag
from .relocate import moved_files

_FEATURE_FLAGS = (EntryFlag.THUMBNAIL_ERROR | EntryFlag.METADATA_ERROR | EntryFlag.TOO_DARK
                  | EntryFlag.NO_AUDIO_TRACK | EntryFlag.AUDIO_FINGERPRINT_ERROR | EntryFlag.SILENT_AUDIO_TRACK)


def refresh(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Bring the catalog up to date with a listing.

    ``change``: kept, redated (same bytes, new dates), replaced (features are void), relinked (moved file keeps its
    features under the new path), new, missing (row stays). ``keep_features`` tells which child features survive.
    """
    moves = moved_files(catalog, listing)
    base = (catalog.join(moves, F.col("path") == F.col("old_path"), "left")
            .withColumn("__moved", F.col("new_path").isNotNull())
            .withColumn("path", F.coalesce("new_path", "path")).drop("old_path", "new_path"))
    l = listing.select("path", F.col("size").alias("l_size"), F.col("created").alias("l_created"),
                       F.col("modified").alias("l_modified"), F.col("content_key").alias("l_key"))
    j = base.join(l, "path", "full_outer")
    there, known = F.col("l_size").isNotNull(), F.col("file_id").isNotNull()
    same_size = F.col("size") == F.col("l_size")
    same_dates = F.col("created").eqNullSafe(F.col("l_created")) & F.col("modified").eqNullSafe(F.col("l_modified"))
    same_bytes = F.coalesce(F.col("content_key") == F.col("l_key"), F.lit(False))
    change = (F.when(~known, "new").when(F.col("__moved"), "relinked").when(~there, "missing")
              .when(same_size & same_dates, "kept").when(same_size & same_bytes, "redated").otherwise("replaced"))
    j = j.withColumn("change", change).withColumn(
        "keep_features", F.col("change").isin("kept", "redated", "relinked", "missing"))
    fresh = F.col("change").isin("new", "replaced")
    out = (j.withColumn("file_id", F.coalesce("file_id", F.xxhash64("path")))
           .withColumn("size", F.coalesce("l_size", "size")).withColumn("created", F.coalesce("l_created", "created"))
           .withColumn("modified", F.coalesce("l_modified", "modified"))
           .withColumn("content_key", F.when(fresh, F.col("l_key")).otherwise(F.col("content_key"))))
    if "flags" in catalog.columns:
        out = out.withColumn("flags", F.when(fresh, F.lit(0)).otherwise(F.col("flags")))
    if "folder" in catalog.columns:
        from ..functions.paths import folder_of
        out = out.withColumn("folder", folder_of("path"))
    return out.select(*catalog.columns, "change", "keep_features")


def surviving_features(features: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Child feature rows whose file kept its features."""
    return features.join(refreshed.where("keep_features").select("file_id"), "file_id", "left_semi")


def clean(catalog: DataFrame, listing: DataFrame, remember_deleted: bool = False, volumes: DataFrame | None = None,
          features: DataFrame | None = None) -> DataFrame:
    """Drop missing and errored rows; with ``remember_deleted`` rows with comparable data or offline volumes stay."""
    ok = catalog.where(~has_flag("flags", EntryFlag.METADATA_ERROR | EntryFlag.THUMBNAIL_ERROR))
    if not remember_deleted:
        return ok.join(listing.select("path"), "path", "left_semi")
    return drop_ghosts(ok, listing, volumes, features)


def ghosts(catalog: DataFrame, listing: DataFrame, volumes: DataFrame, features: DataFrame) -> DataFrame:
    """Rows missing on a ready volume that hold neither audio words nor any frame."""
    from .eligibility import offline_status
    gone = offline_status(catalog, listing, volumes).where("status = 'tombstone'").drop("status")
    return gone.join(features.select("file_id").distinct(), "file_id", "left_anti")


def drop_ghosts(catalog: DataFrame, listing: DataFrame, volumes: DataFrame, features: DataFrame) -> DataFrame:
    return catalog.join(ghosts(catalog, listing, volumes, features).select("path"), "path", "left_anti")


def clear_all(catalog: DataFrame) -> DataFrame:
    return catalog.limit(0)


def exclude_files(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    return _set_flag(catalog, keys, F.lit(True))


def toggle_exclusion(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """If any of the keys is not excluded, exclude all of them, otherwise include all."""
    all_out = (catalog.join(keys.select("path").distinct(), "path", "left_semi")
               .agg(F.bool_and(has_flag("flags", EntryFlag.MANUALLY_EXCLUDED)).alias("__all")))
    wide = catalog.crossJoin(F.broadcast(all_out))  # one aggregate row
    return _set_flag(wide, keys, ~F.coalesce(F.col("__all"), F.lit(False))).drop("__all")


def _set_flag(catalog: DataFrame, keys: DataFrame, on: Column) -> DataFrame:
    bit = int(EntryFlag.MANUALLY_EXCLUDED)
    j = catalog.join(keys.select("path").distinct().withColumn("__hit", F.lit(True)), "path", "left")
    value = F.when(on, F.col("flags").bitwiseOR(F.lit(bit))).otherwise(F.col("flags").bitwiseAND(F.lit(~bit)))
    return j.withColumn("flags", F.when(F.col("__hit"), value).otherwise(F.col("flags"))).select(*catalog.columns)


def repath(catalog: DataFrame, mapping: DataFrame) -> DataFrame:
    """Change path keys by a (path, new_path) mapping."""
    from ..functions.paths import folder_of
    j = catalog.join(mapping.select("path", "new_path"), "path", "left").withColumn("path", F.coalesce("new_path", "path"))
    if "folder" in catalog.columns:
        j = j.withColumn("folder", folder_of("path"))
    return j.select(*catalog.columns)


def clear_features(catalog: DataFrame, features: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forget the cached features of some files and their six feature flags."""
    ids = catalog.join(keys.select("path").distinct(), "path", "left_semi").select("file_id")
    hit = catalog.join(ids.withColumn("__hit", F.lit(True)), "file_id", "left")
    flags = F.when(F.col("__hit"), F.col("flags").bitwiseAND(F.lit(~int(_FEATURE_FLAGS)))).otherwise(F.col("flags"))
    return (hit.withColumn("flags", flags).select(*catalog.columns), features.join(ids, "file_id", "left_anti"))


def import_preview(catalog: DataFrame, imported: DataFrame, current_version: int = 1) -> DataFrame:
    """One row of counts and bytes: source, current, new, already present, images whose features are outdated."""
    size = F.greatest("size", F.lit(0))
    src = imported.agg(F.count("*").alias("source_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("source_bytes"),
                       F.count_if(F.col("is_image") & (F.coalesce("feature_version", F.lit(0)) < current_version)).alias(
                           "outdated_images"))
    cur = catalog.agg(F.count("*").alias("current_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("current_bytes"))
    fresh = imported.join(catalog.select("path"), "path", "left_anti").agg(
        F.count("*").alias("new_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("new_bytes"))
    # three one-row aggregates
    return (src.crossJoin(cur).crossJoin(fresh)
            .withColumn("existing_rows", F.col("source_rows") - F.col("new_rows")))


def import_rows(catalog: DataFrame, imported: DataFrame) -> DataFrame:
    """Add imported rows whose path is new; the existing row wins."""
    one = imported.dropDuplicates(["path"]).join(catalog.select("path"), "path", "left_anti")
    return catalog.unionByName(one.select(*catalog.columns))


def invalidate_features(features: DataFrame, media: DataFrame, current_version: int = 1, images_only: bool = True) -> DataFrame:
    """Drop features made by an older pipeline version."""
    old = media.where(F.coalesce("feature_version", F.lit(0)) < current_version)
    if images_only:
        old = old.where("is_image")
    return features.join(old.select("file_id"), "file_id", "left_anti")


def heal_frames(frames: DataFrame) -> DataFrame:
    """Drop frames whose length is not 32x32 (and with them their hash)."""
    return frames.where(F.length("gray") == FRAME_PIXELS)


def prune_cache(cache: DataFrame, media: DataFrame) -> DataFrame:
    """Keep cached features whose (path, size, modified) still matches the catalog."""
    return cache.join(media.select("path", "size", "modified"), ["path", "size", "modified"], "left_semi")


def delete_rows(catalog: DataFrame, condition: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Remove every row the filter shows, or a key set."""
    if condition is not None:
        return catalog.where(~F.coalesce(condition, F.lit(False)))
    return catalog.join(keys.select("path").distinct(), "path", "left_anti")


def remove_results(items: DataFrame, removed: DataFrame, group: str = "group_id") -> DataFrame:
    """Take rows out of the results; groups left with one item vanish."""
    from .grouping import drop_singleton_groups
    return drop_singleton_groups(items.join(removed.select("path").distinct(), "path", "left_anti"), group)


def effective_roots(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """Distinct include roots minus the excluded ones."""
    return include.select("path").distinct().join(exclude.select("path").distinct(), "path", "left_anti")
