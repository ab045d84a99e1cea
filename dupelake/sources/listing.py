"""File listings and content keys from any file system Spark can read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths as P
from ..operators.eligibility import in_excluded_directory
from ..operators.features import ranged_content_keys


def read_listing(spark: SparkSession, paths: Sequence[str], recursive: bool = True, images: bool = True,
                 excluded: Sequence[str] = (), with_content_key: bool = False) -> DataFrame:
    """(path, folder, size, modified, is_image[, content_key]) of the media files below the paths.

    Contents are only read for content keys, and then 64 KiB at each end of a file. Empty files do
    not appear: Spark's file scan leaves them out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.load(list(paths))
    clean = F.regexp_replace("path", "^file:/*", "/")
    keep = P.is_media_path("path") if images else (P.is_media_path("path") & ~P.is_image_path("path"))
    rows = raw.where(keep)
    if excluded:
        rows = rows.where(~in_excluded_directory(P.folder_of(clean), excluded))
    out = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if with_content_key:
        keys = ranged_content_keys(out).select(F.col("path").alias("__path"), "content_key")
        out = out.join(keys, F.col("path") == F.col("__path"))
    return out.select(clean.alias("path"), P.folder_of(clean).alias("folder"), "size", "modified", P.is_image_path("path").alias("is_image"),
                      *(["content_key"] if with_content_key else []))


def count_folder_trees(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """Files and bytes of each requested folder tree."""
    from ..operators.folders import recursive_folder_stats
    return recursive_folder_stats(listing, roots)
