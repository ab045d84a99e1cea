"""Row rules: which catalog rows are scanned and compared, and result/catalog filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FRAME_PIXELS, EntryFlag, ScanConfig
from ..functions import paths as P
from ..functions.formats import megabytes
from ..functions.media import has_flag
from ..plans.skew import attach_group

#: Exclusion reasons in rule order (fixed values).
REASONS = ("images_disabled", "excluded_directory", "out_of_scope", "manually_excluded", "too_dark", "missing",
           "path_not_utf8", "size_out_of_range", "path_pattern_missing", "reparse_point", "path_pattern_excluded")


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def below_root(folder: Column, root: str, case_sensitive: bool = True) -> Column:
    """Folder equals the root or lies below it; a first relative segment that starts with a dot does not count."""
    f, r = (folder, root) if case_sensitive else (F.lower(folder), root.lower())
    base = r.rstrip("/\\") or r
    rel = F.substring(f, len(base) + 2, 2**31 - 1)
    sep = F.substring(f, len(base) + 1, 1).isin("/", "\\")
    return (f == r) | (f == base) | (f.startswith(base) & sep & (rel != "") & ~rel.startswith("."))


def in_excluded_directory(folder, rules: Sequence[str]) -> Column:
    """Literal prefixes, wildcards on any segment, or wildcards on the whole path when they hold a separator."""
    f = P._col(folder)
    conds = []
    for rule in rules:
        if not ("*" in rule or "?" in rule):
            conds.append(below_root(f, rule, case_sensitive=False))
        elif "/" in rule or "\\" in rule:
            conds.append(P.wildcard_match(f, rule))
        else:
            pat = P.wildcard_regex(rule)
            conds.append(F.exists(P.path_segments(f), lambda s: s.rlike(pat)))
    return _any(conds)


def in_scope(folder, cfg: ScanConfig) -> Column:
    f = P._col(folder)
    if not cfg.include_subdirectories:
        return f.isin(*cfg.include) if cfg.include else F.lit(False)
    return _any([below_root(f, root) for root in cfg.include])


def exclude_reason(cfg: ScanConfig, exists: str | None = "exists") -> Column:
    """The first rule that excludes a row, or null. Rule order is fixed."""
    f, mb = F.col("folder"), megabytes("size")
    rules: list[tuple[str, Column]] = []
    if not cfg.include_images:
        rules.append(("images_disabled", F.col("is_image")))
    if cfg.excluded_directories:
        rules.append(("excluded_directory", in_excluded_directory(f, cfg.excluded_directories)))
    if not cfg.scan_whole_catalog:
        rules.append(("out_of_scope", ~in_scope(f, cfg)))
    rules += [("manually_excluded", has_flag("flags", EntryFlag.MANUALLY_EXCLUDED)),
              ("too_dark", has_flag("flags", EntryFlag.TOO_DARK))]
    if not cfg.include_missing and exists:
        rules.append(("missing", ~F.col(exists)))
    rules.append(("path_not_utf8", ~P.utf8_safe("path")))
    if cfg.filter_by_size:
        rules.append(("size_out_of_range", (mb > cfg.max_size_mb) | (mb < cfg.min_size_mb)))
    if cfg.path_contains is not None:
        rules.append(("path_pattern_missing", ~_any([P.wildcard_match("path", p) for p in cfg.path_contains])))
    if cfg.ignore_reparse_points:
        rules.append(("reparse_point", has_flag("flags", EntryFlag.REPARSE_POINT)))
    if cfg.path_not_contains is not None:
        rules.append(("path_pattern_excluded", _any([P.wildcard_match("path", p) for p in cfg.path_not_contains])))
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def scan_eligibility(media: DataFrame, cfg: ScanConfig, listing: DataFrame | None = None) -> DataFrame:
    """Add ``exclude_reason``; with a listing, existence comes from it by an equi join on the path."""
    if listing is not None:
        media = media.join(listing.select("path", F.lit(True).alias("__there")).distinct(), "path", "left").withColumn(
            "exists", F.coalesce("__there", F.lit(False))).drop("__there")
    elif "exists" not in media.columns:
        media = media.withColumn("exists", F.lit(True))
    return media.withColumn("exclude_reason", exclude_reason(cfg))


def compare_eligible(media: DataFrame, frames: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Rows that may be compared: not excluded, with metadata, without a frame error, with enough samples."""
    counts = frames.groupBy("file_id").agg(F.count("*").alias("samples"))
    ok = media.where(F.col("duration_s").isNotNull() & ~has_flag("flags", EntryFlag.THUMBNAIL_ERROR))
    if "exclude_reason" in media.columns:
        ok = ok.where(F.col("exclude_reason").isNull())
    j = ok.join(counts, "file_id", "left")
    return j.where(F.col("is_image") | (F.coalesce("samples", F.lit(0)) >= cfg.sample_count)).drop("samples")


def complete_snapshots(media: DataFrame, frames: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Drop files missing a distinct position or holding a frame of the wrong length."""
    full = (frames.groupBy("file_id").agg(F.count_distinct(F.when(F.length("gray") == FRAME_PIXELS, F.col("pos"))).alias("good"),
                                          F.count_if(F.length("gray") != FRAME_PIXELS).alias("odd")))
    need = F.when(F.col("is_image"), 1).otherwise(cfg.sample_count)
    return (media.join(full, "file_id").where((F.col("good") >= need) & (F.col("odd") == 0)).drop("good", "odd"))


def needs_fingerprint(has_words) -> Column:
    """Rows whose audio still has to be fingerprinted: videos without words and without a closing audio flag."""
    closed = EntryFlag.NO_AUDIO_TRACK | EntryFlag.AUDIO_FINGERPRINT_ERROR | EntryFlag.SILENT_AUDIO_TRACK
    return ~F.col("is_image") & ~P._col(has_words) & ~has_flag("flags", closed)


def silent_words(words) -> Column:
    w = P._col(words)
    return (F.size(w) > 0) & F.forall(w, lambda x: x == 0)


def exclusion_summary(media: DataFrame, examples: int = 3) -> DataFrame:
    """Count per reason in descending order, with the first example paths of each."""
    from .ranking import top_per_group
    bad = media.where(F.col("exclude_reason").isNotNull())
    first = top_per_group(bad.select("exclude_reason", "path"), "exclude_reason", [F.col("path")], examples)
    shown = first.groupBy("exclude_reason").agg(F.sort_array(F.collect_list("path")).alias("examples"))
    return (bad.groupBy("exclude_reason").agg(F.count("*").alias("files")).join(shown, "exclude_reason")
            .orderBy(F.col("files").desc(), "exclude_reason"))


# --- result and catalog filters -----------------------------------------------------------------------------------

def filter_results(items: DataFrame, path: str | None = None, kind: str = "all", similarity: tuple[float, float] = (0, 100),
                   only_checked_groups: bool = False, group: str = "group_id") -> DataFrame:
    """Visible rows: a path hit on the item or any item of its group, the type, the range, groups with marks."""
    aggs = {}
    if path:
        aggs["__hit"] = F.bool_or(P.path_hit("path", path))
    if only_checked_groups:
        aggs["__chk"] = F.bool_or("checked")
    out = attach_group(items, group, **aggs) if aggs else items
    if path:
        out = out.where("__hit")
    if kind != "all":
        out = out.where(F.col("is_image") if kind == "images" else ~F.col("is_image"))
    out = out.where(F.col("similarity").between(*similarity))
    if only_checked_groups:
        out = out.where("__chk")
    return out.drop(*aggs)


def filter_catalog(media: DataFrame, kind: str = "all", errors_only: bool = False, flag: int | None = None,
                   search: str = "") -> DataFrame:
    out = media
    if kind != "all":
        img = has_flag("flags", EntryFlag.IMAGE)
        out = out.where(img if kind == "images" else ~img)
    if errors_only:
        out = out.where(has_flag("flags", EntryFlag.ALL_ERRORS | EntryFlag.AUDIO_FINGERPRINT_ERROR))
    if flag is not None:
        out = out.where(has_flag("flags", flag))
    if search:
        out = out.where(F.contains(F.lower("path"), F.lit(search.lower())))
    return out


def custom_criteria(kind: str = "all", min_mb: int = 0, max_mb: int = 2**31 - 1, contains: Sequence[str] = (),
                    not_contains: Sequence[str] = (), similarity: tuple[float, float] = (0, 100)) -> Column:
    """All contains-patterns, none of the excluded patterns, size and similarity ranges, type."""
    mb = megabytes("size")
    cond = (mb >= min_mb) & (mb <= max_mb) & F.col("similarity").between(*similarity)
    if kind == "videos":
        cond = cond & ~F.col("is_image")
    elif kind == "images":
        cond = cond & F.col("is_image")
    for p in contains:
        cond = cond & P.wildcard_match("path", p)
    for p in not_contains:
        cond = cond & ~P.wildcard_match("path", p)
    return cond


def offline_status(items: DataFrame, listing: DataFrame, volumes: DataFrame) -> DataFrame:
    """``status`` per row: on_disk, tombstone (missing on a ready volume) or offline (volume not ready or unknown)."""
    from .relocate import assign_volume
    there = listing.select("path", F.lit(True).alias("__there")).distinct()
    j = assign_volume(items, volumes.select("root")).join(there, "path", "left").join(
        volumes.select(F.col("root").alias("volume_root"), "ready"), "volume_root", "left")
    status = (F.when(F.col("__there"), "on_disk").when(F.coalesce("ready", F.lit(False)), "tombstone")
              .otherwise("offline"))
    return j.withColumn("status", status).drop("__there", "ready", "volume_root")
