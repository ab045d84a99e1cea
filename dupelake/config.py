"""Scan settings as one frozen dataclass, plus the named parameter bundles."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntFlag


class EntryFlag(IntFlag):
    """Catalog row bitmask (fixed values)."""

    IMAGE = 1
    MANUALLY_EXCLUDED = 2
    THUMBNAIL_ERROR = 4
    METADATA_ERROR = 8
    TOO_DARK = 16
    NO_AUDIO_TRACK = 32
    AUDIO_FINGERPRINT_ERROR = 64
    SILENT_AUDIO_TRACK = 128
    REPARSE_POINT = 256
    REPARSE_POINT_CHECKED = 512
    ALL_ERRORS = 4 | 8 | 16


class MatchFlag(IntFlag):
    """Result row bitmask (fixed values)."""

    FLIPPED = 1
    PARTIAL_CLIP = 2
    AI_MATCHED = 4
    GRAYSCALE = 8
    PHASH = 16


#: Side of the square luma frame, its pixel count, and the divisor used to turn a
#: per-pixel difference into a fraction (fixed values).
FRAME_SIDE = 32
FRAME_PIXELS = 1024
DIFF_DIVISOR = 256
DARK_LEVEL = 0x20
BRIGHT_LEVEL = 0xF0
DARK_SHARE = 0.80

#: Dense clip matching (fixed values).
DENSE_MIN_HITS = 4
DENSE_OFFSET_TOLERANCE_S = 30.0
DENSE_MAX_SLOTS = 400


@dataclass(frozen=True)
class ScanConfig:
    include: tuple[str, ...] = ()
    include_subdirectories: bool = True
    excluded_directories: tuple[str, ...] = ()
    include_images: bool = True
    include_missing: bool = False
    scan_whole_catalog: bool = False
    ignore_reparse_points: bool = False
    filter_by_size: bool = False
    min_size_mb: int = 0
    max_size_mb: int = 2**31 - 1
    path_contains: tuple[str, ...] | None = None
    path_not_contains: tuple[str, ...] | None = None

    sample_count: int = 1
    max_sampling_s: float = 0.0
    percent: float = 96.0
    flip: bool = False
    ignore_black: bool = False
    ignore_white: bool = False
    use_phash: bool = False
    combine: bool = False
    quorum_ratio: float = 0.6
    use_ai: bool = False
    ai_percent: float = 94.0

    duration_percent: float = 20.0
    duration_min_s: float = 0.0
    duration_max_s: float = 0.0
    folder_mode: str = "none"  # none | same | different
    folder_depth: int = 1
    exclude_hard_links: bool = False

    partial_clips: bool = False
    partial_min_ratio: float = 0.10
    partial_similarity: float = 0.80
    partial_require_visual: bool = True
    partial_visual_threshold: float = 0.85
    ai_partial: bool = False
    ai_partial_hit_percent: float = 89.0

    #: components up to this many distinct feature classes are replayed in one task;
    #: larger ones run the same rule as distributed rounds.
    replay_limit: int = 2000
    block_rows: int = 512

    def with_(self, **changes) -> "ScanConfig":
        return replace(self, **changes)


#: Named bundles of matching knobs (fixed values).
SCAN_PROFILES = {
    "exact_and_near": dict(percent=98.0, flip=False, ignore_black=False, ignore_white=False,
                           partial_clips=False, use_ai=False, ai_partial=False),
    "edited_and_altered": dict(percent=92.0, flip=True, ignore_black=True, ignore_white=True,
                               partial_clips=False, use_ai=False, ai_partial=False),
    "ai_scan": dict(percent=92.0, flip=True, ignore_black=True, ignore_white=True,
                    partial_clips=False, use_ai=True, ai_partial=False),
    "deep_clean": dict(percent=92.0, flip=True, ignore_black=True, ignore_white=True,
                       partial_clips=True, use_ai=True, ai_partial=True),
}


def scan_profile(name: str, base: ScanConfig | None = None) -> ScanConfig:
    """Apply one of the named profiles on top of ``base``."""
    return (base or ScanConfig()).with_(**SCAN_PROFILES[name])
