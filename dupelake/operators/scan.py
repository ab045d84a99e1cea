"""One scan: eligibility, the classic phase, audio clips, embedding clips, best values and the keep/remove plan.

Later phases leave out what earlier ones have grouped, so every file is in one phase only. The relation of grouped files is
the only thing that passes from phase to phase; frames for the visual check are asked for once the audio matches are bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import MatchFlag, ScanConfig
from ..plans.skew import cut_lineage
from .eligibility import compare_eligible, scan_eligibility
from .grouping import emit_clips, find_duplicates
from .partial import audio_bindings, dense_partial, needed_samples, visual_gate
from .ranking import CRITERIA, best_flags, pick_keeper, review_only
from .scoring import compare_snapshot

#: Quality columns of an item and what stands in for one that the catalog lacks.
QUALITY = {"w": "0", "h": "0", "frame_size_int": "coalesce(w + h, 0)", "format": "''", "audio_format": "''", "audio_channel": "''",
           "audio_sample_rate": "0", "audio_kbps": "cast(0 as decimal(18,0))", "kbps": "cast(0 as decimal(18,0))", "fps": "cast(0 as float)", "hdr": "''"}

FrameSource = Callable[[DataFrame], DataFrame]


def frame_requests(bound: DataFrame, media: DataFrame) -> DataFrame:
    """(file_id, sec), each once: the moments the visual check of bound clips compares."""
    need = needed_samples(bound, media)
    return (need.select(F.col("source_id").alias("file_id"), F.col("src_at").alias("sec"))
            .unionByName(need.select(F.col("clip_id").alias("file_id"), F.col("clip_at").alias("sec"))).distinct())


def scan_phases(media: DataFrame, frames: DataFrame, cfg: ScanConfig, embeddings: DataFrame | None = None, audio: DataFrame | None = None,
                dense: DataFrame | None = None, fetch_frames: FrameSource | None = None) -> DataFrame:
    """phase, group_id, file_id, similarity (percent), flags, clip_offset_s of all phases of a scan.

    ``media`` holds files that may be compared. ``fetch_frames`` maps requests (file_id, sec) to rows (file_id, sec, gray)
    and may leave out what cannot be read; without it, audio matches are not checked.
    """
    classic = cut_lineage(find_duplicates(compare_snapshot(compare_eligible(media, frames, cfg), frames, cfg, embeddings), cfg))
    out = classic.select(F.lit("classic").alias("phase"), "group_id", "file_id", "similarity", "flags", F.lit(0.0).alias("clip_offset_s"))
    grouped = classic.select("file_id")

    def clips(rows: DataFrame, phase: str) -> DataFrame:
        return cut_lineage(rows.select(F.lit(phase).alias("phase"), "group_id", "file_id", ((F.lit(1.0) - F.col("diff")) * 100).cast("float").alias("similarity"),
                                       "flags", "clip_offset_s"))

    if cfg.partial_clips and audio is not None:
        bound = cut_lineage(audio_bindings(media, audio, cfg, grouped))
        if cfg.partial_require_visual and fetch_frames is not None:
            bound = visual_gate(bound, media, fetch_frames(frame_requests(bound, media)), cfg)
        found = clips(emit_clips(bound, MatchFlag.PARTIAL_CLIP), "audio")
        out, grouped = out.unionByName(found), grouped.unionByName(found.select("file_id"))
    if cfg.ai_partial and dense is not None:
        out = out.unionByName(clips(dense_partial(media, dense, cfg, grouped), "dense"))
    return out


def scan_and_compare(media: DataFrame, frames: DataFrame, cfg: ScanConfig, embeddings: DataFrame | None = None, audio: DataFrame | None = None,
                     dense: DataFrame | None = None, fetch_frames: FrameSource | None = None, order: Sequence[str] = tuple(CRITERIA),
                     listing: DataFrame | None = None) -> DataFrame:
    """Result items of a whole scan, with best-value marks, ``is_keeper`` and ``action`` (keep, remove or review).

    Groups whose identity is too uncertain for an automatic choice (clips, mirrored matches, mixed types, spread
    durations) are up for review as a whole.
    """
    usable = scan_eligibility(media, cfg, listing).where("exclude_reason is null")
    found = scan_phases(usable, frames, cfg, embeddings, audio, dense, fetch_frames)
    for name, default in QUALITY.items():
        value = F.expr(default)
        usable = usable.withColumn(name, F.coalesce(F.col(name), value) if name in usable.columns else value)
    # one group column for all phases
    items = (found.withColumnRenamed("flags", "match_flags").join(usable.withColumnRenamed("flags", "file_flags"), "file_id")
             .withColumn("group_id", F.concat_ws(":", "phase", F.col("group_id").cast("string"))).withColumnRenamed("match_flags", "flags"))
    items = cut_lineage(items)
    marked = pick_keeper(best_flags(items), [CRITERIA[n] for n in order])
    verdict = review_only(items).select("group_id", "review_only")
    action = F.when(F.col("review_only"), "review").when(F.col("is_keeper"), "keep").otherwise("remove")
    return marked.join(verdict, "group_id").withColumn("action", action)
