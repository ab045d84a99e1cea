"""Display and export text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import MatchFlag
from .paths import _col

#: Size suffixes (fixed values).
SIZE_SUFFIXES = (" B", " KB", " MB", " GB", " TB", " PB", " EB")

#: Ordered diagnostic-text rules; the first category with a contained needle wins (fixed values).
ERROR_RULES = (
    ("hardware_acceleration", (
        "lacking required capabilities", "hwaccel initiali", "failed setup for format",
        "no device available for decoder", "hwaccel transfer data failed", "cannot load nvcuda",
        "cannot load libcuda", "cannot load cuda", "hw_device_ctx", "device creation failed")),
    ("library_load", (
        "unable to load shared library", "could not load", "dllnotfound",
        "the installed ffmpeg major version does not match", "version mismatch")),
    ("unsupported_codec", (
        "decoder not found", "unknown decoder", "no decoder for", "codec not currently supported")),
    ("corrupt_or_truncated", (
        "moov atom not found", "invalid data found when processing input", "invalid nal unit size",
        "error splitting the input into nal units", "could not find codec parameters", "non-existing pps",
        "non-existing sps", "error while decoding", "partial file", "truncat")),
    ("file_access", (
        "permission denied", "no such file or directory", "operation not permitted", "protocol not found")),
    ("hardware_acceleration", ("generic error in an external library",)),
)


def fixed_text(value, decimals: int) -> Column:
    """Invariant fixed-point text, halves away from zero."""
    return F.format_string(f"%.{decimals}f", _col(value).cast("double"))


def bytes_text(size) -> Column:
    """``1536`` -> ``1.5 KB``; zero is ``0 B``."""
    v = _col(size).cast("double")
    place = reduce(lambda acc, i: F.when(v >= float(1024 ** i), F.lit(i)).otherwise(acc), range(1, 7), F.lit(0))
    suffix = F.element_at(F.array(*[F.lit(s) for s in SIZE_SUFFIXES]), place + 1)
    return F.when(v == 0, F.lit("0 B")).otherwise(F.concat(fixed_text(v / F.pow(F.lit(1024.0), place), 1), suffix))


def megabytes(size) -> Column:
    """Whole megabytes with single-precision division, truncated toward zero."""
    f = _col(size).cast("float")
    return ((f / F.lit(1024.0).cast("float")).cast("float") / F.lit(1024.0).cast("float")).cast("float").cast("bigint")


def similarity_text(similarity) -> Column:
    r = F.bround(_col(similarity).cast("double"), 1)
    return F.when(r == F.bround(r, 0), F.concat(fixed_text(r, 0), F.lit(" %"))).otherwise(
        F.concat(fixed_text(r, 1), F.lit(" %")))


def bitrate_text(kbps) -> Column:
    k = _col(kbps).cast("double")
    return (F.when(k.isNull() | (k <= 0), F.lit(""))
            .when(k >= 1000, F.concat(fixed_text(k / 1000, 1), F.lit(" Mb/s")))
            .otherwise(F.concat(fixed_text(k, 0), F.lit(" kb/s"))))


def _optional_decimals(value, decimals: int) -> Column:
    return F.regexp_replace(fixed_text(value, decimals), r"\.?0+$", "") if decimals else fixed_text(value, 0)


def sample_rate_text(hz) -> Column:
    h = _col(hz).cast("double")
    return F.when(h.isNull() | (h <= 0), F.lit("")).otherwise(
        F.concat(_optional_decimals(h / 1000, 1), F.lit(" kHz")))


def clock_text(seconds) -> Column:
    s = F.floor(_col(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def clip_offset_text(flags, offset_s) -> Column:
    partial = _col(flags).bitwiseAND(F.lit(int(MatchFlag.PARTIAL_CLIP))) != 0
    return F.when(partial & (_col(offset_s) > 0), F.concat(F.lit("@ "), clock_text(offset_s))).otherwise("")


def trim_to_seconds(seconds) -> Column:
    return F.floor(_col(seconds)).cast("double")


def join_parts(separator: str, *parts) -> Column:
    """Join the non-blank parts."""
    cleaned = [F.when(F.trim(_col(p)) != "", _col(p)) for p in parts]
    return F.concat_ws(separator, *cleaned)


def video_line() -> Column:
    frame = F.when((F.col("w") > 0) & (F.col("h") > 0), F.concat_ws("x", "w", "h"))
    fps = F.when(~F.col("is_image") & (F.col("fps") > 0),
                 F.concat(_optional_decimals(F.col("fps"), 3), F.lit(" fps")))
    clock = F.when(~F.col("is_image") & (F.col("duration_s") > 0), clock_text("duration_s"))
    return join_parts(" · ", "format", frame, fps, clock, bitrate_text("kbps"), "hdr")


def audio_line() -> Column:
    return join_parts(" · ", "audio_format", "audio_channel", sample_rate_text("audio_sample_rate"),
                      bitrate_text("audio_kbps"))


def details_text() -> Column:
    video, audio = video_line(), audio_line()
    return F.concat_ws(
        "\n", "path",
        F.when(video != "", F.concat(F.when(F.col("is_image"), "Image: ").otherwise("Video: "), video)),
        F.when(audio != "", F.concat(F.lit("Audio: "), audio)),
        F.concat(F.lit("File: "), bytes_text("size"), F.lit(" · "),
                 F.date_format("created", "yyyy-MM-dd HH:mm")))


def csv_escape(value) -> Column:
    v = F.coalesce(_col(value), F.lit(""))
    return F.when(v.rlike(r'[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def normalize_message(message) -> Column:
    """Collapse key of a log line: quoted spans become ``*``, digit runs ``#``; an open quote swallows the rest."""
    closed = F.regexp_replace(_col(message), r"""(['"])[\s\S]*?\1""", "$1*$1")
    dangling = F.regexp_replace(closed, r"""^((?:[^'"]|'\*'|"\*")*+)(['"])[\s\S]*$""", "$1$2")
    return F.regexp_replace(dangling, r"\p{Nd}+", "#")


def error_category(text) -> Column:
    t = F.lower(_col(text))
    hits = [F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(n)) for n in needles]), F.lit(cat))
            for cat, needles in ERROR_RULES]
    return F.coalesce(*hits, F.lit("unknown"))


def flag_names(flags) -> Column:
    """Comma-joined flag names as they appear in exports."""
    names = ((MatchFlag.FLIPPED, "Flipped"), (MatchFlag.PARTIAL_CLIP, "PartialClip"),
             (MatchFlag.AI_MATCHED, "AiMatched"), (MatchFlag.GRAYSCALE, "GrayscaleMatched"),
             (MatchFlag.PHASH, "PHashMatched"))
    parts = [F.when(_col(flags).cast("int").bitwiseAND(F.lit(int(f))) != 0, F.lit(n)) for f, n in names]
    return F.when(_col(flags) == 0, F.lit("None")).otherwise(F.concat_ws(", ", *parts))
