"""Path columns. Both separators are understood; comparisons are case-insensitive where noted."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Media extensions (fixed values).
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic", ".heif")
VIDEO_EXTENSIONS = (
    ".mp4", ".wmv", ".avi", ".mkv", ".flv", ".mov", ".mpg", ".mpeg", ".m4v", ".asf", ".f4v", ".webm", ".divx",
    ".m2t", ".m2ts", ".mts", ".vob", ".ts", ".rmvb", ".rm",
)
HEIF_EXTENSIONS = (".heic", ".heif")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")


def normalize_path(path) -> Column:
    """Forward slashes, outer blanks trimmed, trailing slashes dropped (a lone root is kept)."""
    trimmed = F.trim(F.coalesce(_col(path), F.lit("")))
    # most paths are normal already; the pattern's end also lies before a last line break
    odd = F.contains(trimmed, F.lit("\\")) | F.substring(trimmed, -1, 1).isin("/", *_LINE_ENDS)
    return F.when(odd, F.regexp_replace(F.translate(trimmed, "\\", "/"), "(?<=.)/+$", "")).otherwise(trimmed)


def file_name(path) -> Column:
    """Text after the last separator; the whole path when nothing follows it."""
    tail = F.regexp_extract(_col(path), r"([^/\\]+)$", 1)
    return F.when(tail == "", _col(path)).otherwise(tail)


def folder_of(path) -> Column:
    """Normalised text before the last separator; empty when there is no folder."""
    slashed = F.translate(_col(path), "\\", "/")
    cut = F.length(slashed) - F.length(F.substring_index(slashed, "/", -1)) - 1
    return F.when(cut > 0, normalize_path(F.substring(slashed, F.lit(1), cut))).otherwise("")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./\\]*)$", 1))


def file_stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent_folder(path) -> Column:
    """Folder above a normalised folder; empty at the top."""
    p = normalize_path(path)
    cut = F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1
    return F.when(cut > 0, F.substring(p, F.lit(1), cut)).otherwise("")


def path_segments(path) -> Column:
    return F.filter(F.split(normalize_path(path), "/"), lambda s: s != "")


def path_depth(path) -> Column:
    return F.size(path_segments(path))


def separator_depth(path) -> Column:
    """Folder depth counted in separators."""
    return F.length(_col(path)) - F.length(F.translate(_col(path), "/\\", ""))


def is_within(path, root, case_sensitive: bool = False) -> Column:
    """True when ``path`` equals ``root`` or lies below it on a segment boundary."""
    p, r = normalize_path(path), normalize_path(root)
    if not case_sensitive:
        p, r = F.lower(p), F.lower(r)
    return (p == r) | p.startswith(F.concat(r, F.lit("/")))


def is_volume_root(path) -> Column:
    p = _col(path)
    return (p == "/") | p.rlike(r"^[A-Za-z]:$")


def ancestors(folder) -> Column:
    """The folder itself and every folder above it, as an array of normalised paths."""
    p = normalize_path(folder)
    n = F.size(F.split(p, "/"))
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", p, F.lit("/"), i))
    return F.filter(prefixes, lambda x: x != "")


def last_segments(folder, k: int) -> Column:
    """Last ``k`` folder segments, lower-cased, as the folder-gate key."""
    seg = path_segments(folder)
    start = F.greatest(F.size(seg) - F.lit(k) + 1, F.lit(1))
    return F.lower(F.array_join(F.slice(seg, start, F.lit(k)), "/"))


def wildcard_regex(pattern: str, contains: bool = False) -> str:
    """Translate ``*``/``?`` to an anchored, case-insensitive regular expression."""
    if contains:
        pattern = (pattern if pattern.startswith("*") else "*" + pattern)
        pattern = pattern if pattern.endswith("*") else pattern + "*"
    body = "".join({"*": ".*", "?": "."}.get(ch) or re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", ch) for ch in pattern)
    return f"(?is)^{body}$"


def wildcard_match(value, pattern: str, contains: bool = False) -> Column:
    return _col(value).rlike(wildcard_regex(pattern, contains))


def path_hit(path, needle: str) -> Column:
    """Result-filter hit: plain text is a case-insensitive substring, wildcards match anywhere."""
    if "*" in needle or "?" in needle:
        return wildcard_match(path, needle, contains=True)
    return F.contains(F.lower(_col(path)), F.lit(needle.lower()))


def is_image_path(path) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_media_path(path) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)


def is_heif_path(path) -> Column:
    return extension(path).isin(*HEIF_EXTENSIONS)


def utf8_safe(path) -> Column:
    """Spark strings are UTF-8 bytes; malformed sequences (mangled emoji) are what fails here."""
    return F.coalesce(F.is_valid_utf8(_col(path)), F.lit(True))
