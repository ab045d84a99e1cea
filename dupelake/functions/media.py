"""Stream metadata columns: display streams, frame rates, HDR classes, quality ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .paths import _col

#: HDR class order (fixed values).
HDR_RANKS = (("Dolby Vision", 4), ("HDR10+", 3), ("HDR10", 2), ("HLG", 1))


def hdr_class(color_transfer, side_data) -> Column:
    t = F.lower(F.coalesce(_col(color_transfer), F.lit("")))
    s = F.upper(F.coalesce(_col(side_data), F.lit("")))
    pq = (F.when(F.contains(s, F.lit("DOVI")), "Dolby Vision")
          .when(F.contains(s, F.lit("SMPTE2094")), "HDR10+").otherwise("HDR10"))
    return F.when(t == "arib-std-b67", "HLG").when(t == "smpte2084", pq).otherwise("")


def hdr_rank(hdr) -> Column:
    out = F.lit(0)
    for name, rank in HDR_RANKS:
        out = F.when(_col(hdr) == name, F.lit(rank)).otherwise(out)
    return out


def fps_value(fraction) -> Column:
    """``num/den`` -> float; -1 when either side is not positive; 0 when it is no fraction."""
    parts = F.split(_col(fraction), "/")
    num, den = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    valid = (F.size(parts) == 2) & num.isNotNull() & den.isNotNull()
    ratio = (num.cast("float") / F.nullif(den.cast("float"), F.lit(0.0).cast("float"))).cast("float")
    return (F.when(valid & (num > 0) & (den > 0), ratio).when(valid, F.lit(-1.0).cast("float"))
            .otherwise(F.lit(0.0).cast("float")))


def display_width(width, sar_num, sar_den) -> Column:
    """Sample-aspect corrected width, halves to even; unusable ratios leave the coded width."""
    w, n, d = _col(width), _col(sar_num), _col(sar_den)
    shown = F.bround(w * n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), 0).cast("bigint")
    bad = (n <= 0) | (d <= 0) | (n == d)
    return F.when(bad | shown.isNull() | (shown <= 0) | (shown > 65536), w.cast("bigint")).otherwise(shown)


def pick_stream(streams, codec_type: str, key) -> Column:
    """Stream of a type with the largest key; the lowest index wins ties."""
    indexed = F.transform(_col(streams), lambda s, i: F.struct(key(s).alias("k"), (-i).alias("neg"), s.alias("s")))
    return F.array_max(F.filter(indexed, lambda x: F.lower(x["s"]["codec_type"]) == codec_type))["s"]


def display_streams(media: DataFrame) -> DataFrame:
    """Add the result-row metadata columns from the best video and audio stream of each file."""
    v = pick_stream("streams", "video", lambda s: (F.coalesce(s["w"], F.lit(0)) * F.coalesce(s["h"], F.lit(0))))
    a = pick_stream("streams", "audio", lambda s: F.coalesce(s["channels"], F.lit(0)))
    return (media.withColumn("_v", v).withColumn("_a", a)
            .withColumn("w", F.coalesce(F.col("_v.w"), F.lit(0)))
            .withColumn("h", F.coalesce(F.col("_v.h"), F.lit(0)))
            .withColumn("frame_size_int", F.col("w") + F.col("h"))
            .withColumn("format", F.col("_v.codec"))
            .withColumn("fps", F.coalesce(F.col("_v.fps"), F.lit(0.0).cast("float")))
            .withColumn("kbps", kbps(F.col("_v.bit_rate")))
            .withColumn("hdr", F.coalesce(F.col("_v.hdr"), F.lit("")))
            .withColumn("audio_format", F.col("_a.codec"))
            .withColumn("audio_channel", F.col("_a.channel_layout"))
            .withColumn("audio_sample_rate", F.coalesce(F.col("_a.sample_rate"), F.lit(0)))
            .withColumn("audio_kbps", kbps(F.col("_a.bit_rate")))
            .drop("_v", "_a"))


def kbps(bit_rate) -> Column:
    """Kilobits per second, halves to even."""
    return F.bround(F.coalesce(_col(bit_rate), F.lit(0)).cast("decimal(19,0)") / F.lit(1000), 0).cast("decimal(18,0)")


def bits_per_pixel(w="w", h="h", rate="kbps", fps="fps") -> Column:
    """Bits per pixel per frame; 0 when any part is unknown, so unknowns tie."""
    w, h, r, f = _col(w), _col(h), _col(rate).cast("double"), _col(fps).cast("double")
    known = (r > 0) & (f > 0) & (w > 0) & (h > 0)
    return F.when(known, r * 1000.0 / (w.cast("double") * h * f)).otherwise(F.lit(0.0))


def has_flag(flags, mask: int) -> Column:
    return _col(flags).cast("int").bitwiseAND(F.lit(int(mask))) != 0
