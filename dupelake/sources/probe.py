"""Probe JSON (one document per file) to typed stream metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.media import fps_value, hdr_class

PROBE_SCHEMA = (
    "struct<streams:array<struct<index:int,codec_name:string,codec_long_name:string,codec_type:string,pix_fmt:string,"
    "width:int,height:int,sample_rate:string,channel_layout:string,channels:int,bit_rate:string,r_frame_rate:string,"
    "color_transfer:string,side_data_list:array<struct<side_data_type:string>>>>,"
    "format:struct<duration:string,bit_rate:string>>"
)


def duration_seconds(text) -> Column:
    """Whole seconds from ``123.45`` or ``hh:mm:ss``."""
    t = F.col(text) if isinstance(text, str) else text
    plain = t.try_cast("double")
    p = F.split(t, ":")
    clock = (F.try_element_at(p, F.lit(1)).try_cast("double") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("double") * 60
             + F.try_element_at(p, F.lit(3)).try_cast("double"))
    return F.floor(F.when(plain >= 0, plain).otherwise(F.when(F.size(p) == 3, clock))).cast("double")


def parse_probe(rows: DataFrame, column: str = "probe_json") -> DataFrame:
    """Add ``duration_s`` and ``streams``; the container bit rate fills the first stream when no stream has one."""
    p = rows.withColumn("__p", F.from_json(column, PROBE_SCHEMA))
    any_rate = F.exists("__p.streams", lambda s: s["bit_rate"].try_cast("bigint").isNotNull())
    container = F.col("__p.format.bit_rate").try_cast("bigint")

    def stream(s: Column, i: Column) -> Column:
        own = F.coalesce(s["bit_rate"].try_cast("bigint"), F.lit(0).cast("bigint"))
        side = F.array_join(F.transform(F.coalesce(s["side_data_list"], F.array()), lambda d: d["side_data_type"]), ";")
        return F.struct(
            s["index"].cast("string").alias("index"), s["codec_name"].alias("codec"), s["codec_type"].alias("codec_type"),
            s["pix_fmt"].alias("pix_fmt"), F.coalesce(s["width"], F.lit(0)).alias("w"),
            F.coalesce(s["height"], F.lit(0)).alias("h"),
            F.coalesce(s["sample_rate"].try_cast("int"), F.lit(0)).alias("sample_rate"),
            s["channel_layout"].alias("channel_layout"),
            F.when(~F.coalesce(any_rate, F.lit(False)) & (i == 0) & container.isNotNull(), container).otherwise(own).alias("bit_rate"),
            F.coalesce(fps_value(s["r_frame_rate"]), F.lit(0.0).cast("float")).alias("fps"),
            F.coalesce(s["channels"], F.lit(0)).alias("channels"), hdr_class(s["color_transfer"], side).alias("hdr"))

    return (p.withColumn("duration_s", duration_seconds(F.col("__p.format.duration")))
            .withColumn("streams", F.transform("__p.streams", stream)).drop("__p"))
