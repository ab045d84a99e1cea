"""Functions for SQL text: frame kernels as Arrow functions, the rest as SQL bodies that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import kernels as K

#: Name in SQL -> Arrow function over luma or RGB frames.
FRAME_FUNCTIONS = {"frame_phash": K.phash, "frame_mirror": K.flip, "frame_is_dark": K.is_dark, "frame_is_dark_rgb": K.is_dark_rgb,
                   "frame_detail": K.frame_detail, "frames_mirrored_hashes": K.mirrored_hashes}

#: Name and parameters -> result type and body.
SQL_FUNCTIONS = {
    "hash_distance(a BIGINT, b BIGINT)": ("INT", "bit_count(a ^ b)"),
    "hash_similarity(a BIGINT, b BIGINT)": ("DOUBLE", "1 - bit_count(a ^ b) / 64.0D"),
    "quantize_unit(v ARRAY<DOUBLE>)": ("ARRAY<TINYINT>", "transform(v, x -> CAST(greatest(-127D, least(127D, rint(x * 127D))) AS TINYINT))"),
    "int8_similarity(a ARRAY<TINYINT>, b ARRAY<TINYINT>)": (
        "DOUBLE", "greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> CAST(x AS INT) * CAST(y AS INT)), 0, (s, x) -> s + x) / 16129.0D))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register all functions for this session; returns their names. Null arguments give null."""
    for name, fn in FRAME_FUNCTIONS.items():
        spark.udf.register(name, fn)
    for head, (result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    return sorted([*FRAME_FUNCTIONS, *(head.partition("(")[0] for head in SQL_FUNCTIONS)])
