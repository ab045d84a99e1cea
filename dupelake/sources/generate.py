"""Seeded synthetic catalogs for tests and benchmarks, generated by executors from row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import FRAME_PIXELS


def _u(seed: int, salt: str, *cols) -> Column:
    """Uniform [0, 1) from row values."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.pmod(h, F.lit(1_000_003)) / 1_000_003.0


def generate_catalog(spark: SparkSession, n: int = 50_000, seed: int = 42, copy_share: float = 0.2) -> DataFrame:
    """Media rows with planted duplicate groups (copies share size, duration and content key)."""
    base = spark.range(n).withColumnRenamed("id", "base_id")
    copies = F.when(_u(seed, "dup", "base_id") < copy_share, 1 + F.floor(_u(seed, "k", "base_id") * 3)).otherwise(0)
    rows = base.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int"))))
    u = lambda salt: _u(seed, salt, "base_id")
    rng = lambda salt, lo, hi: (F.lit(lo) + F.floor(u(salt) * (hi - lo))).cast("int")
    fid = (F.col("base_id") * 8 + F.col("copy")).alias("file_id")
    folder = F.format_string("/library/%02d/%03d", F.pmod("base_id", F.lit(50)), F.pmod(F.xxhash64("base_id", "copy"), F.lit(200)))
    return rows.select(
        fid, F.concat(folder, F.format_string("/clip_%08d_%d.mp4", "base_id", "copy")).alias("path"), folder.alias("folder"),
        (F.lit(5) + u("size") * 245).cast("bigint").alias("__mb"), rng("w", 640, 3840).alias("w"), rng("h", 360, 2160).alias("h"),
        rng("fps", 24, 61).cast("float").alias("fps"), (F.lit(1_000_000) + u("br") * 19_000_000).cast("bigint").alias("bit_rate"),
        rng("d", 5, 3601).cast("double").alias("duration_s"), F.lit(False).alias("is_image"), F.lit(0).alias("flags"),
        F.timestamp_seconds(F.lit(1_600_000_000) + (u("t") * 90_000_000).cast("bigint")).alias("created"),
        F.sha2(F.col("base_id").cast("string"), 256).substr(1, 16).alias("content_key"),
    ).withColumn("size", F.col("__mb") * 1024 * 1024).withColumn("modified", F.col("created")).drop("__mb")


def generate_compare_corpus(spark: SparkSession, n: int, samples: int = 2, min_s: float = 30.0, max_s: float = 3600.0,
                            seed: int = 12345) -> tuple[DataFrame, DataFrame]:
    """(media, frames): about one base in six spawns two to four members with +-2 noise and under 1 % duration jitter,
    the others are random frames."""
    per = F.when(_u(seed, "fam", "base") < 1 / 6.0, 2 + F.floor(_u(seed, "size", "base") * 3)).otherwise(1)
    rows = spark.range(n).withColumnRenamed("id", "base").withColumn(
        "member", F.explode(F.sequence(F.lit(0), (per - 1).cast("int"))))
    media = rows.select(
        (F.col("base") * 8 + F.col("member")).alias("file_id"), "base", "member",
        F.format_string("/corpus/%03d/v_%07d_%d.mp4", F.pmod("base", F.lit(97)), "base", "member").alias("path"),
        F.format_string("/corpus/%03d", F.pmod("base", F.lit(97))).alias("folder"), F.lit(1_000_000).cast("bigint").alias("size"),
        F.lit(False).alias("is_image"),
        F.floor((F.lit(min_s) + _u(seed, "d", "base") * (max_s - min_s)) * (1 + (_u(seed, "j", "base", "member") - 0.5) * 0.018))
        .cast("double").alias("duration_s"))

    def pixels(batches):
        for pdf in batches:
            gray, pos, fid = [], [], []
            for f, b, m in zip(pdf["file_id"], pdf["base"], pdf["member"]):
                for p in range(samples):
                    x = np.random.default_rng([seed, int(b), p]).integers(0, 256, FRAME_PIXELS)
                    if m:
                        x = np.clip(x + np.random.default_rng([seed, int(b), p, int(m)]).integers(-2, 3, FRAME_PIXELS), 0, 255)
                    gray.append(x.astype(np.uint8).tobytes())
                    pos.append(p)
                    fid.append(f)
            yield pd.DataFrame({"file_id": fid, "pos": pos, "sec": [float(p) for p in pos], "gray": gray})

    frames = media.select("file_id", "base", "member").mapInPandas(pixels, "file_id bigint, pos int, sec double, gray binary")
    return media.drop("base", "member"), frames.withColumn("dark", F.lit(False))


def generate_ranked_items(spark: SparkSession, groups: int = 5_000, per_group: int = 4, seed: int = 999) -> DataFrame:
    """Result rows for the ranking benchmark."""
    r = spark.range(groups * per_group).withColumnRenamed("id", "n")
    u = lambda s, lo, hi: (F.lit(lo) + F.floor(_u(seed, s, "n") * (hi - lo)))
    return r.select(
        F.format_string("g%07d", F.floor(F.col("n") / per_group)).alias("group_id"), F.format_string("/r/%09d.mp4", "n").alias("path"),
        u("s", 1_000_000, 900_000_000).cast("bigint").alias("size"), u("d", 30, 3600).cast("double").alias("duration_s"),
        u("f", 24, 61).cast("float").alias("fps"), u("k", 500, 20000).cast("decimal(18,0)").alias("kbps"),
        u("ar", 22050, 48001).cast("int").alias("audio_sample_rate"), u("ak", 64, 321).cast("decimal(18,0)").alias("audio_kbps"),
        u("fs", 1000, 6000).cast("int").alias("frame_size_int"), F.lit("").alias("hdr"), F.lit(False).alias("is_image"))
