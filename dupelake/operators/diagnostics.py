"""Gate-by-gate explanation of given pairs: the columns of the pipeline without its early filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import ScanConfig
from ..functions.paths import is_media_path
from .candidates import folder_gate, folder_key, within_tolerance
from .eligibility import exclude_reason
from .scoring import score_pairs

GATES = ("extension", "inclusion", "type", "duration", "folder", "similarity", "hard_link")


def explain_pairs(pairs: DataFrame, media: DataFrame, snapshot: DataFrame, cfg: ScanConfig,
                  audio: DataFrame | None = None) -> DataFrame:
    """One row per pair (a, b) with a pass/fail column per gate, the verdict details and ``first_failed_gate``."""
    base = media.withColumn("__why", exclude_reason(cfg, "exists" if "exists" in media.columns else None)).withColumn(
        "__fk", folder_key("folder", cfg)).withColumn("__ext", is_media_path("path"))
    for c in ("dev", "inode"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("bigint"))
    keep = ["file_id", "path", "size", "is_image", "duration_s", "dev", "inode", "__why", "__fk", "__ext"]
    m = base.select(*keep)
    a = m.select(*[F.col(c).alias(f"a_{c}") for c in keep])
    b = m.select(*[F.col(c).alias(f"b_{c}") for c in keep])
    j = pairs.join(a, F.col("a") == F.col("a_file_id")).join(b, F.col("b") == F.col("b_file_id"))
    plain = score_pairs(pairs, snapshot, cfg, flip=False).select(
        "a", "b", "matched", F.col("diff").alias("difference"))
    j = j.join(plain, ["a", "b"], "left")
    if cfg.flip:
        both = score_pairs(pairs, snapshot, cfg, flip=True).select(
            "a", "b", F.col("matched").alias("m2"), F.col("flags").alias("flags2"), F.col("diff").alias("d2"))
        j = j.join(both, ["a", "b"], "left").withColumn("flip_used", F.col("flags2").bitwiseAND(F.lit(1).cast("smallint")) != 0)
        j = j.withColumn("matched", F.coalesce("m2", "matched")).withColumn("difference", F.coalesce("d2", "difference"))
    else:
        j = j.withColumn("flip_used", F.lit(False))
    if audio is not None:
        w = audio.select("file_id", F.size("words").alias("n"))
        j = (j.join(w.select(F.col("file_id").alias("a"), F.col("n").alias("a_words")), "a", "left")
             .join(w.select(F.col("file_id").alias("b"), F.col("n").alias("b_words")), "b", "left"))
    same_file = ((F.col("a_size") == F.col("b_size")) & (F.col("a_duration_s") == F.col("b_duration_s"))
                 & (F.col("a_dev") == F.col("b_dev")) & (F.col("a_inode") == F.col("b_inode")))
    gates = {
        "extension": F.col("a___ext") & F.col("b___ext"),
        "inclusion": F.col("a___why").isNull() & F.col("b___why").isNull(),
        "type": F.col("a_is_image") == F.col("b_is_image"),
        "duration": F.col("a_is_image") | F.coalesce(within_tolerance("a_duration_s", "b_duration_s", cfg), F.lit(False)),
        "folder": folder_gate("a___fk", "b___fk", cfg),
        "similarity": F.coalesce("matched", F.lit(False)),
        "hard_link": ~F.coalesce(same_file, F.lit(False)) if cfg.exclude_hard_links else F.lit(True),
    }
    first = F.coalesce(*[F.when(~c, F.lit(n)) for n, c in gates.items()])
    extra = ["a_words", "b_words"] if audio is not None else []
    return j.select(
        "a", "b", *[c.alias(f"{n}_ok") for n, c in gates.items()], F.col("a___why").alias("reason_a"),
        F.col("b___why").alias("reason_b"), F.abs(F.col("a_duration_s") - F.col("b_duration_s")).alias("duration_gap"),
        (F.lit(1.0) - F.col("difference")).alias("similarity"), "flip_used", *extra,
        first.alias("first_failed_gate"), first.isNull().alias("duplicate"))
