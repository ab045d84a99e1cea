"""Result exports (JSON, two CSV layouts, text) and readers for results and not-a-match sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..config import MatchFlag
from ..functions.formats import bytes_text, clip_offset_text, clock_text, csv_escape, fixed_text, flag_names
from ..functions.media import has_flag
from ..operators.relocate import hide_not_a_match
from ..plans.skew import cut_lineage, rank_all, rank_within

#: Items per JSON row; a group with more spreads over several rows that readers put back together.
GROUP_PART = 10_000


def results_json(items: DataFrame, group: str = "group_id") -> DataFrame:
    """One row per group part: (group_id, part, items ordered by similarity)."""
    ranked = rank_within(items, group, [F.col("similarity").desc(), F.col("path")], "__rk")
    cols = [c for c in items.columns if c != group]
    part = F.floor((F.col("__rk") - 1) / GROUP_PART).cast("int")
    return (ranked.groupBy(group, part.alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("__rk", F.struct(*cols).alias("item")))).alias("s"))
            .select(group, "part", F.transform("s", lambda x: x["item"]).alias("items")))


def _frame_size():
    return F.when((F.col("w") > 0) & (F.col("h") > 0), F.concat_ws("x", "w", "h")).otherwise("")


def results_csv(items: DataFrame, group: str = "group_id") -> DataFrame:
    """14 text columns in export order, sorted by group and similarity."""
    return items.orderBy(group, F.col("similarity").desc(), "path").select(
        F.col(group).alias("GroupId"), fixed_text("similarity", 1).alias("Similarity"), F.col("path").alias("Path"),
        F.col("size").alias("Size"), fixed_text("duration_s", 3).alias("Duration"), _frame_size().alias("FrameSize"),
        F.coalesce("format", F.lit("")).alias("Format"), fixed_text("fps", 2).alias("Fps"),
        F.col("kbps").cast("string").alias("BitRateKbs"), F.coalesce("audio_format", F.lit("")).alias("AudioFormat"),
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS").alias("DateCreated"),
        F.initcap(F.col("is_image").cast("string")).alias("IsImage"), flag_names("flags").alias("Flags"),
        fixed_text("clip_offset_s", 0).alias("PartialClipOffset"))


def results_csv_wide(items: DataFrame, checked: bool = True, group: str = "group_id") -> DataFrame:
    """The second CSV layout (13 columns with the mark, 12 without)."""
    cols = [F.col(group).alias("GroupId"), F.col("path").alias("Path"), bytes_text("size").alias("Size"),
            fixed_text("similarity", 1).alias("Similarity"), clock_text("duration_s").alias("Duration"),
            _frame_size().alias("FrameSize"), F.col("format").alias("Format"), fixed_text("fps", 2).alias("Fps"),
            F.col("kbps").cast("string").alias("BitRateKbs"), F.col("audio_format").alias("AudioFormat"),
            F.col("audio_sample_rate").alias("AudioSampleRate"),
            F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("DateCreated")]
    if checked:
        cols.append(F.initcap(F.col("checked").cast("string")).alias("Checked"))
    return items.orderBy(group, F.col("similarity").desc(), "path").select(*cols)


def results_text(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Report lines in order: (ord, sub, line). Items carry the best flags."""
    counts = cut_lineage(items.groupBy(group).agg(F.count("*").alias("n")))
    largest = counts.agg(F.max("n")).first()[0] or 0
    numbered = rank_all(counts, [F.col(group)], "no")
    head = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f"), F.count(group).alias("g")).select(
        F.lit(0).cast("bigint").alias("no"), F.lit(0).cast("bigint").alias("sub"),
        F.format_string("Found %d duplicate group(s), %d total file(s).\n", "g", "f").alias("line"))
    titles = numbered.select("no", F.lit(0).cast("bigint").alias("sub"),
                             F.format_string("Group %d (%d files):", "no", "n").alias("line"))
    ranked = rank_within(items, group, [F.col("similarity").desc(), F.col("path")], "__rk", largest).join(
        numbered.select(group, "no"), group)
    best = F.when(F.col("best_kbps") | F.col("best_frame_size"), " [best]").otherwise("")
    off = clip_offset_text("flags", "clip_offset_s")
    partial = F.when(off != "", F.concat(F.lit(" [partial clip "), off, F.lit("]"))).otherwise("")
    ai = F.when(has_flag("flags", MatchFlag.AI_MATCHED), " [AI]").otherwise("")
    size = F.when(_frame_size() == "", "?").otherwise(_frame_size())
    fmt = F.coalesce("format", F.lit("?"))
    first = F.concat(F.lit("  "), F.lpad(fixed_text("similarity", 1), 6, " "), F.lit("%  "), F.col("path"), best, partial, ai)
    video = F.concat_ws(", ", size, fmt, F.concat(fixed_text("fps", 2), F.lit(" fps")),
                        F.concat(F.col("kbps").cast("string"), F.lit(" kbps")), clock_text("duration_s"))
    second = F.concat(F.lit("         "), F.when(F.col("is_image"), F.concat_ws(", ", size, fmt)).otherwise(video))
    lines = ranked.select("no", F.col("__rk").cast("bigint").alias("sub"), F.concat(first, F.lit("\n"), second).alias("line"))
    tails = numbered.select("no", F.lit(2**62).cast("bigint").alias("sub"), F.lit("").alias("line"))
    return head.unionByName(titles).unionByName(lines).unionByName(tails)


def write_results(items: DataFrame, path: str, fmt: str = "json", group: str = "group_id") -> None:
    if fmt == "json":
        results_json(items, group).write.mode("overwrite").json(path)
    elif fmt == "csv":
        results_csv(items, group).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "csv_wide":
        results_csv_wide(items, True, group).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "text":
        results_text(items, group).orderBy("no", "sub").select("line").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_results(spark: SparkSession, path: str, not_a_match: DataFrame | None = None) -> DataFrame:
    """Flat items from saved results: group rows ({group_id, items}), bare arrays of groups, or an envelope with
    ``items``; null items are dropped and not-a-match groups hidden."""
    item = "struct<" + ",".join(f"{n}:{t}" for n, t in
                                (f.split(" ", 1) for f in S.DUP_ITEMS.split(", ") if not f.startswith("group_id"))) + ">"
    raw = spark.read.schema(f"group_id string, part int, items array<{item}>").option("multiLine", "false").json(path)
    flat = raw.select("group_id", F.explode("items").alias("i")).where("i is not null").select("group_id", "i.*")
    return hide_not_a_match(flat, not_a_match) if not_a_match is not None else flat


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Items of a whole-document file: a bare array of rows or an object with ``items``."""
    fields = S.DUP_ITEMS
    item = "struct<" + ",".join(f"{n}:{t}" for n, t in (f.split(" ", 1) for f in fields.split(", "))) + ">"
    text = spark.read.option("wholetext", True).text(path)
    v = F.trim("value")
    arr = F.when(v.startswith("["), F.from_json(v, f"array<{item}>")).otherwise(
        F.from_json(v, f"struct<items:array<{item}>>")["items"])
    return text.select(F.explode(arr).alias("i")).where("i is not null").select("i.*")


def read_not_a_match(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, path) from a bare list of sets or ``{version, groups}``."""
    text = spark.read.option("wholetext", True).text(path)
    v = F.trim("value")
    sets = F.when(v.startswith("["), F.from_json(v, "array<array<string>>")).otherwise(
        F.from_json(v, "struct<version:int,groups:array<array<string>>>")["groups"])
    return (text.select(F.posexplode(sets).alias("set_id", "paths"))
            .select(F.col("set_id").cast("bigint").alias("set_id"), F.explode("paths").alias("path")).distinct())


def write_not_a_match(sets: DataFrame, path: str) -> None:
    """One JSON row per set; sets are user-made lists of a few paths."""
    sets.groupBy("set_id").agg(F.sort_array(F.collect_set("path")).alias("paths")).write.mode("overwrite").json(path)


def csv_lines(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Pre-escaped CSV lines for sinks without a CSV writer."""
    c = results_csv(items, group)
    return c.select(F.concat_ws(",", *[csv_escape(F.col(x).cast("string")) for x in c.columns]).alias("line"))
