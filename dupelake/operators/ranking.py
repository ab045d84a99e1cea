"""Quality ranking inside duplicate groups. Items are the ``DUP_ITEMS`` columns of :mod:`dupelake.schema`."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import MatchFlag
from ..functions.media import bits_per_pixel, has_flag, hdr_rank
from ..plans.skew import (GroupPasses, attach_group, by_heat, descending, first_per_group, rank_all, rank_within,
                          running_total)

BEST_COLUMNS = {
    "best_duration": ("duration_s", "max"), "best_size": ("size", "min"), "best_fps": ("fps", "max"),
    "best_kbps": ("kbps", "max"), "best_audio_rate": ("audio_sample_rate", "max"),
    "best_audio_kbps": ("audio_kbps", "max"), "best_hdr": ("hdr_rank", "max"),
    "best_frame_size": ("frame_size_int", "max"),
}
_IMAGE_FLAGS = ("best_size", "best_frame_size")


def best_flags(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Mark every item that ties the best value of its group per metric; images get size and frame size only."""
    df = items if "hdr_rank" in items.columns else items.withColumn("hdr_rank", hdr_rank("hdr"))
    aggs = {f"__{n}": getattr(F, how)(c) for n, (c, how) in BEST_COLUMNS.items()}
    out = by_heat(df, group, lambda rows, passes: passes.add(rows, __video=F.bool_and(~F.col("is_image")), **aggs))
    for name, (col, _) in BEST_COLUMNS.items():
        hit = F.col(col) == F.col(f"__{name}")
        out = out.withColumn(name, F.coalesce(hit if name in _IMAGE_FLAGS else hit & F.col("__video"), F.lit(False)))
    return out.drop("__video", *aggs)


# --- keeper by criteria -------------------------------------------------------------------------------------------

def exact_tie(a: Column, b: Column) -> Column:
    return a == b


def duration_tie(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap <= 1) | (gap <= F.greatest(a, b) * 0.01)


def fps_tie(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.5


def rate_tie(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(a, b) * 0.05


@dataclass(frozen=True)
class Criterion:
    """One ranking step: higher wins unless ``ascending``; near ties pass the decision on."""

    name: str
    value: str  # SQL expression over an item
    video_only: bool = False
    ascending: bool = False
    tie: Callable[[Column, Column], Column] = exact_tie


CRITERIA = {c.name: c for c in (
    Criterion("Duration", "duration_s", True, tie=duration_tie),
    Criterion("Resolution", "frame_size_int"),
    Criterion("Bitrate", "cast(kbps as double)", True, tie=rate_tie),
    Criterion("FPS", "cast(fps as double)", True, tie=fps_tie),
    Criterion("Bits per pixel", "bits_per_pixel", True, tie=rate_tie),
    Criterion("Audio Bitrate", "cast(audio_kbps as double)", True, tie=rate_tie),
    Criterion("Size", "size", ascending=True),
)}
DIAGNOSTICS = Criterion("Quality diagnostics", "penalty", True, ascending=True)


def resolve_criteria(names: Sequence[str], best: bool = False, diagnostics: bool = False) -> list[Criterion]:
    """User order first, then the missing defaults; the BEST order leaves file size out."""
    wanted = [n for n in dict.fromkeys([*names, *CRITERIA]) if n in CRITERIA and not (best and n == "Size")]
    return ([DIAGNOSTICS] if diagnostics else []) + [CRITERIA[n] for n in wanted]


def _with_ratios(items: DataFrame) -> DataFrame:
    df = items
    if "bits_per_pixel" not in df.columns:
        df = df.withColumn("bits_per_pixel", bits_per_pixel() if {"w", "h"} <= set(df.columns) else F.lit(0.0))
    if "penalty" not in df.columns:
        df = df.withColumn("penalty", F.lit(0))
    return df


def pick_keeper(items: DataFrame, criteria: Sequence[Criterion], order: Sequence[str] = ("path",),
                group: str = "group_id") -> DataFrame:
    """Mark the keeper of every group (``is_keeper``) and the criterion that decided (``decided_by``, null on a tie).

    Criteria eliminate in turn: the best value stays together with its near ties, never compared among themselves,
    because near ties are not transitive.
    """
    return by_heat(_with_ratios(items), group, lambda df, passes: keeper_step(df, passes, criteria, order))


def keeper_step(df: DataFrame, passes: GroupPasses, criteria: Sequence[Criterion], order: Sequence[str] = ("path",)) -> DataFrame:
    """``is_keeper`` and ``decided_by`` of :func:`pick_keeper`: one group pass per criterion and one more.

    A pass takes what the last criterion left over together with the best value of the next one. In a window the
    place in ``order`` stands for the item, so that the passes carry a number and no path.
    """
    kept = df.columns
    if passes.hot:
        df = df.withColumn("__me", F.struct(*[F.col(o) for o in order], F.col("is_image").alias("__img")))
        image = lambda me: me["__img"]
    else:
        place = F.rank().over(Window.partitionBy(*passes.keys).orderBy(*order, "is_image"))
        kind = F.when(F.col("is_image"), 2).when(~F.col("is_image"), 1).otherwise(0)
        df = df.withColumn("__me", place * 3 + kind)
        image = lambda me: F.when(me % 3 > 0, me % 3 == 2)
    # __n candidates are alive and __keep is the first of them; __t and __k are the same after the criterion before
    state = {"__alive": F.lit(True), "__by": F.lit(None).cast("string")}
    aggs = {"__n": F.count("*"), "__keep": F.min("__me")}
    after = {"__t": F.count_if("__tied"), "__k": F.min("__pick")}
    folded = lambda name: {
        "__by": F.when(F.col("__on") & (F.col("__t") <= 1) & F.col("__by").isNull(), F.lit(name)).otherwise(F.col("__by")),
        "__keep": F.when(F.col("__on"), F.col("__k")).otherwise(F.col("__keep")),
        "__n": F.when(F.col("__on"), F.col("__t")).otherwise(F.col("__n"))}
    for k, c in enumerate(criteria):
        df = df.withColumns({**state, "__v": F.expr(c.value)})
        best = (F.min if c.ascending else F.max)(F.when(F.col("__alive"), F.col("__v")))
        df = passes.add(df, **aggs, __b=best)
        if k:
            df = df.withColumns(folded(criteria[k - 1].name)).drop("__t", "__k")
        df = df.withColumns({
            "__on": (F.col("__n") > 1) & ~(F.lit(c.video_only) & image(F.col("__keep"))),
            "__tied": F.col("__alive") & F.coalesce(c.tie(F.col("__v"), F.col("__b")), F.lit(False)),
            "__pick": F.when(F.col("__alive") & (F.col("__v") == F.col("__b")), F.col("__me"))}).drop("__v", "__b")
        state = {"__alive": F.when(F.col("__on"), F.col("__tied")).otherwise(F.col("__alive"))}
        aggs = after
    df = passes.add(df if criteria else df.withColumns(state), **aggs)
    if criteria:
        df = df.withColumns(folded(criteria[-1].name))
    return df.select(*kept, (F.col("__me") == F.col("__keep")).alias("is_keeper"), F.col("__by").alias("decided_by"))


# --- review-only test, dominance, recommendation ------------------------------------------------------------------

def _review_aggs() -> dict[str, Column]:
    known_fps = F.when(F.col("fps") > 0, F.col("fps"))
    any_flag = lambda f: F.bool_or(has_flag("flags", f))
    return {
        "r_n": F.count("*"), "r_partial": any_flag(MatchFlag.PARTIAL_CLIP), "r_ai": any_flag(MatchFlag.AI_MATCHED),
        "r_flip": any_flag(MatchFlag.FLIPPED), "r_image": F.bool_or("is_image"), "r_video": F.bool_or(~F.col("is_image")),
        "r_nodims": F.bool_or(F.col("frame_size_int") <= 0), "r_nodur": F.bool_or(F.col("duration_s") <= 0),
        "r_dmax": F.max("duration_s"), "r_dmin": F.min("duration_s"),
        "r_fmax": F.max(known_fps), "r_fmin": F.min(known_fps),
        "r_noq": F.bool_or((F.col("frame_size_int") <= 0) | (F.col("kbps") <= 0)),
        **{f"r_{how}_{c}": getattr(F, how)(_kind(c)) for c in _KINDS for how in ("min", "max")},
    }


_KINDS = {"format": "<unknown>", "hdr": "sdr", "audio_channel": "<none>", "audio_format": "<none>"}


def _kind(column: str) -> Column:
    """Trimmed, case-folded value; blank ones share a name."""
    v = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return F.when(v == "", F.lit(_KINDS[column])).otherwise(v)


def _review_verdict() -> tuple[Column, Column]:
    c = F.col
    mixed = {k: c(f"r_min_{k}") != c(f"r_max_{k}") for k in _KINDS}
    spread = c("r_dmax") - c("r_dmin") > F.greatest(F.lit(1.0), c("r_dmax") * 0.01)
    both = c("r_image") & c("r_video")
    image_bad = c("r_nodims") | mixed["format"]
    video_bad = (c("r_nodur") | spread | mixed["hdr"] | mixed["audio_channel"] | mixed["format"] | mixed["audio_format"]
                 | F.coalesce(c("r_fmax") - c("r_fmin") > 0.5, F.lit(False)))
    verdict = ((c("r_n") < 2) | c("r_partial") | c("r_ai") | c("r_flip") | both
               | F.when(c("r_image"), image_bad).otherwise(video_bad))
    reason = (F.when(c("r_partial"), "partial_clip").when(c("r_ai"), "ai_match").when(c("r_flip"), "flipped")
              .when(both, "mixed_types").when(c("r_image") & c("r_nodims"), "unknown_dimensions")
              .when(c("r_image") & mixed["format"], "image_formats").when(c("r_image"), "image_unproven")
              .when(c("r_nodur"), "unknown_duration").when(spread, "duration_spread").when(mixed["format"], "codecs")
              .when(mixed["hdr"], "hdr").when(mixed["audio_channel"], "channels").when(c("r_noq"), "missing_quality")
              .otherwise("trade_off"))
    return verdict, reason


def review_only(items: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Per group: is the identity of the resource too uncertain for an automatic choice? (review_only, uncertainty)"""
    verdict, reason = _review_verdict()
    g = items.groupBy(*keys).agg(*[v.alias(k) for k, v in _review_aggs().items()])
    return g.select(*keys, verdict.alias("review_only"), reason.alias("uncertainty"), F.col("r_n").alias("n"))


def judge(items: DataFrame, keys: Sequence[str] = ("group_id",), item: str = "path") -> DataFrame:
    """Add ``review_only``, ``uncertainty`` and ``winner`` (the decisive best, or null) to every row of its group.

    The decisive best is nowhere worse and strictly better than every other item. Being nowhere worse than all others
    is a comparison with the group's best values; two such items can never beat each other, so at most one remains,
    and only that one is compared with the members. Three group passes, no pairs.
    """
    kept = items.columns
    step = lambda df, passes: judge_step(df, passes, item).select(*kept, "review_only", "uncertainty", "winner")
    return by_heat(_with_ratios(items), list(keys), step)


def judge_step(df: DataFrame, passes: GroupPasses, item: str = "path") -> DataFrame:
    """The columns of :func:`judge` and the number of items of the group (``n``)."""
    kept = df.columns
    for name, value in _quality().items():
        df = df.withColumn(f"q_{name}", value)
    own, best = (lambda n: F.col(f"q_{n}")), (lambda n: F.col(f"m_{n}"))
    df = passes.add(df, **_quality_aggs(), **_review_aggs())
    verdict, reason = _review_verdict()
    df = df.withColumn("review_only", verdict).withColumn("uncertainty", reason)
    df = passes.add(df.withColumn("__cand", _comparable() & _nowhere_worse(own, best)), __cn=F.count_if("__cand"),
                    __c=F.max(F.when(F.col("__cand"), F.struct(F.col(item).alias("id"), *[F.col(f"q_{c}").alias(c) for c in _QUALITY]))))
    strict = _strictly_better(lambda n: F.col(f"__c.{n}"), own, best)
    df = passes.add(df.withColumn("__s", F.when(F.col(item) != F.col("__c.id"), strict)), __wins=F.bool_and("__s"))
    winner = F.when((F.col("__cn") == 1) & F.coalesce("__wins", F.lit(False)), F.col("__c.id"))
    return df.select(*kept, "review_only", "uncertainty", winner.alias("winner"), F.col("r_n").alias("n"))


#: What dominance compares; the last four must be known on all sides or on none.
_QUALITY = ("pen", "frame", "kbps", "bpp", "fps", "audio_kbps", "audio_sample_rate")


def _quality() -> dict[str, Column]:
    known = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("kbps", "fps", "audio_kbps", "audio_sample_rate")}
    return {"pen": F.col("penalty"), "frame": F.col("frame_size_int"), "bpp": F.col("bits_per_pixel"), **known}


def _quality_aggs() -> dict[str, Column]:
    return {"m_pen": F.min("q_pen"), **{f"m_{c}": F.max(f"q_{c}") for c in _QUALITY[1:]}, **{f"l_{c}": F.min(f"q_{c}") for c in _QUALITY[3:]}}


def _comparable() -> Column:
    """Can the members of a group be compared at all? Over the columns of ``_quality_aggs`` and ``_review_aggs``."""
    verdict, _ = _review_verdict()
    out = ~verdict & ~F.col("r_image") & ~F.col("r_noq")
    for c in ("fps", "audio_kbps", "audio_sample_rate"):
        out = out & ((F.col(f"m_{c}") <= 0) | (F.col(f"l_{c}") > 0))
    return out & ((F.col("m_fps") <= 0) | (F.col("l_bpp") > 0))


def _nowhere_worse(q, m) -> Column:
    near = lambda c: q(c) + m(c) * 0.05 >= m(c)
    return ((q("pen") <= m("pen")) & (q("frame") >= m("frame")) & near("kbps")
            & ((m("fps") <= 0) | ((q("fps") + 0.5 >= m("fps")) & near("bpp")))
            & ((m("audio_kbps") <= 0) | near("audio_kbps"))
            & ((m("audio_sample_rate") <= 0) | (q("audio_sample_rate") >= m("audio_sample_rate"))))


def _strictly_better(k, q, m) -> Column:
    more = lambda c: k(c) > q(c) + F.greatest(k(c), q(c)) * 0.05
    return ((k("pen") < q("pen")) | (k("frame") > q("frame")) | more("kbps")
            | ((m("fps") > 0) & ((k("fps") > q("fps") + 0.5) | more("bpp")))
            | ((m("audio_kbps") > 0) & more("audio_kbps"))
            | ((m("audio_sample_rate") > 0) & (k("audio_sample_rate") > q("audio_sample_rate"))))


def part_summaries(items: DataFrame, keys: Sequence[str], item: str = "path") -> DataFrame:
    """One row per part of a group: all that ``judge_parts`` needs to judge the union of two parts.

    ``members`` holds the quality values of the part's items, so parts must be of bounded size.
    """
    df = _with_ratios(items)
    for name, value in _quality().items():
        df = df.withColumn(f"q_{name}", value)
    aggs = {**_quality_aggs(), **_review_aggs(), "members": F.collect_list(
        F.struct(F.col(item).alias("id"), *[F.col(f"q_{c}").alias(c) for c in _QUALITY]))}
    return df.groupBy(*keys).agg(*[v.alias(n) for n, v in aggs.items()])


def judge_parts(pairs: DataFrame, a: str, b: str, keep: Sequence[Column]) -> DataFrame:
    """``review_only`` and ``winner`` of the union of the two aliased ``part_summaries`` in each row, as ``judge`` has them."""
    def union(name: str) -> Column:
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        if name == "r_n":
            return x + y
        low = name.startswith(("l_", "r_min_")) or name in ("m_pen", "r_dmin", "r_fmin")
        return F.least(x, y) if low else F.greatest(x, y)  # a flag of either part counts

    names = [*_quality_aggs(), *_review_aggs()]
    df = pairs.select(*keep, *[union(n).alias(n) for n in names], F.concat(f"{a}.members", f"{b}.members").alias("members"))
    kept = [c for c in df.columns if c not in names and c != "members"]
    verdict, _ = _review_verdict()
    best = lambda n: F.col(f"m_{n}")
    df = df.select(*kept, verdict.alias("review_only"), *[f"m_{c}" for c in _QUALITY], "members", F.when(_comparable(), F.filter(
        "members", lambda x: _nowhere_worse(lambda n: x[n], best))).alias("__c"))
    beats = F.transform(F.filter("members", lambda x: x["id"] != F.col("__k.id")), lambda x: _strictly_better(lambda n: F.col(f"__k.{n}"), lambda n: x[n], best))
    df = df.withColumn("__k", F.when(F.size("__c") == 1, F.get("__c", F.lit(0))))
    df = df.withColumn("__b", F.when(F.col("__k").isNotNull(), beats))
    wins = F.exists("__b", lambda x: x.isNotNull()) & ~F.exists("__b", lambda x: F.coalesce(~x, F.lit(False)))
    return df.select(*kept, "review_only", F.when(wins, F.col("__k.id")).alias("winner"))


def decisive_winner(items: DataFrame, keys: Sequence[str] = ("group_id",), item: str = "path") -> DataFrame:
    """The one item that is nowhere worse and strictly better than every other: (keys, winner)."""
    return judge(items, keys, item).where(F.col(item) == F.col("winner")).select(*keys, "winner")


#: (attribute, weight, both sides must be positive, relative tie, absolute tie) - fixed values.
WEIGHTS = (
    ("-penalty", 8.0, False, 0.0, 0.0), ("frame_size_int", 6.0, True, 0.0, 0.0), ("hdr_rank", 2.0, False, 0.0, 0.0),
    ("kbps", 4.0, True, 0.05, 0.0), ("fps", 1.5, True, 0.0, 0.5), ("bits_per_pixel", 2.5, True, 0.05, 0.0),
    ("audio_kbps", 1.0, True, 0.05, 0.0), ("audio_sample_rate", 0.75, True, 0.0, 0.0),
    ("greatest(size, 0)", 0.15, True, 0.03, 0.0),
)


#: Groups up to this size compare inside one row-local array; larger ones count over sorted values.
_ARRAY_GROUP = 64


def weighted_scores(items: DataFrame, group: str = "group_id", item: str = "path") -> DataFrame:
    """Sum of won minus lost weighted comparisons against every other group member: (group, item, score)."""
    df = _with_rank(items)
    wide = _wide_groups(df, group)
    if wide is None:
        return _scores_in_arrays(df, group, item)
    return _scores_in_arrays(df.join(wide, group, "left_anti"), group, item).unionByName(
        _scores_by_sorting(df.join(wide, group, "left_semi"), group, item))


def _with_rank(items: DataFrame) -> DataFrame:
    df = _with_ratios(items)
    return df if "hdr_rank" in df.columns else df.withColumn("hdr_rank", hdr_rank("hdr"))


def _wide_groups(df: DataFrame, group: str) -> DataFrame | None:
    wide = df.groupBy(group).count().where(F.col("count") > _ARRAY_GROUP).select(group)
    return wide if wide.limit(1).count() else None


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _pair_scores(values: pa.Array) -> pa.Array:
    """Scores of the members of each group, from the values of all members one after the other."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(WEIGHTS))  # null is not a number
    sizes = values.value_lengths().to_numpy(zero_copy_only=False) // len(WEIGHTS)
    owner, score = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(flat))
    for step in range(1, int(sizes.max()) if len(sizes) else 1):
        i = np.flatnonzero(owner[step:] == owner[:-step])
        for k, (_, weight, positive, rel, absolute) in enumerate(WEIGHTS):
            x, y = flat[i, k], flat[i + step, k]
            skip = np.abs(x - y) <= np.maximum(absolute, np.maximum(np.abs(x), np.abs(y)) * rel)
            if positive:
                skip |= (x <= 0) | (y <= 0)
            score[i] += np.where(skip, 0.0, np.where(x > y, weight, -weight))
            score[i + step] += np.where(skip, 0.0, np.where(y > x, weight, -weight))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(score))


def _packed_scores(df: DataFrame, group: str, item: Column, more: Sequence[Column] = ()) -> DataFrame:
    """(group, items, scores, more): one row per group with its items and their scores."""
    vals = F.array(*[F.expr(e).cast("double") for e, *_ in WEIGHTS])
    packed = df.groupBy(group).agg(F.collect_list(F.struct(item.alias("item"), vals.alias("v"))).alias("__m"), *more)
    each = lambda c: F.transform("__m", lambda x: x[c])
    return packed.withColumns({"items": each("item"), "scores": _pair_scores(F.flatten(each("v")))}).drop("__m")


def _scores_in_arrays(df: DataFrame, group: str, item: str) -> DataFrame:
    both = F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("scores").alias("score")))
    return _packed_scores(df, group, F.col(item)).select(group, both).withColumnRenamed("item", item)


def _scores_by_sorting(df: DataFrame, group: str, item: str) -> DataFrame:
    """Members beaten beyond the tie are those below ``v - tie``; members lost to are those whose own ``v - tie``
    lies above, so both counts come from running totals over sorted values instead of pairs."""
    points = []
    for k, (expr, weight, positive, rel, absolute) in enumerate(WEIGHTS):
        v = F.expr(expr).cast("double")
        tie = F.greatest(F.lit(absolute), F.abs(v) * rel)
        low = v - tie
        # the subtraction may have rounded down; then a value equal to ``low`` is still beyond the tie
        closed = (v - low) > tie
        valid = (v > 0) if positive else F.lit(True)
        row = lambda d, x, kind, cnt: F.struct(
            F.lit(2 * k + d).alias("axis"), x.alias("x"), kind.alias("kind"), F.lit(cnt).cast("bigint").alias("cnt"),
            F.lit(weight).alias("w"), valid.alias("valid"))
        # axis 2k counts values below the query, axis 2k+1 counts lowered values up to the query
        points += [row(0, v, F.lit(1), 1), row(0, low, F.when(closed, 2).otherwise(0), 0),
                   row(1, low, F.when(closed, 2).otherwise(0), 1), row(1, v, F.lit(1), 0)]
    long = (df.select(F.col(group), F.col(item), F.explode(F.array(*points)).alias("p"))
            .select(group, item, "p.*").where("valid").drop("valid"))
    run = running_total(long, [group, "axis"], [F.col("x"), F.col("kind"), F.col(item)], F.col("cnt"), "below")
    totals = long.where("cnt = 1").groupBy(group, "axis").agg(F.sum("cnt").alias("total"))
    q = run.where("cnt = 0").join(totals, [group, "axis"])
    part = F.when(F.col("axis") % 2 == 0, F.col("w") * F.col("below")).otherwise(
        -F.col("w") * (F.col("total") - F.col("below")))
    return q.groupBy(group, item).agg(F.sum(part).alias("score"))


def likely_winner(items: DataFrame, group: str = "group_id", order: Sequence[str] = ("path",)) -> DataFrame:
    """Weighted recommendation with its tie chain: (group, winner)."""
    return _weighted_choice(_with_rank(items), group, order)


def _weighted_choice(df: DataFrame, group: str, order: Sequence[str] = ("path",), more=None, carry: Sequence[str] = ()) -> DataFrame:
    """(group, winner, carry) of :func:`likely_winner`; ``more(df, passes)`` may add the columns to carry.

    The rows of groups of at most ``_ARRAY_GROUP`` items are dealt by group once.
    """
    ties = {"penalty": F.col("penalty"), "frame": descending("frame_size_int"), "hdr": descending("hdr_rank"), "kbps": descending("kbps"),
            "size": descending(F.greatest("size", F.lit(0))), **{f"o{k}": F.col(o) for k, o in enumerate(order)}, "path": F.col("path")}
    lost = lambda score: -F.round(F.coalesce(score, F.lit(0.0)), 9)
    more = more or (lambda rows, passes: rows)
    wide = _wide_groups(df, group)
    narrow = df if wide is None else df.join(wide, group, "left_anti")
    item = F.struct(*[c.alias(n) for n, c in ties.items()])
    packed = _packed_scores(more(narrow.repartition(group), GroupPasses(group, False)), group, item, [F.first(c).alias(c) for c in carry])
    first = F.array_min(F.zip_with("items", "scores", lambda x, s: F.struct(lost(s).alias("lost"), *[x[n].alias(n) for n in ties])))
    out = packed.select(group, first["path"].alias("winner"), *carry)
    if wide is None:
        return out
    large = df.join(wide, group, "left_semi")
    scored = by_heat(large, group, more).join(_scores_by_sorting(large, group, "path"), [group, "path"], "left")
    return out.unionByName(first_per_group(scored, group, [lost(F.col("score")), *ties.values()], ["path", *carry])
                           .withColumnRenamed("path", "winner"))


def best_of_group(items: DataFrame, criteria: Sequence[str] | None = None, group: str = "group_id",
                  diagnostics: bool = False) -> DataFrame:
    """(group, winner, decisive, uncertainty, n): the choice of :func:`recommend_best` and what speaks for it.

    Both ways of choosing and the decisive test work on rows that are dealt by group once.
    """
    df = _with_ratios(items).where(F.col(group).isNotNull())
    judged = ["decisive", "uncertainty", "n"]

    def judge_rows(rows: DataFrame, passes: GroupPasses) -> DataFrame:
        return judge_step(rows, passes).withColumnRenamed("winner", "decisive")

    if criteria is None:
        out = _weighted_choice(_with_rank(df), group, more=judge_rows, carry=judged)
        return out.withColumn("winner", F.coalesce("decisive", "winner"))
    steps = resolve_criteria(criteria, best=True, diagnostics=diagnostics)

    def choose(rows: DataFrame, passes: GroupPasses) -> DataFrame:
        marked = keeper_step(judge_rows(rows if passes.hot else rows.repartition(group), passes).withColumn("__lower", F.lower("path")),
                             passes, steps, ("__lower", "path"))
        return marked.where("is_keeper").select(group, F.col("path").alias("winner"), *judged)

    return by_heat(df, group, choose)


def recommend_best(items: DataFrame, criteria: Sequence[str] | None = None, group: str = "group_id",
                   diagnostics: bool = False) -> DataFrame:
    """(group, winner, confirmed, reason). With ``criteria`` the configured order decides and only a winner that is
    also the decisive one is confirmed; without, the decisive winner or else the weighted recommendation."""
    out = best_of_group(items, criteria, group, diagnostics)
    confirmed = (F.col("n") == 1) | F.coalesce(F.col("winner") == F.col("decisive"), F.lit(False))
    return out.select(group, "winner", confirmed.alias("confirmed"),
                      F.when(F.col("n") == 1, "only_copy").when(confirmed, "dominates").otherwise(
                          F.col("uncertainty")).alias("reason"))


def winner_strengths(items: DataFrame, winners: DataFrame, group: str = "group_id") -> DataFrame:
    """Reason codes of a winner: the metrics on which it leads and beats somebody (at most four).

    The columns of ``winners`` come out again, one row per group.
    """
    df = _with_rank(items)
    fields = {"diagnostics": ("-penalty", False, 0.0, 0.0), "resolution": ("frame_size_int", True, 0.0, 0.0),
              "dynamic_range": ("hdr_rank", False, 0.0, 0.0), "bitrate": ("kbps", True, 0.05, 0.0),
              "bits_per_pixel": ("bits_per_pixel", True, 0.05, 0.0), "frame_rate": ("fps", True, 0.0, 0.5),
              "audio_bitrate": ("audio_kbps", True, 0.05, 0.0)}
    told = [c for c in winners.columns if c != group]
    rows = winners.select(group, F.struct(*told).alias("__w")).join(df, group)
    mine = F.col("path") == F.col("__w.winner")
    own = lambda v: F.max(F.when(mine, v))
    size = F.greatest(F.col("size"), F.lit(0))
    aggs = [F.first("__w").alias("__w"), F.count_if(mine).alias("__mine"), own(size).alias("swin"), F.max(size).alias("smax"), F.min(size).alias("smin")]
    codes = []
    for k, (name, (expr, positive, rel, absolute)) in enumerate(fields.items()):
        v, lead = F.expr(expr).cast("double"), F.col(f"win{k}")
        aggs += [own(v).alias(f"win{k}"), F.max(v).alias(f"hi{k}"), F.min(F.when(v > 0, v) if positive else v).alias(f"lo{k}")]
        ahead = (lead == F.col(f"hi{k}")) & (lead > F.col(f"lo{k}") * (1 + rel) + absolute)
        codes.append(F.when(ahead & (lead > 0) if positive else ahead, F.lit(name)))
    out = rows.groupBy(group).agg(*aggs).where("__mine > 0")
    found = F.slice(F.array_compact(F.array(*codes)), 1, 4)
    weak = F.when((F.col("smax") > 0) & (F.col("swin") == F.col("smax")) & (F.col("smin") < F.col("smax")), "size").otherwise("tied")
    return out.select(group, *[F.col("__w")[c].alias(c) for c in told],
                      F.when(F.size(found) > 0, found).otherwise(F.array(weak)).alias("strengths"))


def relative_to_best(items: DataFrame, group: str = "group_id") -> DataFrame:
    """Each metric as a percentage of the best in the group."""
    cols = ("size", "duration_s", "kbps", "fps", "frame_size_int")
    out = attach_group(items, group, **{f"__{c}": F.max(c) for c in cols})
    for c in cols:
        best = F.col(f"__{c}").cast("double")
        out = out.withColumn(f"{c}_pct", F.when(best > 0, F.col(c).cast("double") / best * 100.0))
    return out.drop(*[f"__{c}" for c in cols])


# --- sorts --------------------------------------------------------------------------------------------------------

GROUP_SORTS = {
    "wasted": "sum(greatest(size, 0)) - max(greatest(size, 0))", "total": "sum(greatest(size, 0))",
    "largest": "max(size)", "count": "count(*)", "similarity": "max(similarity)", "date": "max(created)",
    "duration": "max(duration_s)", "resolution": "max(frame_size_int)", "path": "lower(min(path))",
    "checked": "cast(max(checked) as int)",
}
MEMBER_SORTS = {
    "wasted": "size", "total": "size", "largest": "size", "similarity": "similarity", "date": "created",
    "duration": "duration_s", "resolution": "frame_size_int", "path": "lower(path)", "size": "size",
    "bitrate": "kbps", "name": "lower(path)",
}


def sort_groups(items: DataFrame, mode: str, desc: bool = True, group: str = "group_id") -> DataFrame:
    """Groups in display order; ties keep the group key order."""
    g = items.groupBy(group).agg(F.expr(GROUP_SORTS[mode]).alias("sort_key"))
    key = F.col("sort_key")
    return g.orderBy(key.desc() if desc else key.asc(), F.col(group))


def rank_members(items: DataFrame, mode: str, desc: bool = True, order: Sequence[str] = ("path",),
                 group: str = "group_id", name: str = "member_rank") -> DataFrame:
    """Position of every item inside its group."""
    df = items.withColumn("__s", F.expr(MEMBER_SORTS[mode]))
    key = F.col("__s").desc() if desc else F.col("__s").asc()
    return rank_within(df, group, [key, *[F.col(o) for o in order]], name).drop("__s")


def display_ranks(items: DataFrame, winners: DataFrame, mode: str = "wasted", group: str = "group_id") -> DataFrame:
    """Group number in sort order, member position with the best item first, and the HDR upgrade mark."""
    df = items if "hdr_rank" in items.columns else items.withColumn("hdr_rank", hdr_rank("hdr"))
    keys = df.groupBy(group).agg(F.expr(GROUP_SORTS[mode]).alias("sort_key"), F.min("hdr_rank").alias("min_hdr"))
    numbered = rank_all(keys, [F.col("sort_key").desc(), F.col(group)], "group_number")
    j = (df.join(numbered.select(group, "group_number", "min_hdr"), group)
         .join(winners.select(group, F.col("winner").alias("__w")), group, "left")
         .withColumn("is_best", F.coalesce(F.col("path") == F.col("__w"), F.lit(False)))
         .withColumn("hdr_is_upgrade", F.col("hdr_rank") > F.col("min_hdr")))
    ranked = rank_within(j.withColumn("__s", F.expr(MEMBER_SORTS[mode])), group,
                         [F.col("is_best").desc(), F.col("__s").desc(), F.col("path")], "member_rank")
    return ranked.drop("__w", "__s", "min_hdr")


def sort_catalog(media: DataFrame, mode: str = "path", flag: int | None = None) -> DataFrame:
    """Catalog order with an optional flag-first rule and the path as tie break."""
    keys = {"size": F.col("size").desc(), "created": F.col("created").desc(), "duration": F.col("duration_s").desc(),
            "bitrate": F.col("bit_rate").desc() if "bit_rate" in media.columns else F.lit(0).asc(),
            "path": F.lower("path").asc()}
    first = [has_flag("flags", flag).desc()] if flag is not None else []
    return media.orderBy(*first, keys[mode], F.lower("path"), F.col("path"))


def top_per_group(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of every group (a report limit: reason examples, frames per file, dense slots)."""
    return rank_within(df, keys, order, "__rk").where(F.col("__rk") <= k).drop("__rk")


# --- cluster leader -----------------------------------------------------------------------------------------------

EQUALITY = {
    "full": ("size", "duration_s", "frame_size_int", "format", "audio_format", "audio_channel", "audio_sample_rate",
             "kbps", "fps"),
    "but_size": ("duration_s", "frame_size_int", "format", "audio_format", "audio_channel", "audio_sample_rate",
                 "kbps", "fps"),
    "same_group": (),
    "length": ("duration_s",),
}


def leading_cluster(items: DataFrame, equality: str, order: Sequence[str] = ("path",), group: str = "group_id") -> DataFrame:
    """Members of the first cluster of each group: the items equal to the earliest item that has an equal peer."""
    cols = list(EQUALITY[equality])
    classes = (items.groupBy(group, *cols).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__o"))
               .where("__n > 1"))
    lead = classes.groupBy(group).agg(F.min_by(F.struct("__o", *cols), "__o").alias("l")).select(
        F.col(group).alias("__g"), F.col("l.__o").alias("__lead"), *[F.col(f"l.{c}").alias(f"__l_{c}") for c in cols])
    cond = F.col(group) == F.col("__g")
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__l_{c}"))
    return (items.join(lead, cond).withColumn("is_leader", F.struct(*order) == F.col("__lead"))
            .drop("__g", "__lead", *[f"__l_{c}" for c in cols]))
