"""Clustering of matching pairs: components, representative-guarded merging, chain splitting, clip groups.

The merge rule is order dependent. The canonical order is: copy classes by their first path, then path. Only
components matter to each other, so every component is replayed on its own: small ones inside one task, large ones
as distributed rounds in which all entries that touch disjoint groups advance together (same result, no big task).
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import MatchFlag, ScanConfig
from ..functions.kernels import FeatureBlock, plain_verdict
from ..plans.skew import cut_lineage, rank_all, rank_within, store
from .scoring import collapse_copies, matching_pairs, score_pairs

_GROUP_SCHEMA = ("rep_id bigint, part int, parts int, group_id bigint, diff float, flags smallint, "
                 "diff_rest float, flags_rest smallint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node id as label, by contraction.

    Every node goes to the least of its neighbours and itself; chains of such steps end in one root, and the edges
    between roots, each kept once, are the next round's graph. Edges shrink from round to round, and the labels of
    all rounds are put together at the end.
    """
    live = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    live = cut_lineage(live)
    rounds = []
    while live.limit(1).count():
        ends = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        labels = cut_lineage(ends.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
        while True:  # a step leads to a smaller node, so doubling ends at the roots
            up = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
            nxt = cut_lineage(labels.join(up, "component").select("node", F.col("next").alias("component"), (F.col("next") != F.col("component")).alias("moved")))
            labels = nxt.select("node", "component")
            if not nxt.where("moved").limit(1).count():
                break
        rounds.append(labels)
        of = lambda c, n: labels.select(F.col("node").alias(c), F.col("component").alias(n))
        met = live.join(of("u", "x"), "u").join(of("v", "y"), "v").where("x <> y")
        live = cut_lineage(met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    if not rounds:
        kind = edges.select(F.least(a, b).alias("node"))
        return kind.select("node", F.col("node").alias("component")).limit(0)
    out = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("component"), F.col("component").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return cut_lineage(out) if len(rounds) > 1 else out


def _replay(cfg: ScanConfig, key, verts: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    verts = verts.sort_values(["path", "file_id"]).reset_index(drop=True)
    block = FeatureBlock(verts)
    n = len(verts)
    at = {int(v): i for i, v in enumerate(block.ids)}
    copies = verts["copies"].to_numpy(np.int64)
    ea = np.array([at[int(v)] for v in edges["a"]], dtype=np.int64)
    eb = np.array([at[int(v)] for v in edges["b"]], dtype=np.int64)
    diff, flags, plain = edges["diff"].to_numpy(np.float32), edges["flags"].to_numpy(np.int16), edges["plain"].to_numpy(bool)
    # a flipped-only match can take single copies off a class, one per lower single neighbour
    singles = np.zeros(n, np.int64)
    for x, y, p in zip(ea, eb, plain):
        if not p and copies[x] == 1:
            singles[y] += 1
    part_of, part_no, size = [], [], []
    for v in range(n):
        s = int(min(singles[v], copies[v] - 1)) if singles[v] else 0
        for k in range(s + 1):
            part_of.append(v)
            part_no.append(k)
            size.append(1 if k < s else int(copies[v]) - s)
    first = {}
    for p, v in enumerate(part_of):
        first.setdefault(v, p)
    spans = {v: range(first[v], first[v] + sum(1 for _ in range(part_of.count(v)))) for v in first} if singles.any() \
        else {v: range(first[v], first[v] + 1) for v in first}
    _, self_diff, self_flags = plain_verdict(block, block, np.arange(n), np.arange(n), cfg)

    turn: dict[int, list] = {}
    for e in range(len(ea)):
        turn.setdefault(int(ea[e]), []).append((int(eb[e]), float(diff[e]), int(flags[e])))
    group = [-1] * len(part_of)      # representative part, or -1
    item: list = [None] * len(part_of)
    members: dict[int, list[int]] = {}
    seen: dict[int, np.ndarray] = {}

    def like(rep: int) -> np.ndarray:
        v = part_of[rep]
        if v not in seen:
            seen[v] = plain_verdict(block, block, np.full(n, v), np.arange(n), cfg)[0]
        return seen[v]

    def join(p: int, rep: int, d: float, f: int):
        group[p] = rep
        members[rep].append(p)
        item[p] = (d, f, d, f)

    for p in range(len(part_of)):
        v = part_of[p]
        if group[p] < 0 and size[p] > 1:
            group[p] = p
            members[p] = [p]
            item[p] = (0.0, 0, float(self_diff[v]), int(self_flags[v]))
        todo = [(q, 0.0, int(self_flags[v])) for q in spans[v] if q > p]
        for w, d, f in sorted(turn.get(v, [])):
            todo += [(q, d, f) for q in spans[w]]
        for q, d, f in todo:
            g, h = group[p], group[q]
            if g >= 0 and h >= 0:
                if g != h and like(g)[part_of[h]]:
                    for m in members.pop(h):
                        group[m] = g
                        members[g].append(m)
            elif g >= 0:
                if like(g)[part_of[q]]:
                    join(q, g, d, f)
            elif h >= 0:
                if like(h)[v]:
                    join(p, h, d, f)
            else:
                group[p] = p
                members[p] = [p]
                item[p] = (d, 0, d, 0)
                join(q, p, d, f)
    rows = [(int(block.ids[part_of[p]]), part_no[p], len(spans[part_of[p]]), int(block.ids[part_of[group[p]]]), *item[p])
            for p in range(len(part_of)) if group[p] >= 0]
    cols = ["rep_id", "part", "parts", "group_id", "diff", "flags", "diff_rest", "flags_rest"]
    return pd.DataFrame(rows, columns=cols)


def _spread_to_members(parts: DataFrame, members: DataFrame, edges_flipped: bool) -> DataFrame:
    """Hand each class (or class part) verdict to its copies."""
    if edges_flipped:
        ranked = rank_within(members, "rep_id", [F.col("file_id") != F.col("rep_id"), F.col("path"), F.col("file_id")],
                             "rk")
        j = ranked.join(parts, "rep_id").where(F.col("part") == F.least(F.col("rk") - 1, F.col("parts") - 1))
        head = F.col("rk") - 1 == F.col("part")
    else:
        j = members.join(parts, "rep_id")
        head = F.col("file_id") == F.col("rep_id")
    return j.select("file_id", "path", "rep_id", "group_id",
                    F.when(head, F.col("diff")).otherwise(F.col("diff_rest")).alias("diff"),
                    F.when(head, F.col("flags")).otherwise(F.col("flags_rest")).alias("flags"))


def merge_pairs(reps: DataFrame, members: DataFrame, edges: DataFrame, cfg: ScanConfig, comps: DataFrame | None = None) -> DataFrame:
    """Representative-guarded union of matching pairs: (file_id, path, rep_id, group_id, diff, flags).

    ``group_id`` is the id of the group's representative file. Files whose joins were all blocked do not appear.
    """
    edges = cut_lineage(edges)
    comps = connected_components(edges) if comps is None else comps
    lone = reps.where(F.col("copies") > 1).join(comps, F.col("file_id") == F.col("node"), "left_anti")
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > cfg.replay_limit).select("component")
    placed = comps.join(big, "component", "left_anti")
    verts = reps.join(placed, F.col("file_id") == F.col("node")).drop("node")
    inner = edges.join(placed.select(F.col("node").alias("a"), F.col("component").alias("edge_component")), "a")
    parts = verts.groupBy("component").cogroup(inner.groupBy("edge_component")).applyInPandas(
        partial(_replay_group, cfg), _GROUP_SCHEMA)
    alone = lone.select(
        F.col("file_id").alias("rep_id"), F.lit(0).alias("part"), F.lit(1).alias("parts"),
        F.col("file_id").alias("group_id"), F.lit(0.0).cast("float").alias("diff"),
        F.lit(0).cast("smallint").alias("flags"), F.lit(0.0).cast("float").alias("diff_rest"),
        F.when(F.col("is_image"), int(MatchFlag.GRAYSCALE) if cfg.combine else 0).otherwise(
            int(MatchFlag.GRAYSCALE | MatchFlag.PHASH) if cfg.combine else 0).cast("smallint").alias("flags_rest"))
    if cfg.ignore_black or cfg.ignore_white:
        same = alone.select(F.col("rep_id").alias("a"), F.col("rep_id").alias("b"))
        ok = score_pairs(same, reps, cfg, flip=False).where("matched").select(F.col("a").alias("rep_id"))
        alone = alone.join(ok, "rep_id", "left_semi")
    parts = parts.unionByName(alone)
    if big.limit(1).count():
        wide = comps.join(big, "component", "left_semi")
        far = reps.join(wide, F.col("file_id") == F.col("node")).drop("node")
        for rows, rule in ((far.where("is_image"), _claim_rounds), (far.where("not is_image"), _merge_rounds)) if _ungated(cfg) else ((far, _merge_rounds),):
            if rows.limit(1).count():
                inside = rows.select(F.col("file_id").alias("a"))
                parts = parts.unionByName(rule(rows, edges.join(inside, "a", "left_semi"), cfg))
    return _spread_to_members(parts, members, cfg.flip)


def _replay_group(cfg, key, verts, edges):
    return _replay(cfg, key, verts, edges)


def _ungated(cfg: ScanConfig) -> bool:
    """Two similar images always make a pair: no folder, hard-link, pixel or embedding rule comes between."""
    return cfg.folder_mode == "none" and not (cfg.exclude_hard_links or cfg.ignore_black or cfg.ignore_white or cfg.use_ai)


def _class_parts(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """Copy classes as one vertex, or as few parts where flipped matches can take single copies off."""
    taken = edges.where(~F.col("plain")).join(
        reps.where("copies = 1").select(F.col("file_id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("file_id")).agg(
        F.count("*").alias("taken"))
    parts = (reps.select("file_id", "path", "copies").join(taken, "file_id", "left")
             .withColumn("last", F.least(F.coalesce("taken", F.lit(0)), F.col("copies") - 1).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last")))))
    return cut_lineage(parts.select(
        F.struct(F.col("file_id").alias("rep"), F.col("part")).alias("v"), F.struct("path", "file_id", "part").alias("ord"),
        F.when(F.col("part") < F.col("last"), 1).otherwise(F.col("copies") - F.col("last")).alias("copies"),
        (F.col("last") + 1).alias("parts")))


#: Pairs of large components up to which they are gone through in one pass per component; four bytes a pair are the most
#: that a pass keeps. More pairs settle in rounds.
SCAN_PAIRS = 50_000_000
_CLAIM_SCHEMA = "at bigint, grp bigint, diff float, flags smallint"


class _Claims:
    """The merge rule without gates over entries in order; only the pairs of representatives are kept."""

    def __init__(self, n: int):
        self.group, self.diff, self.flags = np.full(n, -1, np.int64), np.zeros(n, np.float32), np.zeros(n, np.int16)
        self.near: dict[int, np.ndarray] = {}   # later vertices that a representative resembles, in order

    def _put(self, at, group, diff, flags):
        self.group[at], self.diff[at], self.flags[at] = group, diff, flags

    def _is_near(self, rep: int, y: np.ndarray) -> np.ndarray:
        near = self.near[rep]
        return near[np.minimum(np.searchsorted(near, y), len(near) - 1)] == y if len(near) else np.zeros(len(y), bool)

    def turn(self, x: int, many: bool, y: np.ndarray, diff: np.ndarray, flags: np.ndarray, plain: np.ndarray) -> None:
        """The entry of ``x`` with its later partners ``y`` in order."""
        if self.group[x] < 0 and many:
            self._put(x, x, 0.0, 0)
            self.near[x] = y[plain].astype(np.int32)
        if self.group[x] < 0:
            held = self.group[y]
            takes = held < 0
            for rep in np.unique(held[~takes]).tolist():
                if self._is_near(rep, np.array([x]))[0]:
                    takes |= held == rep
            if not takes.any():
                return
            k = int(takes.argmax())
            if held[k] < 0:
                self._put(x, x, diff[k], 0)
                self.near[x] = y[plain].astype(np.int32)
                self._put(y[k], x, diff[k], flags[k])
            else:
                self._put(x, held[k], diff[k], flags[k])
            y, diff, flags, plain = y[k + 1:], diff[k + 1:], flags[k + 1:], plain[k + 1:]
        rep = int(self.group[x])
        free = self.group[y] < 0
        free &= plain if rep == x else self._is_near(rep, y)
        self._put(y[free], rep, diff[free], flags[free])


def _claim_scan(every: DataFrame, n: int) -> DataFrame:
    """Who claims whom, (at, grp, diff, flags): entries come sorted, a component in one task, turn after turn."""

    def run(batches):
        claims, held, component = _Claims(n), None, None
        cols = ["component", "x", "y", "many", "diff", "flags", "plain"]

        def turns(part):
            nonlocal component
            cuts = [0, *(np.flatnonzero(part[1][1:] != part[1][:-1]) + 1).tolist(), len(part[1])]
            for a, b in zip(cuts, cuts[1:]):
                if part[0][a] != component:
                    component, claims.near = part[0][a], {}
                claims.turn(int(part[1][a]), bool(part[3][a]), *(part[k][a:b] for k in (2, 4, 5, 6)))

        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
            part = part if held is None else [np.concatenate(h) for h in zip(held, part)]
            if not len(part[1]):
                continue
            last = int(np.searchsorted(part[1][::-1] != part[1][-1], True))  # the rows of the open turn
            turns([c[:-last] for c in part]) if last < len(part[1]) else None
            held = [c[-last:] for c in part]
        if held is not None:
            turns(held)
        at = np.flatnonzero(claims.group >= 0)
        for s in range(0, len(at), 65536):
            k = at[s:s + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k, claims.group[k], claims.diff[k], claims.flags[k])], ["at", "grp", "diff", "flags"])

    return every.repartition("component").sortWithinPartitions("component", "x", "y").mapInArrow(run, _CLAIM_SCHEMA)


def _claim_rounds(reps: DataFrame, edges: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The same rule for large components without gates, in few rounds.

    A representative claims every similar later vertex in its own turn, so two representatives are never similar and
    groups never merge: who is grouped stays where it is. A vertex is settled by its earliest open entry, so all
    vertices whose earliest entry is certain are settled at once, however large the group is that they go to.

    Up to ``SCAN_PAIRS`` pairs go entry by entry through one pass per component (``_claim_scan``), in time linear in the pairs.

    An edge is open between two unsettled vertices, as an offer (the first is grouped and its representative resembles
    the second) or as a choice (the second is grouped and its representative resembles the first); others are dropped.
    """
    nodes = store(rank_all(_class_parts(reps, edges), [F.col("ord")], "at"))
    place = nodes.select(F.col("v.rep").alias("rep"), "at", (F.col("copies") > 1).alias("many"))
    first = place.select(F.col("rep").alias("a"), F.col("at").alias("x"), "many")
    second = place.select(F.col("rep").alias("b"), F.col("at").alias("y"))
    self_flags = int(MatchFlag.GRAYSCALE | MatchFlag.PHASH) if cfg.combine else 0
    own = first.join(second.withColumnRenamed("b", "a"), "a").where("x < y").select(
        "x", "y", "many", F.lit(0.0).cast("float").alias("diff"), F.lit(self_flags).cast("smallint").alias("flags"), F.lit(True).alias("plain"))
    every = edges.join(first, "a").join(second, "b").select("x", "y", "many", "diff", "flags", "plain").unionByName(own)
    if edges.count() <= SCAN_PAIRS:
        last = nodes.agg(F.max("at")).first()[0]
        of = reps.select(F.col("file_id").alias("a"), "component").join(first, "a").select("x", "component")
        return _claimed(nodes, _claim_scan(every.join(of, "x"), last + 1), self_flags)
    every = store(every)
    none = F.lit(None).cast("bigint")
    live = every.select("x", "y", "many", "diff", "flags", none.alias("gx"), none.alias("gy"))
    settled, resembles = [], []
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    while live.limit(1).count():
        entry = store(live.where("gy is null").groupBy("y").agg(F.min_by(F.struct("x", "gx", "diff", "flags"), "x").alias("e")))
        claimed = entry.where("e.gx is not null").select(F.col("y").alias("at"), F.col("e.gx").alias("grp"), "e.diff", "e.flags")
        turn = live.where("gx is null").join(entry.select(F.col("y").alias("x")), "x", "left_anti").groupBy("x").agg(
            F.first("many").alias("many"), F.min_by(F.struct("y", "gy", "diff", "flags"), "y").alias("o"))
        turn = store(turn.join(entry.select(F.col("y").alias("w"), F.col("e.x").alias("by")), F.col("o.y") == F.col("w"), "left"))
        many = turn.where("many").select(F.col("x").alias("at"), F.col("x").alias("grp"), F.lit(0.0).cast("float").alias("diff"), F.lit(0).cast("smallint").alias("flags"))
        joined = turn.where("not many and o.gy is not null").select(F.col("x").alias("at"), F.col("o.gy").alias("grp"), "o.diff", "o.flags")
        opened = turn.where("not many and o.gy is null and by = x")
        news = store(union([
            claimed, many, joined, opened.select(F.col("x").alias("at"), F.col("x").alias("grp"), "o.diff", F.lit(0).cast("smallint").alias("flags")),
            opened.select(F.col("w").alias("at"), F.col("x").alias("grp"), "o.diff", "o.flags")]))
        settled.append(news)
        founders = news.where("at = grp").select(F.col("at").alias("x"))
        resembles.append(store(every.where("plain").join(founders, "x", "left_semi").select(F.col("x").alias("g"), F.col("y").alias("z"))))
        now = live.join(news.select(F.col("at").alias("x"), F.col("grp").alias("nx")), "x", "left").join(
            news.select(F.col("at").alias("y"), F.col("grp").alias("ny")), "y", "left")
        now = now.withColumn("fresh", F.col("nx").isNotNull() | F.col("ny").isNotNull()).withColumn("gx", F.coalesce("gx", "nx")).withColumn("gy", F.coalesce("gy", "ny"))
        now = store(now.where("gx is null or gy is null").drop("nx", "ny"))
        fresh = now.where("fresh").withColumn("g", F.coalesce("gx", "gy")).withColumn("z", F.when(F.col("gx").isNotNull(), F.col("y")).otherwise(F.col("x")))
        live = store(now.where("not fresh").drop("fresh").unionByName(fresh.join(union(resembles), ["g", "z"], "left_semi").select(*live.columns)))
    done = union(settled) if settled else nodes.selectExpr("at", "at as grp", "float(0) as diff", "smallint(0) as flags").limit(0)
    return _claimed(nodes, done, self_flags)


def _claimed(nodes: DataFrame, done: DataFrame, self_flags: int) -> DataFrame:
    """Verdicts of the class parts from who claims whom."""
    state = nodes.join(done, "at", "left").withColumn("grp", F.coalesce("grp", F.when(F.col("copies") > 1, F.col("at"))))
    head = nodes.select(F.col("at").alias("grp"), F.col("v.rep").alias("group_id"))
    zero, no = F.coalesce("diff", F.lit(0.0).cast("float")), F.coalesce("flags", F.lit(0).cast("smallint"))
    own_group = (zero == 0) & (no == 0) & (F.col("copies") > 1)
    return state.join(head, "grp").select(
        F.col("v.rep").alias("rep_id"), F.col("v.part").alias("part"), "parts", "group_id", zero.alias("diff"), no.alias("flags"), zero.alias("diff_rest"),
        F.when(own_group, F.lit(self_flags)).otherwise(no).cast("smallint").alias("flags_rest"))


def _merge_rounds(reps: DataFrame, edges: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The same rule for components too large for one task.

    A pending entry is ready when it is the earliest pending entry on every group its turn touches. Ready entries
    touch disjoint groups, so they commute and advance in one round. Edges inside a group are dropped for good.
    """
    parts = _class_parts(reps, edges)
    state = cut_lineage(parts.select(
        "v", "ord", F.lit(None).cast("struct<rep:bigint,part:int>").alias("grp"), F.lit(0.0).cast("float").alias("diff"),
        F.lit(0).cast("smallint").alias("flags"), "copies", "parts"))
    ends = parts.select("v", F.col("v.rep").alias("rep"), F.col("v.part").alias("part"))
    ea, eb = ends.select(F.col("v").alias("va"), F.col("rep").alias("a")), ends.select(F.col("v").alias("vb"), F.col("rep").alias("b"))
    self_flags = int(MatchFlag.GRAYSCALE | MatchFlag.PHASH) if cfg.combine else 0
    outer = edges.join(ea, "a").join(eb, "b").select(F.col("va").alias("a"), F.col("vb").alias("b"), "diff", "flags")
    x, y = ends.alias("x"), ends.alias("y")
    own_class = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.part") < F.col("y.part"))).select(
        F.col("x.v").alias("a"), F.col("y.v").alias("b"), F.lit(0.0).cast("float").alias("diff"),
        F.lit(self_flags).cast("smallint").alias("flags"))
    pending = cut_lineage(outer.unionByName(own_class))

    def similar(ask: DataFrame, left: str, right: str) -> DataFrame:
        """Un-flipped verdict of (left, right) part pairs, asked once per class pair."""
        classes = ask.select(F.col(f"{left}.rep").alias("a"), F.col(f"{right}.rep").alias("b")).distinct()
        yes = score_pairs(classes, reps, cfg, flip=False).where("matched").select(
            F.col("a").alias("__a"), F.col("b").alias("__b"))
        return ask.join(yes, (F.col(f"{left}.rep") == F.col("__a")) & (F.col(f"{right}.rep") == F.col("__b"))).drop("__a", "__b")

    while True:
        sa = state.select(F.col("v").alias("a"), F.col("ord").alias("oa"), F.col("grp").alias("ga"),
                          (F.col("copies") > 1).alias("many"))
        sb = state.select(F.col("v").alias("b"), F.col("ord").alias("ob"), F.col("grp").alias("gb"))
        live = pending.join(sa, "a").join(sb, "b").where(
            F.col("ga").isNull() | F.col("gb").isNull() | (F.col("ga") != F.col("gb")))
        live = cut_lineage(live)
        if not live.limit(1).count():
            break
        ta, tb = F.coalesce("ga", "a"), F.coalesce("gb", "b")
        touch = (live.select("a", "oa", ta.alias("t")).union(live.select("a", "oa", tb.alias("t"))).distinct())
        earliest = touch.groupBy("t").agg(F.min("oa").alias("m"))
        blocked = touch.join(earliest, "t").where(F.col("m") < F.col("oa")).select("a").distinct()
        ready = cut_lineage(live.join(blocked, "a", "left_anti"))
        # an ungrouped entry founds a group when it has copies, else takes the group of its first open edge
        founders = ready.where(F.col("ga").isNull() & F.col("many")).select(
            "a", F.col("a").alias("rep"), F.lit(True).alias("fresh"), F.col("oa").alias("from"),
            F.lit(0.0).cast("float").alias("d0"), F.lit(0).cast("smallint").alias("f0")).distinct()
        ask = ready.where(F.col("ga").isNull() & ~F.col("many") & F.col("gb").isNotNull()).select(
            F.col("gb").alias("a"), F.col("a").alias("b")).distinct()
        yes = similar(ask, "a", "b").select(F.col("a").alias("gb"), F.col("b").alias("a"), F.lit(True).alias("open"))
        free = ready.where(F.col("ga").isNull() & ~F.col("many")).join(yes, ["gb", "a"], "left")
        opening = (free.where(F.col("gb").isNull() | F.col("open")).groupBy("a")
                   .agg(F.min_by(F.struct("gb", "ob", "diff", "flags"), "ob").alias("f")))
        opened = opening.select("a", F.coalesce("f.gb", "a").alias("rep"), F.col("f.gb").isNull().alias("fresh"),
                                F.col("f.ob").alias("from"), F.col("f.diff").alias("d0"),
                                F.col("f.flags").alias("f0")).unionByName(founders)
        rest = (ready.join(opened, "a", "left")
                .withColumn("R", F.coalesce("ga", "rep"))
                .where(F.col("R").isNotNull() & (F.col("ga").isNotNull() | (F.col("ob") >= F.col("from")))))
        rest = cut_lineage(rest.withColumn("other", F.coalesce("gb", "b")).where(F.col("R") != F.col("other")))
        sure = F.coalesce(F.col("fresh") & (F.col("ob") == F.col("from")), F.lit(False))
        probe = similar(rest.where(~sure).select("R", "other").distinct(), "R", "other").withColumn("hit", F.lit(True))
        accepted = rest.join(probe, ["R", "other"], "left").where(sure | F.col("hit"))
        accepted = cut_lineage(accepted.select("a", "b", "ob", "gb", "R", "other", "diff", "flags", "ga", "oa"))
        joins = (accepted.where(F.col("gb").isNull()).groupBy(F.col("b").alias("v"))
                 .agg(F.min_by(F.struct("R", "diff", "flags"), "oa").alias("j")))
        merges = (accepted.where(F.col("gb").isNotNull()).groupBy(F.col("gb").alias("grp"))
                  .agg(F.min_by("R", "oa").alias("into")))
        entries = opened.select(F.col("a").alias("v"), F.col("rep").alias("e_rep"), F.col("d0"),
                                F.when(F.col("fresh"), F.lit(0).cast("smallint")).otherwise(F.col("f0")).alias("f0"))
        nxt = (state.join(joins, "v", "left").join(entries, "v", "left").join(merges, "grp", "left")
               .select("v", "ord", "copies", "parts",
                       F.coalesce("into", "grp", "e_rep", "j.R").alias("grp"),
                       F.when(F.col("grp").isNotNull(), F.col("diff")).otherwise(F.coalesce("d0", "j.diff", "diff")).alias("diff"),
                       F.when(F.col("grp").isNotNull(), F.col("flags")).otherwise(F.coalesce("f0", "j.flags", "flags")).alias("flags")))
        state = cut_lineage(nxt)
        done = ready.select("a").distinct()
        pending = cut_lineage(live.join(done, "a", "left_anti").select("a", "b", "diff", "flags"))
    state = state.withColumn("grp", F.coalesce("grp", F.when(F.col("copies") > 1, F.col("v"))))
    # the group kept its founder only if the founder was never joined to another one first
    own = (F.col("diff") == 0) & (F.col("flags") == 0) & (F.col("copies") > 1)
    return state.where(F.col("grp").isNotNull()).select(
        F.col("v.rep").alias("rep_id"), F.col("v.part").alias("part"), F.col("parts"), F.col("grp.rep").alias("group_id"),
        "diff", "flags", F.col("diff").alias("diff_rest"),
        F.when(own, F.lit(self_flags)).otherwise(F.col("flags")).cast("smallint").alias("flags_rest"))


def _prune(active: list[int], weight: np.ndarray, similar: np.ndarray) -> tuple[list[int], list[int]]:
    """Drop the first least-connected member while it matches fewer than half of the group.

    Members are copy classes with weights: once a class is the worst it stays the worst until all its copies are
    gone, so whole classes leave at once.
    """
    active, pruned = list(active), []
    while active:
        w = weight[active]
        total = int(w.sum())
        if total < 2:
            break
        links = similar[np.ix_(active, active)] @ w - 1
        k = int(np.argmin(links))
        if links[k] >= total // 2:
            break
        pruned.append(active.pop(k))
    return active, pruned


def _split(cfg: ScanConfig, key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["path", "file_id"]).reset_index(drop=True)
    n = len(pdf)
    weight = pdf["weight"].to_numpy(np.int64)
    ids = pdf["file_id"].to_numpy(np.int64)
    keep = np.full(n, -1, np.int64)
    if weight.sum() < 3:
        keep[:] = pdf["group_id"].to_numpy(np.int64)
    else:
        block = FeatureBlock(pdf)
        similar = np.zeros((n, n), bool)
        for i in range(n):
            j = np.arange(i, n)
            similar[i, j] = plain_verdict(block, block, np.full(n - i, i), j, cfg)[0]
        similar |= similar.T
        np.fill_diagonal(similar, True)
        active, pruned = _prune(list(range(n)), weight, similar)
        if not pruned:
            keep[:] = pdf["group_id"].to_numpy(np.int64)
        else:
            if weight[active].sum() >= 2:
                keep[active] = ids[active[0]]
            left = set(pruned)
            for seed in pruned:
                if seed not in left:
                    continue
                left.discard(seed)
                comp, queue = [], [seed]
                while queue:
                    cur = queue.pop(0)
                    comp.append(cur)
                    for other in pruned:
                        if other in left and similar[cur, other]:
                            left.discard(other)
                            queue.append(other)
                if weight[comp].sum() >= 2:
                    sub, _ = _prune(comp, weight, similar)
                    if weight[sub].sum() >= 2:
                        keep[sub] = ids[min(sub)]
    out = pd.DataFrame({"rep_id": ids, "old_group": pdf["group_id"], "group_id": keep})
    return out[out["group_id"] >= 0]


def split_daisy_chains(items: DataFrame, reps: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Break chains: members that match fewer than half of their group leave it and are re-clustered.

    ``items`` as returned by :func:`merge_pairs`. The group matrix uses un-flipped similarity.
    """
    classes = items.groupBy("group_id", "rep_id").agg(F.count("*").alias("weight"))
    counts = classes.groupBy("group_id").agg(F.count("*").alias("classes"), F.sum("weight").alias("n"))
    work = classes.join(counts, "group_id")
    small = work.where((F.col("classes") > 1) & (F.col("n") >= 3) & (F.col("classes") <= cfg.replay_limit))
    cols = ["file_id", "path", "is_image", "gray", "phash", "vec", "vec_ok"]
    loaded = small.join(reps.select(*cols), F.col("rep_id") == F.col("file_id")).select(*cols, "group_id", "weight")
    split = loaded.groupBy("group_id").applyInPandas(
        partial(_split_group, cfg), "rep_id bigint, old_group bigint, group_id bigint")
    same = work.where((F.col("classes") == 1) | (F.col("n") < 3)).select(
        "rep_id", F.col("group_id").alias("old_group"), "group_id")
    decided = same.unionByName(split)
    large = work.where((F.col("n") >= 3) & (F.col("classes") > cfg.replay_limit))
    if large.limit(1).count():
        decided = decided.unionByName(_split_large(large, reps, cfg))
    return (items.withColumnRenamed("group_id", "old_group").join(decided, ["rep_id", "old_group"])
            .drop("old_group"))


def _split_group(cfg, key, pdf):
    return _split(cfg, key, pdf)


def _blocked_links(nodes: DataFrame, reps: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Weighted similar-member counts per (grp, rep_id), block against block; pairs are never emitted."""
    sizes = nodes.groupBy("grp").agg(F.ceil(F.count("*") / cfg.block_rows).cast("int").alias("nb"))
    cols = ["file_id", "is_image", "gray", "phash", "vec", "vec_ok"]
    rows = (nodes.join(reps.select(*cols), F.col("rep_id") == F.col("file_id")).join(sizes, "grp")
            .withColumn("own", F.pmod(F.xxhash64("rep_id"), F.col("nb")).cast("int")))
    left = rows.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("lb", F.col("own"))
    right = rows.withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("rb", F.col("own"))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        block = FeatureBlock(pdf)
        li = np.flatnonzero((pdf["side"] == 0).to_numpy())
        ri = np.flatnonzero((pdf["side"] == 1).to_numpy())
        w = pdf["weight"].to_numpy(np.int64)
        links = [int((plain_verdict(block, block, np.full(len(ri), i), ri, cfg)[0] * w[ri]).sum()) for i in li]
        return pd.DataFrame({"grp": pdf["grp"].iat[0], "rep_id": block.ids[li], "links": links})

    part = both.groupBy("grp", "lb", "rb").applyInPandas(count, "grp bigint, rep_id bigint, links bigint")
    return part.groupBy("grp", "rep_id").agg((F.sum("links") - 1).alias("links"))


def _split_large(work: DataFrame, reps: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Chain splitting for groups too large for one task: exact counts by blocks, one removal per group and round."""
    order = reps.select(F.col("file_id").alias("rep_id"), F.struct("path", "file_id").alias("ord"))

    def shrink(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        state = cut_lineage(_blocked_links(nodes, reps, cfg).join(nodes, ["grp", "rep_id"]).join(order, "rep_id")
                            .withColumn("out", F.lit(None).cast("int")))
        step = 0
        while True:
            live = state.where("out is null")
            worst = live.groupBy("grp").agg(F.sum("weight").alias("n"), F.min(F.struct("links", "ord")).alias("w"))
            worst = worst.where((F.col("n") >= 2) & (F.col("w.links") < F.floor(F.col("n") / 2)))
            drop = cut_lineage(live.join(worst, "grp").where(F.col("ord") == F.col("w.ord")).select(
                "grp", F.col("rep_id").alias("gone"), F.col("weight").alias("gone_weight")))
            if not drop.limit(1).count():
                break
            near = score_pairs(drop.join(live, "grp").select(F.col("gone").alias("a"), F.col("rep_id").alias("b")),
                               reps, cfg, flip=False).where("matched").select(
                F.col("a").alias("gone"), F.col("b").alias("rep_id"), F.lit(1).alias("hit"))
            state = cut_lineage(
                state.join(drop, "grp", "left").join(near, ["gone", "rep_id"], "left")
                .withColumn("links", F.col("links") - F.coalesce(F.col("hit") * F.col("gone_weight"), F.lit(0)))
                .withColumn("out", F.when(F.col("gone") == F.col("rep_id"), F.lit(step)).otherwise(F.col("out")))
                .select("grp", "rep_id", "links", "weight", "ord", "out"))
            step += 1
        return state.where("out is null"), state.where("out is not null")

    def name(nodes: DataFrame) -> DataFrame:
        named = nodes.groupBy("grp").agg(F.sum("weight").alias("n"), F.min("ord").alias("o"))
        return nodes.join(named.where("n >= 2"), "grp").select(
            "rep_id", F.col("grp"), F.col("o.file_id").alias("group_id"))

    base = work.select(F.col("group_id").alias("grp"), "rep_id", "weight")
    kept, pruned = shrink(base)
    touched = pruned.select("grp").distinct()
    same = base.join(touched, "grp", "left_anti").select("rep_id", F.col("grp").alias("old_group"),
                                                         F.col("grp").alias("group_id"))
    core = name(kept.join(touched, "grp", "left_semi")).select("rep_id", F.col("grp").alias("old_group"), "group_id")
    result = same.unionByName(core)
    if pruned.limit(1).count():
        l, r = pruned.alias("l"), pruned.alias("r")
        ask = l.join(r, F.col("l.grp") == F.col("r.grp")).where(F.col("l.rep_id") < F.col("r.rep_id")).select(
            F.col("l.rep_id").alias("a"), F.col("r.rep_id").alias("b"))
        links = score_pairs(ask, reps, cfg, flip=False).where("matched").select("a", "b")
        comp = connected_components(links.unionByName(pruned.select(
            F.col("rep_id").alias("a"), F.col("rep_id").alias("b"))))
        nodes = (pruned.withColumnRenamed("grp", "old_group").join(comp, F.col("rep_id") == F.col("node"), "left")
                 .select(F.coalesce("component", "rep_id").alias("grp"), "rep_id", "weight", "old_group"))
        kept2, _ = shrink(nodes.select("grp", "rep_id", "weight"))
        sub = name(kept2).join(nodes.select("rep_id", "old_group"), "rep_id").select("rep_id", "old_group", "group_id")
        result = result.unionByName(sub)
    return result


def drop_singleton_groups(items: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups left with fewer than two items vanish."""
    alive = items.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return items.join(alive, key, "left_semi")


def assign_clips(matches: DataFrame, source_order: list, clip: str = "clip_id", source: str = "source_id") -> DataFrame:
    """Bind each clip to its first source in ``source_order``; one group per source, sources without clips vanish."""
    picked = matches.groupBy(clip).agg(F.min_by(F.struct(*matches.columns), F.struct(*source_order)).alias("m"))
    return picked.select("m.*").withColumn("group_id", F.col(source))


def emit_clips(assigned: DataFrame, flag: MatchFlag = MatchFlag.PARTIAL_CLIP) -> DataFrame:
    """Result rows: each source once with difference 0, each clip with 1-sim, its flag and offset."""
    sources = assigned.select(
        "group_id", F.col("source_id").alias("file_id"), F.lit(0.0).cast("float").alias("diff"),
        F.lit(0).cast("smallint").alias("flags"), F.lit(0.0).alias("clip_offset_s")).distinct()
    clips = assigned.select(
        "group_id", F.col("clip_id").alias("file_id"), (F.lit(1.0) - F.col("sim")).cast("float").alias("diff"),
        F.lit(int(flag)).cast("smallint").alias("flags"), F.col("offset_s").cast("double").alias("clip_offset_s"))
    return sources.unionByName(clips)


def merge_counters(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs found by both algorithms, gray only and hash only, and matched pairs kept apart by the merge guard."""
    g, p = int(MatchFlag.GRAYSCALE), int(MatchFlag.PHASH)
    fl = F.col("flags").cast("int")
    side = items.select("rep_id", "group_id").distinct()
    e = (edges.join(side.select(F.col("rep_id").alias("a"), F.col("group_id").alias("ga")), "a", "left")
         .join(side.select(F.col("rep_id").alias("b"), F.col("group_id").alias("gb")), "b", "left"))
    return e.agg(
        F.count_if(fl.bitwiseAND(F.lit(g | p)) == (g | p)).alias("both"),
        F.count_if(fl.bitwiseAND(F.lit(g | p)) == g).alias("gray_only"),
        F.count_if(fl.bitwiseAND(F.lit(g | p)) == p).alias("hash_only"),
        F.count_if(~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))).alias("kept_apart"))


def find_duplicates(snapshot: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Classic phase end to end: copies folded, pairs matched, merged, chains split.

    Returns (group_id, file_id, path, similarity percent, flags).
    """
    reps, members = collapse_copies(snapshot, cfg)
    reps = cut_lineage(reps)
    members = cut_lineage(members)
    return cluster(reps, members, matching_pairs(reps, cfg), cfg)


def cluster(reps: DataFrame, members: DataFrame, edges: DataFrame, cfg: ScanConfig, comps: DataFrame | None = None) -> DataFrame:
    """Groups of matched classes: (group_id, file_id, path, similarity percent, flags).

    Components do not touch each other, so whole components may be given alone; ``comps`` are those of ``edges``.
    """
    items = merge_pairs(reps, members, edges, cfg, comps)
    items = split_daisy_chains(cut_lineage(items), reps, cfg)
    return drop_singleton_groups(items).select(
        "group_id", "file_id", "path", ((F.lit(1.0) - F.col("diff")) * 100).cast("float").alias("similarity"), "flags")
