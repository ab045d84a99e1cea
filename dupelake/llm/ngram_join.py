"""Similarity join of documents on the Jaccard index of their word n-gram sets, with prefix filtering.

Documents with the same set are one class, so copies are never paired. n-grams have one global order, rarest first by the number of
classes that hold them; ties go by hash. Counting needs no row per n-gram: tasks send the n-grams of their classes as packed bytes
to buckets of the hash range, and a bucket returns rows only for n-grams that two classes share. An n-gram of one class comes
before all shared ones, so its place in the order is known without it. n-grams that a bounded pilot finds in a hundredth of its
classes come last, in the pilot's order; they are not counted, so no bucket holds one of them once per class, and only a set whose
prefix reaches them names them. Two sets that reach the threshold share an n-gram of their prefixes, and the first shared one passes
three filters before a pair is made: length, position (what can still follow) and suffix (sums of count differences over cells of
n-grams bound the symmetric difference). Each remaining pair is verified once, on the whole sets.

A large group of near copies links most of its members with each other; its n-grams would emit all pairs. So in the first rounds a
class meets only one other (the least class of one of its prefix n-grams that has another label), the verified pairs give labels,
and only classes of different labels meet afterwards, at last all of them. No link that changes a component is lost. ``similar_pairs`` leaves this step out and returns every link between classes.

Defined cases: null and empty texts and texts of white space have an empty set and link with nothing; a text of fewer than n
words has its whole sequence as its one n-gram; rows with a null id take part and get the least known id of their component, or
null; repeated rows are copies; an empty table gives no rows; further columns are ignored.
n-grams and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import materialise, mix64, shingle_sets, slices, small_side, utf8_views, without, words
from .components import components

WORDS, PERCENT = 5, 80
#: Rounds in which every class meets one other; the last, exhaustive one comes after them.
MEETING_ROUNDS = 2
#: Documents of the pilot, and the share of its classes from which an n-gram counts as frequent (at least ``FREQUENT_LEAST`` of them).
PILOT, FREQUENT_SHARE, FREQUENT_LEAST = 4000, 100, 8
#: About so many n-grams go to a bucket; a bucket is told by the lower 24 bits of a hash, an n-gram in it by the upper 40.
BUCKET_GRAMS = 3_000_000
_LOW = 24

#: Counts of n-grams in 64 cells of the hash range, eight to a long.
CELLS = tuple(f"c{i}" for i in range(8))

_SETS = StructType([*(StructField(c, LongType()) for c in ("doc_id", "node")), StructField("n", IntegerType()), StructField("n_late", IntegerType()),
                    *(StructField(c, LongType()) for c in CELLS)])
_PACKED = "bucket int, payload binary"
_SHARED = "node long, gram long, late boolean, w long"
_WHOLE = StructType([StructField("node", LongType()), StructField("grams", ArrayType(LongType()))])


def _sets(batch_ids, texts, k: int):
    """Per slice: (doc ids, counts, owner of each n-gram, n-grams, set hash)."""
    data, offs = utf8_views(texts)
    for a, b in slices(offs):
        own = offs[a:b + 1] - offs[a]
        rows, word = words(data[offs[a]:offs[b]], own)
        owner, gram = shingle_sets(rows, word, b - a, k)
        n = np.bincount(owner, minlength=b - a)
        key = np.zeros(b - a, np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            first = np.concatenate(([0], np.cumsum(n)))[:-1][some]
            key[some] = mix64(np.add.reduceat(mix64(gram), first) + n[some].astype(np.uint64))
        yield batch_ids.slice(a, b - a), n, owner, gram, key.view(np.int64)


def frequent_grams(docs: DataFrame, k: int = WORDS) -> np.ndarray:
    """n-grams of at least a hundredth of the pilot's classes, rarest first; the pilot is one small task."""

    def run(batches):
        seen: set[int] = set()
        held = []
        for batch in batches:
            for _, n, owner, gram, key in _sets(batch.column(0), batch.column(1), k):
                held.append(gram[_fresh(seen, n, key)[owner]])
        gram, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        often = count * FREQUENT_SHARE >= max(len(seen), FREQUENT_SHARE * FREQUENT_LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["gram", "n"])

    pilot = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").orderBy(F.xxhash64("text"), "text").limit(PILOT).coalesce(1)
    rows = pilot.mapInArrow(run, "gram long, n long").collect()  # at most the pilot's n-grams / FREQUENT_LEAST
    return np.array([r.gram for r in sorted(rows, key=lambda r: (r.n, r.gram))], np.int64).view(np.uint64)


def _fresh(seen: set[int], n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rows that are the first of their class in a task; ``seen`` takes the classes up."""
    new = np.zeros(len(n), bool)
    for i in np.flatnonzero(n):
        if key[i] not in seen:
            seen.add(int(key[i]))
            new[i] = True
    return new


def _is_late(gram: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which n-grams are among the sorted frequent ones."""
    if not len(ordered):
        return np.zeros(len(gram), bool)
    at = np.searchsorted(ordered, gram)
    at[at == len(ordered)] = 0
    return ordered[at] == gram


def document_sets(docs: DataFrame, k: int = WORDS, frequent: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """doc_id, node (class; null for an empty set), n, n_late (frequent n-grams) and the cell counts of every document."""
    ordered = np.sort(frequent)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, n, owner, gram, key in _sets(batch.column(0), batch.column(1), k):
                late = np.bincount(owner[_is_late(gram, ordered)], minlength=len(n))
                cells = np.bincount(owner * 64 + (gram >> np.uint64(58)).astype(np.int64), minlength=64 * len(n)).astype(np.uint8).reshape(-1, 8, 8)
                packed = np.ascontiguousarray(cells).view("<i8")[:, :, 0]
                yield pa.RecordBatch.from_arrays([
                    ids.cast(pa.int64()), pa.array(key, mask=n == 0), pa.array(n.astype(np.int32)), pa.array(late.astype(np.int32)),
                    *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(8))], names=_SETS.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SETS)


def _pack(nodes: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> bytes:
    """Classes with the number of their keys, and the keys in five bytes each."""
    return b"".join([len(nodes).to_bytes(4, "little"), nodes.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
                     np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()])


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(class, key) of every key of a payload."""
    n = int.from_bytes(payload[:4], "little")
    nodes, lengths = np.frombuffer(payload, "<i8", n, 4), np.frombuffer(payload, "<u4", n, 4 + 8 * n)
    five = np.frombuffer(payload, np.uint8, offset=4 + 12 * n).reshape(-1, 5)
    keys = np.zeros((len(five), 8), np.uint8)
    keys[:, :5] = five
    return np.repeat(nodes, lengths), keys.view("<u8")[:, 0]


def _packed_grams(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """The n-grams of all classes, packed by bucket; a task gives each class once. Frequent n-grams go, by their place in the order
    and to buckets of classes below zero, only where a prefix reaches them."""
    by_value = np.argsort(frequent)
    ordered = frequent[by_value]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, n, owner, gram, key in _sets(batch.column(0), batch.column(1), k):
                new = _fresh(seen, n, key)
                keep = new[owner]
                owner, gram = owner[keep], gram[keep]
                late = _is_late(gram, ordered)
                plain = np.bincount(owner[~late], minlength=len(n))
                reached = (plain <= n - (n * percent + 99) // 100)[owner] & late
                place = by_value[np.searchsorted(ordered, gram[reached])] if reached.any() else np.zeros(0, np.int64)
                where = np.concatenate(((gram[~late] & np.uint64((1 << _LOW) - 1)).astype(np.int64) % buckets,
                                        -1 - (key[owner[reached]] & 0xFFFFFF) % buckets))
                whose = np.concatenate((owner[~late], owner[reached]))
                keys = np.concatenate((gram[~late] >> np.uint64(_LOW), place.astype(np.uint64)))
                order = np.lexsort((whose, where))
                where, whose, keys = where[order], whose[order], keys[order]
                cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)] if len(where) else [0]
                packed = []
                for a, b in zip(cuts, cuts[1:]):
                    rows, lengths = np.unique(whose[a:b], return_counts=True)
                    packed.append(_pack(key[rows], lengths, keys[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "payload"])

    return docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(run, _PACKED)


def _shared_grams(packed: DataFrame, buckets: int) -> DataFrame:
    """node, gram, late, w of n-grams that two classes have (w: how many rows had it) and of the frequent ones (w: their place)."""

    def run(key, table):
        bucket = key[0].as_py()
        parts = [_unpack(p.as_py()) for p in table.column("payload")]
        node, gram = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        if bucket < 0:
            out = node, -1 - gram.astype(np.int64), np.ones(len(node), bool), gram.astype(np.int64)
        else:
            order = np.argsort(gram, kind="stable")
            node, gram = node[order], gram[order]
            first = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1))
            count = np.diff(np.append(first, len(gram)))
            several = np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)
            keep = np.repeat(several, count)
            out = node[keep], gram[keep].astype(np.int64) * buckets + bucket, np.zeros(int(keep.sum()), bool), np.repeat(count, count)[keep]
        return pa.table({n: pa.array(c) for n, c in zip(("node", "gram", "late", "w"), out)})

    return packed.groupBy("bucket").applyInArrow(run, _SHARED)


def _whole_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, n, _, gram, key in _sets(batch.column(0), batch.column(1), k):
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key), lists], names=_WHOLE.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _WHOLE)


def _prefixes(docs: DataFrame, sets: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """gram, node, pos, n and cells: the prefix n-grams that several classes have, with their place in the set's order."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = min((1 << 22), 1 + total // BUCKET_GRAMS)
    shared = _shared_grams(_packed_grams(docs, k, percent, frequent, buckets), buckets)
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("late", "w", "gram"))).alias("own"))
    classes = sets.where("n > 0").groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", "n_late", *CELLS)])
    # before the shared n-grams stand those of one class, after them the frequent ones
    ahead = F.col("n") - F.col("n_late") - F.size(F.filter("own", lambda x: ~x["late"]))
    last = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    rows = listed.join(classes, "node").withColumn("ahead", ahead.cast("int"))
    inside = F.slice("own", F.lit(1), F.greatest(F.lit(0), last - F.col("ahead") + 1).cast("int"))
    return (rows.select("node", "n", "ahead", *CELLS, F.posexplode(inside).alias("i", "g"))
            .select("g.gram", "node", (F.col("ahead") + F.col("i")).alias("pos"), "n", *CELLS))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filter on the rows ``x`` and ``y`` of one shared prefix n-gram."""
    c = lambda s, name: F.col(f"{s}.{name}")
    n, m = c(x, "n"), c(y, "n")
    need = F.expr(f"(({x}.n + {y}.n) * {percent} + {100 + percent - 1}) div {100 + percent}")
    length = (n * 100 >= m * percent) & (m * 100 >= n * percent)
    position = F.least(n - c(x, "pos"), m - c(y, "pos")) >= need
    diff = F.lit(0)
    for word in CELLS:
        for i in range(8):
            byte = lambda s: F.shiftrightunsigned(c(s, word), 8 * i).bitwiseAND(255)  # noqa: B023, E731
            d = F.abs(byte(x) - byte(y))
            diff = diff + F.least(d, 256 - d)
    return length & position & (diff <= n + m - 2 * need)


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs a, b (nodes) that reach the threshold, with their common and joint counts."""
    pairs = materialise(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = sets.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    named = docs.select("doc_id", "text").join(small_side(materialise(ids.where("doc_id is not null").select("doc_id").distinct())), "doc_id", "left_semi")
    unnamed = docs.select("doc_id", "text").where("doc_id is null")
    whole = _whole_sets(named.unionByName(unnamed), k).join(nodes, "node").groupBy("node").agg(F.min("grams").alias("grams"))
    left = pairs.join(whole.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(whole.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb")).cast("long")
    out = both.select("a", "b", common.alias("common"), (F.size("ga") + F.size("gb") - common).alias("joint"))
    return out.where(F.col("common") * 100 >= F.col("joint") * percent)


def _joined(prefixes: DataFrame, percent: int, apart: bool) -> DataFrame:
    """Candidate pairs of rows that share a prefix n-gram; the shorter set needs it in its shorter index prefix."""
    x = prefixes.where(F.col("pos") <= F.col("n") - F.expr(f"(2 * n * {percent} + {100 + percent - 1}) div {100 + percent}")).alias("x")
    y = prefixes.alias("y")
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    cond = (F.col("x.gram") == F.col("y.gram")) & order & _may_link("x", "y", percent)
    if apart:
        cond = cond & (F.col("x.label") != F.col("y.label"))
    return x.join(y, cond).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def similar_pairs(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every link between two different sets: a, b (nodes of ``document_sets``), common, joint."""
    frequent = frequent_grams(docs, k)
    sets = materialise(document_sets(docs, k, frequent))
    return _verified(docs, sets, _joined(_prefixes(docs, sets, k, percent, frequent), percent, False), k, percent)


def _open_rows(prefixes: DataFrame, label: DataFrame | None) -> DataFrame:
    """Prefix rows with ``label``, of the n-grams that two labels share."""
    marked = prefixes.withColumn("label", F.col("node")) if label is None else (
        prefixes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    apart = marked.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    return marked.join(apart, "gram")


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after more links: only pairs of labels, each once, go through the search for components."""
    if label is None:
        return materialise(components(links))
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = materialise(components(pairs.where("a <> b").distinct()))
    moved = label.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialise(moved.unionByName(merged.join(label.select("node"), "node", "left_anti")))


def join_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, node, component_id (least doc_id that links reach) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = frequent_grams(docs, k)
    sets = materialise(document_sets(docs, k, frequent))
    prefixes = materialise(_prefixes(docs, sets, k, percent, frequent))
    label = None
    for _ in range(MEETING_ROUNDS):  # one partner a class and round: most of a group of near copies comes together
        marked = _open_rows(prefixes, label)
        hub = marked.groupBy("gram").agg(F.min(F.struct("node", "label", "pos", "n", *CELLS)).alias("h")).select("gram", "h.*")
        meet = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y", percent)
        met = marked.alias("x").join(hub.alias("y"), meet).groupBy(F.col("x.node").alias("a")).agg(F.min("y.node").alias("b"))
        links = materialise(_verified(docs, sets, met, k, percent).select("a", "b"))
        if links.isEmpty():
            break
        label = _relabelled(label, links)
    rest = materialise(_open_rows(prefixes, label))
    label = _relabelled(label, materialise(_verified(docs, sets, _joined(rest, percent, True), k, percent).select("a", "b")))
    placed = sets.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = placed.where("label is not null").join(least, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node", "component_id")
    alone = placed.where("label is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), "node", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_representatives(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id (rows that share an id stay together)."""
    found = join_components(docs, k, percent)
    return without(docs, found.where(F.col("doc_id") != F.col("component_id")))
