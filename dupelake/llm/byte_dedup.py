"""Removal of repeated byte strings: a byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

Matching strings share their minimizer (the least hash among their 16-byte pieces), so only places whose minimizer occurs in two
documents can match. The steps, all as Spark jobs over all documents:

1. A document whose text is that of a document with a smaller id is covered whole and takes no further part.
2. Tasks send the distinct minimizers of their documents to hash buckets; buckets return to every chunk of documents the ones
   that occur in more than one place. Minimizers that a 64th of the documents shows to be frequent are known to be shared and
   are not sent at all, so no bucket gathers a hot one.
3. Chunks cut a fragment around every shared minimizer; fragments meet by minimizer. Equal fragments are one class. Where a
   minimizer has several classes, their Burrows-Wheeler transforms are built per shard and merged by interleave refinement, and
   the repeated intervals give the least document of every 50-byte string (``bwt.least_owner``).
4. The fragments of a frequent minimizer are salted over several tasks; what a task leaves open is settled by the hash of each
   50-byte string in one map-side combined minimum.
5. Covered stretches meet their document again and are merged there.

Defined cases: a null text is empty; rows with a null id keep all bytes and remove nothing; repeated rows are one document and
get the same result; rows whose id stands for different texts keep all bytes and remove nothing, too; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .bwt import least_owner, rolling
from .common import materialise, own_folder, slices, small_side, span_hashes, utf8_views, write_and_reread

LENGTH, PIECE, SYMBOL = 50, 16, 10
#: One of so many documents is looked at for frequent minimizers; so many hits there make one; at most so many are kept.
PILOT, PILOT_HITS, MOST_FREQUENT = 64, 8, 65_536
#: Fragments of one minimizer in one task, and bytes of one transform.
SALT_ROWS, BATCH_BYTES = 8_000, 400_000
CHUNK_BYTES = 4 << 20

_SENT = StructType([StructField("bucket", IntegerType()), StructField("packed", BinaryType())])
_SHARED = StructType([StructField("chunk", IntegerType()), StructField("packed", BinaryType())])
_FRAGMENTS = StructType([StructField("h", LongType()), StructField("salt", IntegerType()), StructField("doc_id", LongType()),
                         StructField("at", LongType()), StructField("frag", BinaryType())])
_STRETCHES = StructType([StructField(c, LongType()) for c in ("doc_id", "at", "until", "w1", "w2")])
_PAIR = np.dtype([("h", "<i8"), ("c", "<i4")])


def minimizers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first, last): for every run of 50-byte windows of one row that share their minimizer, the first and last start."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    h = rolling(data, PIECE)
    span = LENGTH - PIECE + 1
    least, n = h, 1
    while 2 * n <= span:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    m = len(h) - span + 1
    least = np.minimum(least[:m], least[span - n:span - n + m])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    whole = np.flatnonzero(np.arange(m) + LENGTH <= offsets[1:][row])
    least, row = least[whole], row[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    return row[first], least[first].view(np.int64), whole[first] - offsets[row[first]], whole[last] - offsets[row[first]]


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent minimizers and their salts, from the pilot documents; bounded by MOST_FREQUENT."""
    kind = StructType([StructField("h", LongType())])

    def run(batches):
        for batch in batches:
            data, offs = utf8_views(batch.column(0))
            for a, b in slices(offs):
                row, h, _, _ = minimizers(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.rec.fromarrays((row, h), names="r,h")).h if len(h) else h)], names=["h"])

    pilot = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(PILOT)) == 0).select("text").mapInArrow(run, kind)
    rows = (pilot.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= PILOT_HITS)
            .orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect())
    rows.sort(key=lambda r: r["h"])
    known = np.array([r["h"] for r in rows], np.int64)
    salts = np.array([-(-int(r["n"]) * PILOT // SALT_ROWS) for r in rows], np.int64)
    return known, np.maximum(salts, 1)


def _send(chunks: DataFrame, n_buckets: int, frequent: np.ndarray) -> DataFrame:
    """bucket, packed (hash, chunk) pairs of the minimizers that are not known to be frequent."""

    def run(batches):
        for batch in batches:
            data, offs = utf8_views(batch.column(1))
            chunk_of = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            got = []
            for a, b in slices(offs):
                row, h, _, _ = minimizers(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                keep = ~_in_sorted(h, frequent)
                order = np.lexsort((h[keep], row[keep]))
                row, h = row[keep][order], h[keep][order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                pairs = np.empty(int(once.sum()), _PAIR)
                pairs["h"], pairs["c"] = h[once], chunk_of[a + row[once]]
                got.append(pairs)
            pairs = np.concatenate(got) if got else np.zeros(0, _PAIR)
            bucket = (pairs["h"].view(np.uint64) if pairs["h"].flags.c_contiguous else pairs["h"].copy().view(np.uint64)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            pairs, bucket = pairs[order], bucket[order]
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
            parts = np.split(pairs, heads[1:]) if len(bucket) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32) if len(bucket) else [], pa.int32()),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], names=_SENT.names)

    return chunks.select("chunk", "text").mapInArrow(run, _SENT)


def _return(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the buckets of one task: chunk, packed hashes that occur in more than one document."""
    parts = [np.frombuffer(x.as_buffer(), _PAIR) for b in batches for x in b.column(1)]
    pairs = np.concatenate(parts) if parts else np.zeros(0, _PAIR)
    del parts
    h = np.ascontiguousarray(pairs["h"])
    order = np.argsort(h, kind="stable")
    h, c = h[order], pairs["c"][order]
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    twin[:-1] |= twin[1:]
    h, c = h[twin], c[twin]
    order = np.argsort(c, kind="stable")
    h, c = h[order], c[order]
    heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    out = [np.unique(p).tobytes() for p in np.split(h, heads[1:])] if len(c) else []
    yield pa.RecordBatch.from_arrays([pa.array(c[heads], pa.int32()), pa.array(out, pa.binary())], names=_SHARED.names)


def _cut(frequent: np.ndarray, salts: np.ndarray):
    """Fragments of the documents of each chunk; the chunk's shared minimizers come before its documents."""

    def run(batches):
        chunk, known = None, np.zeros(0, np.int64)
        for batch in batches:
            chunks, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero(np.concatenate(([True], (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1]), [True])))
            for lo, hi in zip(edges, edges[1:]):
                part = batch.slice(lo, hi - lo)
                if chunks[lo] != chunk:
                    chunk, known = chunks[lo], np.zeros(0, np.int64)
                if kinds[lo] == 0:
                    lists = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(4)]
                    known = np.unique(np.concatenate([known, *lists]))
                    continue
                data, offs = utf8_views(part.column(3))
                ids = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                for a, b in slices(offs):
                    row, h, first, last = minimizers(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                    hot = _in_sorted(h, frequent)
                    take = hot | _in_sorted(h, known)
                    row, h, first, last, hot = row[take], h[take], first[take], last[take], hot[take]
                    salt = np.zeros(len(h), np.int64)
                    salt[hot] = salts[np.searchsorted(frequent, h[hot])]
                    many = salt > 1
                    salt[~many] = -1
                    salt[many] = (ids[a + row[many]] * 2654435761 >> 7) % salt[many]
                    lens = last - first + LENGTH
                    ends = np.cumsum(lens)
                    start = offs[a + row] + first
                    idx = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - lens), lens)
                    frag = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data[idx])])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt.astype(np.int32)), pa.array(ids[a + row]), pa.array(first), frag], names=_FRAGMENTS.names)

    return run


def _settle(h: np.ndarray, salt: np.ndarray, doc: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray):
    """Stretches of some whole groups (h, salt): (doc, at, until, w1, w2); w1 and w2 name a string that is still open."""
    n = len(h)
    lens = np.diff(offs)
    key = span_hashes(data, offs[:-1], offs[1:])
    order = np.lexsort((doc, key, lens, salt, h))
    g = np.stack((h, salt, lens, key.view(np.int64)))[:, order]
    new = np.ones(n, bool)
    new[1:] = (g[:, 1:] != g[:, :-1]).any(axis=0)
    cls = np.empty(n, np.int64)
    cls[order] = np.cumsum(new) - 1
    rep = order[new]  # of each class, a row of its least document
    least = doc[rep]
    group_new = np.ones(len(rep), bool)
    group_new[1:] = (h[rep][1:] != h[rep][:-1]) | (salt[rep][1:] != salt[rep][:-1])
    group = np.cumsum(group_new) - 1
    mixed = np.bincount(group)[group] > 1
    later = doc > least[cls]
    out = [(doc[later], at[later], at[later] + lens[later])]
    openw = []
    work = np.flatnonzero(mixed | (salt[rep] >= 0))
    mine = np.flatnonzero(~later)
    by_class = mine[np.argsort(cls[mine], kind="stable")]
    cls_sorted = cls[by_class]
    for lo, hi in _runs(lens[rep[work]], group[work]):
        c = work[lo:hi]
        ln = lens[rep[c]]
        o = np.concatenate(([0], np.cumsum(ln)))
        d = data[np.arange(o[-1]) + np.repeat(offs[rep[c]] - o[:-1], ln)]
        low = least_owner(d, o, least[c], SYMBOL, LENGTH // SYMBOL)
        own = np.repeat(np.arange(len(c)), ln)
        start = np.arange(o[-1]) - o[own]
        whole = start + LENGTH <= ln[own]
        hit = whole & (low < least[c][own])
        a, b = np.searchsorted(cls_sorted, c), np.searchsorted(cls_sorted, c, side="right")
        edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & (own[1:] == own[:-1]))))
        stop = np.flatnonzero(hit & ~np.concatenate((hit[1:] & (own[1:] == own[:-1]), [False])))
        for k, s, e in ((own[edge], start[edge], start[stop] + LENGTH),):
            times = (b - a)[k]
            rows = by_class[np.arange(times.sum()) + np.repeat(a[k] - (np.cumsum(times) - times), times)]
            out.append((doc[rows], at[rows] + np.repeat(s, times), at[rows] + np.repeat(e, times)))
        left = np.flatnonzero(whole & ~hit & (salt[rep[c]] >= 0)[own])
        if len(left):
            w1, w2 = rolling(d, LENGTH)[left].view(np.int64), rolling(d, LENGTH, 7001)[left].view(np.int64)
            times = (b - a)[own[left]]
            rows = by_class[np.arange(times.sum()) + np.repeat(a[own[left]] - (np.cumsum(times) - times), times)]
            place = at[rows] + np.repeat(start[left], times)
            openw.append((doc[rows], place, place + LENGTH, np.repeat(w1, times), np.repeat(w2, times)))
    return out, openw


def _runs(lens: np.ndarray, group: np.ndarray):
    """[lo, hi) of whole groups with about BATCH_BYTES bytes."""
    lo, n, ends = 0, len(lens), np.cumsum(lens)
    while lo < n:
        hi = min(n, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_BYTES)) + 1)
        hi = int(np.searchsorted(group, group[hi - 1], side="right"))
        yield lo, hi
        lo = hi


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the fragments of one task, which come sorted by minimizer and salt; a group never spans two calls."""
    held: list[pa.RecordBatch] = []

    def flush(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        h, salt, doc, at = (t.column(i).to_numpy() for i in range(4))
        data, offs = utf8_views(t.column(4))
        done, openw = _settle(h, salt.astype(np.int64), doc, at, data, offs)
        d, a, u = (np.concatenate([x[i] for x in done]) for i in range(3))
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(u), none, none], names=_STRETCHES.names)
        if openw:
            d, a, u, w1, w2 = (np.concatenate([x[i] for x in openw]) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(u), pa.array(w1), pa.array(w2)], names=_STRETCHES.names)

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(4).nbytes
        if size < 8 << 20:
            continue
        last = held[-1]
        h, s = last.column(0).to_numpy(), last.column(1).to_numpy()
        same = np.flatnonzero((h != h[-1]) | (s != s[-1]))
        if not len(same):
            continue
        cut = int(same[-1]) + 1
        yield from flush([*held[:-1], last.slice(0, cut)])
        held = [last.slice(cut)]
        size = held[0].num_rows * 100
    if held:
        yield from flush(held)


_REPORT = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                      StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("kept", BinaryType())])


def _apply(with_kept: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, whole, cover in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                if whole and len(raw) >= LENGTH:
                    gone[0] = 1
                elif cover.is_valid:
                    c = cover.values
                    np.add.at(gone, c.field(0).to_numpy(), 1)
                    np.add.at(gone, c.field(1).to_numpy(), -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = raw[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_REPORT.names)

    return run


def stretches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, at, until) of covered bytes, and (doc_id, text_key) of documents that a smaller id has whole."""
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.select("doc_id", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"))
    unclear = materialise(keyed.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("doc_id"))
    rows, keyed = (d.join(small_side(unclear), "doc_id", "left_anti") for d in (rows, keyed))
    firsts = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = materialise(keyed.join(firsts, ["k1", "k2"]).where("doc_id > first").select("doc_id", F.col("k1").alias("text_key")).distinct())
    texts = (rows.withColumn("text_key", F.xxhash64(F.lit(1), "text"))
             .join(small_side(copies), ["doc_id", "text_key"], "left_anti").select("doc_id", "text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(8, -(-total // CHUNK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 << 20)))
    frequent, salts = _frequent(texts)
    chunked = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int"))
    sent = _send(chunked, 8 * parts, frequent).repartition(parts, "bucket")
    lists = sent.mapInArrow(_return, _SHARED).select(
        "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "packed")
    bodies = chunked.select("chunk", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("packed"))
    met = lists.unionByName(bodies).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    fragments = met.mapInArrow(_cut(frequent, salts), _FRAGMENTS).repartition(parts, "h", "salt").sortWithinPartitions("h", "salt")
    found = fragments.mapInArrow(_resolve, _STRETCHES)
    closed = ["doc_id", "at", "until"]
    if not len(salts) or salts.max() < 2:
        return found.select(*closed), copies
    found = write_and_reread(found, own_folder(spark, "stretches"))
    waiting = found.where("w1 is not null")
    least = waiting.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    settled = waiting.join(least, ["w1", "w2"]).where("doc_id > first")
    return found.where("w1 is null").select(*closed).unionByName(settled.select(*closed)), copies


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (the remaining bytes) of every row."""
    covers, copies = stretches(docs)
    per_doc = covers.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("at").cast("int"), F.col("until").cast("int"))).alias("cover"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(1), "text").alias("text_key"))
    marks = copies.select("doc_id", "text_key", F.lit(True).alias("whole"))
    joined = base.join(small_side(marks), ["doc_id", "text_key"], "left").join(per_doc, "doc_id", "left")
    out = joined.select("doc_id", "text", "whole", "cover").mapInArrow(_apply(with_kept), _REPORT)
    return out if with_kept else out.drop("kept")
