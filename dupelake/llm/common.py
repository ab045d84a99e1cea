"""Helpers shared by the operators: shared folders, size-checked joins, and array views of text columns."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key table of at most this many rows (two longs each, under 50 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = sc.getCheckpointDir() or os.path.abspath(os.path.join("/tmp", f"spark-{uuid.uuid4().hex}"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_and_reread(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint if it is proven to have at most ``limit`` rows, else as it is (a shuffled join)."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is in ``ids``; rows with a null key stay."""
    return docs.join(small_side(materialise(ids.select(key).where(F.col(key).isNotNull()).distinct())), key, "left_anti").select(*docs.columns)


def crc_fold(column, parts: int):
    """crc32 of the id written as text, modulo ``parts``; null ids fall in fold -1."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(-1))


def utf8_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets, without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most_bytes: int = 2 << 20):
    """Runs [a, b) of consecutive rows with at most ``most_bytes`` bytes together (one row may exceed it alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_R = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p) if n else p


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are sorted and do not overlap."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    inverse = pow(_R, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    i, fwd, back = 0, _powers(0, _R), _powers(0, inverse)
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + block, side="right")))
        hi = int(ends[j - 1])
        if len(fwd) < hi - lo + 1:
            fwd, back = _powers(hi - lo + 1, _R), _powers(hi - lo + 1, inverse)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * fwd[:hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((run[e] - run[s]) * back[s] + (e - s).astype(np.uint64))
        i = j
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word: a run of bytes other than ASCII white space, A-Z in lower case, in text order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ink = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | first[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, span_hashes(_LOWER[data], starts, ends)


def shingle_sets(rows: np.ndarray, word: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct: every row's set of k-word shingles; a shorter row has its whole sequence as one."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))
    step = np.uint64(0xD6E8FEB86659FD93)
    h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= k:
        h = np.full(len(word) - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            h = h * step + word[j:len(word) - k + 1 + j]
        same = rows[:len(rows) - k + 1] == rows[k - 1:]
        h, owner = mix64(h[same]), rows[:len(rows) - k + 1][same]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        length = count[short].astype(np.uint64)
        part = length.copy()
        for j in range(k - 1):
            live = count[short] > j
            part[live] = part[live] * step + word[first[short[live]] + j]
        h, owner = np.concatenate((h, mix64(part))), np.concatenate((owner, short))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], h[keep]


def fold_of(doc_id, parts: int) -> int:
    """The same fold as ``crc_fold``, in Python."""
    return -1 if doc_id is None else zlib.crc32(str(int(doc_id)).encode()) % parts
