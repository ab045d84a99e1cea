"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, and ordered along a Hilbert curve, once per curve; each ordering is cut into
blocks of neighbouring keys. A query meets the blocks within a window around its own block on every curve, the candidates of all
curves merge, and scores on the original vectors rank them. For the largest inner product all vectors get one more coordinate
that makes their lengths equal, which leaves nearness and inner product in the same order.

The window is measured, not assumed: for a bounded pilot of queries the true neighbours are found against all rows, and the
window is the least that keeps ``recall`` of them. Where the windows of all curves together would read as much as the table, one
curve is read whole, which is exact. Equal vectors are one class that keeps its k + 1 least ids, which loses no result.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite numbers take no part,
nor do rows with a null id; repeated rows count once, and an id with several vectors scores by the pair that is nearest, as a
query and as a candidate; ties go to the smaller id; a table with fewer than k
candidates gives all of them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import materialise

CURVES, DIMENSIONS, BITS = 4, 8, 7
BLOCK_ROWS, MOST_BLOCKS = 8_192, 4_096
PILOT, RECALL = 64, 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer cells (rows x dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of finer levels
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections and shifts of all curves, a function of the dimension and the vectors' scale alone."""

    def __init__(self, dim: int, longest: float, curves: int = CURVES, seed: int = 3):
        rng = np.random.default_rng(seed)
        low = min(DIMENSIONS, dim + 1)
        self.longest = longest
        self.bases = [np.linalg.qr(rng.normal(size=(dim + 1, low)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, low) for _ in range(curves)]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x curves"""
        rest = np.sqrt(np.maximum(0, self.longest ** 2 - (x * x).sum(axis=1)))
        wide = np.hstack((x, rest[:, None])) / max(self.longest, 1e-300)
        side = 1 << BITS
        reach = 3 / np.sqrt(x.shape[1] + 1)
        out = []
        for base, shift in zip(self.bases, self.shifts):
            cells = np.floor(((wide @ base) / reach + 1) / 2 * (side - 1) * 0.9 + shift * 0.1 * side)
            out.append(hilbert_keys(np.clip(cells, 0, side - 1).astype(np.int64), BITS))
        return np.stack(out, axis=1)


def _matrix(column) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(~bad & F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    return v.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query row, candidate row, score): the k best ids of ``x`` for every query, each with its best row, ties by id; scores are
    summed row by row."""
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, cols, scores = [], [], []
    by_id = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], ids[by_id][1:] != ids[by_id][:-1])))
    several = len(first) < len(ids)  # ids with more than one vector
    if several:
        group = np.empty(len(ids), np.int64)
        group[by_id] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    for a in range(0, len(q), 256):
        s = q[a:a + 256] @ x.T
        s[q_ids[a:a + 256, None] == ids[None, :]] = -np.inf
        tops = np.maximum.reduceat(s[:, by_id], first, axis=1) if several else s
        if tops.shape[1] > k:
            bar = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            near = s >= (bar - 1e-9 * (1 + np.abs(bar)))[:, None]
        else:
            near = s > -np.inf
        if several:
            best = tops[:, group]
            near &= s >= best - 1e-9 * (1 + np.abs(best))
        r, c = np.nonzero(near)
        keep = q_ids[a + r] != ids[c]
        r, c = r[keep], c[keep]
        exact = (q[a + r] * x[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        if several:
            again = np.sort(np.unique(r * np.int64(len(first)) + group[c], return_index=True)[1])
            r, c, exact = r[again], c[again], exact[again]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        rows.append(a + r[top])
        cols.append(c[top])
        scores.append(exact[top])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


_PAIRS = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])
_KEYED = StructType([StructField("vec_id", LongType()), StructField("keys", ArrayType(LongType())), StructField("vec", BinaryType())])
_PLACED = StructType([StructField("curve", IntegerType()), StructField("block", IntegerType()), StructField("kind", IntegerType()),
                      StructField("vec_id", LongType()), StructField("vec", BinaryType())])


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _keyed(v: DataFrame, curves: Curves) -> DataFrame:
    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            keys = curves.keys(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array([r.tobytes() for r in x], pa.binary())], names=_KEYED.names)

    return v.mapInArrow(run, _KEYED)


def _met(batches, k: int):
    """Rows sorted by (curve, block, kind): vectors (0) of a block first, then the queries (1) that meet it."""
    place, ids, vecs = None, [], []
    for batch in batches:
        curve, block, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edges = np.flatnonzero(np.concatenate(([True], (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True])))
        for lo, hi in zip(edges, edges[1:]):
            part = batch.slice(lo, hi - lo)
            x = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(hi - lo, -1)
            n = part.column(3).to_numpy(zero_copy_only=False)
            if (curve[lo], block[lo]) != place:
                place, ids, vecs = (curve[lo], block[lo]), [], []
            if kind[lo] == 0:
                ids.append(n)
                vecs.append(x)
                continue
            if not vecs:
                continue
            ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
            q, c, s = _best(x, n, vecs[0], ids[0], k)
            yield pa.RecordBatch.from_arrays([pa.array(n[q]), pa.array(ids[0][c]), pa.array(s)], names=_PAIRS.names)


def nearest(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, block_rows: int = BLOCK_ROWS, pilot: int = PILOT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose vec_id meets ``is_query``."""
    spark = vectors.sparkSession
    v = usable(vectors).distinct()
    same = Window.partitionBy(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).orderBy("vec_id")
    kept = v.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).select("vec_id", "embedding")
    shape = v.agg(F.max(F.size("embedding")).alias("dim"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).first()
    if shape["dim"] is None:
        return spark.createDataFrame([], _PAIRS).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    curves = Curves(shape["dim"], float(np.sqrt(shape["sq"])))
    base = materialise(_keyed(kept, curves))
    asked = _keyed(v.where(is_query(F.col("vec_id"))), curves)
    n = base.count()
    n_blocks = int(min(MOST_BLOCKS, max(1, -(-n // block_rows))))
    cuts = [[] for _ in range(CURVES)]
    if n_blocks > 1:
        at = [i / n_blocks for i in range(1, n_blocks)]
        row = base.agg(*[F.percentile_approx(F.col("keys")[c], at, 20 * n_blocks).alias(f"c{c}") for c in range(CURVES)]).first()
        cuts = [sorted(row[f"c{c}"]) for c in range(CURVES)]
    reach, used = n_blocks, 1
    if n_blocks > 1:
        width = _window(base, asked, cuts, k, recall, pilot)
        if CURVES * (2 * width + 1) < n_blocks:
            reach, used = width, CURVES

    def place(kind: int, far: int):
        edges = [np.array(c, np.int64) for c in cuts]

        def run(batches):
            for b in batches:
                keys = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ids, vec = b.column(0), b.column(2)
                for c in range(used):
                    own = np.searchsorted(edges[c], keys[:, c], side="right")
                    for step in range(-far, far + 1):
                        to = own + step
                        ok = np.flatnonzero((to >= 0) & (to < n_blocks))
                        if len(ok):
                            pick = pa.array(ok)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), c, np.int32)), pa.array(to[ok].astype(np.int32)), pa.array(np.full(len(ok), kind, np.int32)),
                                                              ids.take(pick), vec.take(pick)], names=_PLACED.names)

        return run

    rows = base.mapInArrow(place(0, 0), _PLACED).unionByName(asked.mapInArrow(place(1, reach), _PLACED))
    met = rows.repartitionByRange(used * n_blocks, "curve", "block").sortWithinPartitions("curve", "block", "kind")
    pairs = met.mapInArrow(lambda b: _met(b, k), _PAIRS)
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(pairs, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _window(base: DataFrame, asked: DataFrame, cuts: list[list[int]], k: int, recall: float, pilot: int) -> int:
    """The least block distance that keeps ``recall`` of the pilot's true neighbours on at least one curve."""
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pilot).collect()
    if not some:
        return 0
    ids = np.array([r["vec_id"] for r in some])
    q = np.stack([np.frombuffer(r["vec"], np.float64) for r in some])
    own: dict[int, list[list[int]]] = {}
    for r in some:
        own.setdefault(r["vec_id"], []).append([int(np.searchsorted(c, r["keys"][j], side="right")) for j, c in enumerate(cuts)])
    kind = StructType([*_PAIRS, StructField("keys", ArrayType(LongType()))])

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(b.num_rows, -1)
            mine = b.column(0).to_numpy(zero_copy_only=False)
            r, c, s = _best(q, ids, x, mine, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(mine[c]), pa.array(s), b.column(1).take(pa.array(c))], names=kind.names)

    once = base.mapInArrow(run, kind).groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "keys")).alias("m")).select("query_id", "vec_id", "m.*")
    true = _top(once, k).collect()  # pilot x k rows
    far = sorted(min(abs(int(np.searchsorted(c, r["keys"][j], side="right")) - at[j]) for at in own[r["query_id"]] for j, c in enumerate(cuts)) for r in true)
    return far[min(len(far) - 1, int(np.ceil(recall * len(far))))] if far else 0
