"""Candidate generation: exact keys that replace all-pairs comparison.

* duration tolerance: any admissible pair lands in the same or a neighbouring bucket of
  ``f(d) = integral of 1/tolerance``, so three keys replace a theta join;
* luma grid: total and top-minus-bottom luma differ by at most the allowed absolute difference, mirrored or not;
* hash bands: at most d differing bits leave one of d+1 bands untouched, and a quorum of q positions always
  includes two among the first n-q+2, so banded position pairs are exact keys.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DIFF_DIVISOR, FRAME_PIXELS, ScanConfig
from ..functions import paths as P
from ..functions.paths import _col
from ..functions.vectors import allowed_bits, required_matches
from ..plans.skew import cut_lineage, store_alone

_SHRINK = 1.0 - 1e-9


def duration_tolerance(duration, cfg: ScanConfig) -> Column:
    """Seconds two durations may differ, from the percent rule and the optional bounds."""
    d, lo, hi = _col(duration), cfg.duration_min_s, cfg.duration_max_s
    if cfg.duration_percent > 0:
        tol = d * cfg.duration_percent / 100.0
        if lo > 0:
            tol = F.greatest(tol, F.lit(float(lo)))
        if hi > 0:
            tol = F.least(tol, F.lit(float(hi)))
        return F.greatest(F.lit(0.0), tol)
    return F.lit(float(max(0.0, lo, hi)))


def duration_bucket(duration, cfg: ScanConfig) -> Column:
    """Bucket whose same-or-next neighbourhood holds every admissible partner."""
    d = _col(duration).cast("double")
    p, lo, hi = cfg.duration_percent / 100.0, cfg.duration_min_s, cfg.duration_max_s
    if p <= 0:
        flat = max(lo, hi)
        return F.floor(d / flat * _SHRINK).cast("bigint") if flat > 0 else F.xxhash64(d)
    if 0 < hi < lo:
        return F.floor(d / hi * _SHRINK).cast("bigint")
    start = lo / p if lo > 0 else 1e-3
    at_start = start / lo if lo > 0 else 1.0
    key = F.when(d <= start, d / lo if lo > 0 else F.lit(at_start))
    if hi > 0 and hi / p > start:
        stop = hi / p
        key = (key.when(d <= stop, at_start + F.log(d / start) / p)
               .otherwise(at_start + math.log(stop / start) / p + (d - stop) / hi))
    elif hi > 0:
        key = key.otherwise(at_start + (d - start) / hi)
    else:
        key = key.otherwise(at_start + F.log(d / start) / p)
    return F.floor(key * _SHRINK).cast("bigint")


def bucket_reach(cfg: ScanConfig) -> int:
    """How far neighbouring buckets reach (0 when durations must be equal)."""
    return 0 if cfg.duration_percent <= 0 and max(cfg.duration_min_s, cfg.duration_max_s) <= 0 else 1


def within_tolerance(da, db, cfg: ScanConfig) -> Column:
    a, b = _col(da), _col(db)
    return F.abs(a - b) <= F.least(duration_tolerance(a, cfg), duration_tolerance(b, cfg))


def folder_key(folder, cfg: ScanConfig) -> Column:
    """Last ``folder_depth`` segments when a folder gate is on, else a constant."""
    return F.lit("") if cfg.folder_mode == "none" else P.last_segments(folder, cfg.folder_depth)


def folder_gate(key_a, key_b, cfg: ScanConfig) -> Column:
    if cfg.folder_mode == "none":
        return F.lit(True)
    same = _col(key_a) == _col(key_b)
    return same if cfg.folder_mode == "same" else ~same


def not_same_file(a: str, b: str, cfg: ScanConfig) -> Column:
    """Hard-link exclusion: equal size, duration, device and inode."""
    if not cfg.exclude_hard_links:
        return F.lit(True)
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("size", "duration_s", "dev", "inode")]
    return ~F.coalesce(same[0] & same[1] & same[2] & same[3], F.lit(False))


def duration_pairs(media: DataFrame, cfg: ScanConfig, partition: list[str] | None = None,
                   order: str = "file_id") -> DataFrame:
    """Exact duration-tolerance self join: pairs ``a_<order> < b_<order>`` inside the same partition columns.

    Needs ``order``, ``duration_s`` and (with a folder gate) ``folder``. Only ids, durations and gate keys are
    shuffled. The lower bucket probes; the other side carries two keys (its own bucket and the one below).
    """
    part = list(partition or [])
    base = media.select(F.col(order).alias("id"), "duration_s", *part, duration_bucket("duration_s", cfg).alias("bk"),
                        (folder_key("folder", cfg) if cfg.folder_mode != "none" else F.lit("")).alias("fk"))
    keys = ["bk", *part] + (["fk"] if cfg.folder_mode == "same" else [])
    left = base.select(*[c for c in base.columns])
    deltas = [0, 1] if bucket_reach(cfg) else [0]
    right = (base.withColumn("delta", F.explode(F.array(*[F.lit(x) for x in deltas])))
             .withColumn("bk", F.col("bk") - F.col("delta")))
    l, r = left.alias("l"), right.alias("r")
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    joined = l.join(r, cond).where((F.col("r.delta") == 1) | (F.col("l.id") < F.col("r.id")))
    joined = joined.where(within_tolerance("l.duration_s", "r.duration_s", cfg))
    if cfg.folder_mode == "different":
        joined = joined.where(F.col("l.fk") != F.col("r.fk"))
    swap = F.col("l.id") > F.col("r.id")
    return joined.select(
        F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"),
        F.when(swap, F.col("r.duration_s")).otherwise(F.col("l.duration_s")).alias("duration_a"),
        F.when(swap, F.col("l.duration_s")).otherwise(F.col("r.duration_s")).alias("duration_b"))


def ratio_pairs(media: DataFrame, min_ratio: float, cfg: ScanConfig | None = None,
                carry: list[str] | None = None) -> DataFrame:
    """Clip-in-source candidates: clip/source in [min_ratio, 0.95), clip and source at least one second.

    Buckets are octaves of the duration; a source looks at the octaves its ratio range can reach, so the join is an
    equi join whose hot octaves are split by adaptive skew handling. ``carry`` columns come out as source_/clip_.
    """
    cfg = cfg or ScanConfig()
    carry = list(carry or [])
    reach = int(math.ceil(math.log2(1.0 / min_ratio))) + 1
    base = media.where(F.col("duration_s") >= 1.0).withColumn("oct", F.floor(F.log2("duration_s")).cast("int"))
    if cfg.folder_mode != "none":
        base = base.withColumn("fk", folder_key("folder", cfg))
    else:
        base = base.withColumn("fk", F.lit(""))
    src = base.withColumn("oct", F.explode(F.sequence(F.col("oct") - reach, F.col("oct")))).alias("s")
    clip = base.alias("c")
    ratio = F.col("c.duration_s") / F.col("s.duration_s")
    cond = [F.col("s.oct") == F.col("c.oct")] + ([F.col("s.fk") == F.col("c.fk")] if cfg.folder_mode == "same" else [])
    out = src.join(clip, cond).where((ratio >= min_ratio) & (ratio < 0.95) & (F.col("s.file_id") != F.col("c.file_id")))
    if cfg.folder_mode == "different":
        out = out.where(F.col("s.fk") != F.col("c.fk"))
    return out.select(F.col("s.file_id").alias("source_id"), F.col("c.file_id").alias("clip_id"),
                      *[F.col(f"s.{c}").alias(f"source_{c}") for c in carry],
                      *[F.col(f"c.{c}").alias(f"clip_{c}") for c in carry])


def allowed_total_difference(cfg: ScanConfig, samples: int) -> float:
    """Upper bound of the summed absolute pixel difference of a matching pair (slack covers float rounding)."""
    return (1.0 - cfg.percent / 100.0) * samples * FRAME_PIXELS * DIFF_DIVISOR * (1 + 1e-4) + 1.0


def band_layout(percent: float) -> list[tuple[int, int]]:
    """(shift, width) of d+1 bands that cover the 64 bits."""
    n = allowed_bits(percent) + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def _band(word: Column, shift: int, width: int) -> Column:
    moved = F.shiftrightunsigned(word, shift) if shift else word
    return moved if width >= 64 else moved.bitwiseAND(F.lit((1 << width) - 1 if width < 63 else 2**63 - 1))


def _position_pairs(samples: int, quorum: int) -> list[tuple[int, int]]:
    """Pairs of positions of which any ``quorum`` matching positions hold one."""
    return [(i, j) for i, j in itertools.combinations(range(samples), 2) if i <= samples - quorum and j <= samples - quorum + 1]


def first_shared_key(x, y, samples: int, cfg: ScanConfig) -> Column:
    """Place of the first of ``hash_band_keys`` that two arrays (or lists) of hashes share, read off their bits; null without one."""
    x, y = (v if isinstance(v, list) else _col(v) for v in (x, y))
    bands, quorum = band_layout(cfg.percent), required_matches(samples, cfg.quorum_ratio)
    equal = []
    for p in range(samples):
        turned, band = x[p].bitwiseXOR(y[p]), F.lit(None).cast("int")
        for k, b in reversed(list(enumerate(bands))):
            band = F.when(_band(turned, *b) == 0, F.lit(k)).otherwise(band)
        equal.append(band)
    n = len(bands)
    if quorum == 1:
        places = [band + p * n for p, band in enumerate(equal)]
    else:
        places = [equal[i] * n + equal[j] + c * n * n for c, (i, j) in enumerate(_position_pairs(samples, quorum))]
    return F.coalesce(*places)


def hash_band_keys(phash, samples: int, cfg: ScanConfig) -> Column:
    """Array of exact-key hashes for an array (or list) of per-position 64-bit hashes."""
    words = phash if isinstance(phash, list) else _col(phash)
    bands = band_layout(cfg.percent)
    quorum = required_matches(samples, cfg.quorum_ratio)
    keys = []
    if quorum == 1:
        for pos in range(samples):
            w = words[pos]
            keys += [F.xxhash64(F.lit(pos), F.lit(k), _band(w, *b)) for k, b in enumerate(bands)]
    else:
        for i, j in _position_pairs(samples, quorum):
            for (k, bi), (m, bj) in itertools.product(enumerate(bands), enumerate(bands)):
                keys.append(F.xxhash64(F.lit(i), F.lit(j), F.lit(k), F.lit(m), _band(words[i], *bi),
                                       _band(words[j], *bj)))
    return F.array(*keys)


def _probes(samples: int, cfg: ScanConfig) -> list[tuple[int, tuple[int, int]]]:
    """Single bands (position, band) of which two arrays with a quorum share one: any quorum includes one of the first positions."""
    return [(p, b) for p in range(samples - required_matches(samples, cfg.quorum_ratio) + 1) for b in band_layout(cfg.percent)]


def _first_probe(x: list, y: list, samples: int, cfg: ScanConfig) -> Column:
    """Place of the first of ``_probes`` that two lists of hashes share; null without one."""
    return F.coalesce(*[F.when(_band(x[p].bitwiseXOR(y[p]), *b) == 0, F.lit(k)) for k, (p, b) in enumerate(_probes(samples, cfg))])


#: Duration buckets per cell of the hash join: rows of one hash meet only near their own duration, at one copy in eight more.
CELL_BUCKETS = 8
#: Key rows of one pass of the hash join. Larger joins go through their keys in passes, each of which frees its shuffle files.
PASS_ROWS = 30_000_000
#: About as many files tell which bands are frequent, and from how many of them on (a band of up to HOT_FILES files is not).
PILOT_FILES, PILOT_HITS, HOT_FILES = 100_000, 8, 256


def hash_pairs(files: DataFrame, cfg: ScanConfig, samples: int, mirrored: bool = False) -> DataFrame:
    """Exact hash-quorum self join, scored in the JVM where the keys meet.

    ``files``: file_id, path, duration_s, phash array (plus folder/size/dev/inode for the gates). Returns
    a, b (a first by path), diff, matches. With ``mirrored`` the array ``phash_flip`` of a meets ``phash`` of b.

    Files meet on single bands, and where a band is frequent on pairs of bands of two positions; any choice of frequent
    bands gives the same pairs. Key rows carry the hashes, so a meeting is judged at once; a pair that shares several
    keys counts at the first of them only, which needs no distinct. A boolean column ``is_new`` leaves pairs of known
    files out.
    """
    reach, quorum, n = bucket_reach(cfg), required_matches(samples, cfg.quorum_ratio), files.count()
    delta_join = "is_new" in files.columns
    gates = (["fk"] if cfg.folder_mode != "none" else []) + (["size", "dev", "inode"] if cfg.exclude_hard_links else [])
    base = files.withColumn("bk", duration_bucket("duration_s", cfg))
    if cfg.folder_mode != "none":
        base = base.withColumn("fk", folder_key("folder", cfg))
    same_folder = [F.col("fk")] if cfg.folder_mode == "same" else []
    names = [f"w{p}" for p in range(samples)]
    words = lambda side="": [F.col(side + w) for w in names]
    carried = ["file_id", "duration_s", *names, *gates, *(["is_new"] if delta_join else [])]
    sides = ["phash_flip", "phash"] if mirrored else ["phash"]
    rows = {c: base.select("*", *[F.col(c)[p].alias(w) for p, w in enumerate(names)]).select(*carried, "bk") for c in sides}
    probes = _probes(samples, cfg)
    probe = [F.xxhash64(F.lit(k), _band(F.col(names[p]), *b), *same_folder) for k, (p, b) in enumerate(probes)]

    hot = None
    if quorum > 1 and n > HOT_FILES:
        step = max(1, n // PILOT_FILES)
        pilot = [rows[c].where(F.pmod(F.xxhash64("file_id"), F.lit(step)) == 0).select(F.explode(F.array(*probe)).alias("probe")) for c in sides]
        often = reduce(DataFrame.unionByName, pilot).groupBy("probe").count().where(F.col("count") > max(PILOT_HITS, HOT_FILES // step))
        hot = cut_lineage(often.select("probe"))
        hot = F.broadcast(hot) if hot.limit(1).count() else None

    def keyed(table: DataFrame, keys: list[Column], places: list[int], *more: str) -> DataFrame:
        """A row per key and cell: the file's own cell, and as a guest the cell before, whose last bucket is next to the file's."""
        at = F.floor(F.col("bk") / F.lit(CELL_BUCKETS)).cast("bigint") if reach else F.col("bk")
        home, guest = (F.struct((at - g).alias("cell"), F.lit(g).alias("guest")) for g in (0, 1))
        first = F.pmod("bk", F.lit(CELL_BUCKETS)) == 0 if reach else F.lit(False)
        cells = F.explode(F.when(first, F.array(home, guest)).otherwise(F.array(home)))
        entries = F.array(*[F.struct(F.lit(2 * k).alias("tag"), keys[k].alias("probe")) for k in places])
        out = table.select("*", cells.alias("c")).select("*", F.explode(entries).alias("e"))
        return out.select(*carried, *more, F.col("e.probe").alias("probe"), (F.col("e.tag") + F.col("c.guest")).alias("tag"),
                          F.xxhash64("e.probe", "c.cell").alias("key"))

    lw, rw = words("l."), words("r.")
    bits = allowed_bits(cfg.percent)
    dist = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(lw, rw)]
    hits = sum((F.when(d <= bits, 1).otherwise(0) for d in dist), F.lit(0))

    def judged(left: DataFrame, right: DataFrame, first_key: Column, old: bool, *also: Column) -> DataFrame:
        place = lambda c: F.shiftright(F.col(c), 1)
        guests = F.col("l.tag").bitwiseAND(F.col("r.tag")).bitwiseAND(F.lit(1)) == 1
        once = F.col("l.file_id") != F.col("r.file_id") if mirrored or old else F.col("l.file_id") < F.col("r.file_id")
        # sizes are estimated before the keys are exploded, so without the hint a side may be broadcast whole
        pairs = left.alias("l").join(right.alias("r").hint("merge"), F.col("l.key") == F.col("r.key"))
        pairs = pairs.where(once & ~guests & (place("l.tag") == place("r.tag")) & within_tolerance("l.duration_s", "r.duration_s", cfg) & (hits >= quorum))
        pairs = pairs.where(not_same_file("l", "r", cfg)).where(first_key == place("l.tag"))
        if cfg.folder_mode != "none":
            pairs = pairs.where(folder_gate("l.fk", "r.fk", cfg))
        for condition in also:
            pairs = pairs.where(condition)
        return pairs.select(F.col("l.file_id").alias("x"), F.col("r.file_id").alias("y"), hits.alias("matches"),
                            (sum(dist, F.lit(0)) / F.lit(64.0 * samples)).cast("float").alias("diff"))

    def join(tables: dict, keys: list[Column], first_key: Column, files: int, drop_hot: bool, *also: Column, more: tuple = ()) -> list[DataFrame]:
        passes = min(len(keys), -(-files * len(keys) * len(sides) // PASS_ROWS)) or 1
        found = []
        for k in range(passes):
            sent = {c: keyed(t, keys, list(range(len(keys)))[k::passes], *more) for c, t in tables.items()}
            if drop_hot:
                sent = {c: t.join(hot, "probe", "left_anti") for c, t in sent.items()}
            left, right = (sent[c].drop("probe") for c in (sides[0], sides[-1]))
            parts = [(left.where("is_new"), right, False), (left.where("not is_new"), right.where("is_new"), True)] if delta_join else [(left, right, False)]
            if delta_join and not mirrored:  # new files meet one another once, and known files
                parts[0] = (left.where("is_new"), right.where("is_new"), False)
            part = reduce(DataFrame.unionByName, [judged(a, b, first_key, old, *also) for a, b, old in parts])
            found.append(store_alone(part) if passes > 1 else part)
        return found

    found = join(rows, probe, _first_probe(lw, rw, samples, cfg), n, hot is not None)
    if hot is not None:
        places = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), c.alias("probe")) for k, c in enumerate(probe)]))
        often = {c: t.select("file_id", places.alias("e")).select("file_id", "e.*").join(hot, "probe").groupBy("file_id").agg(
            F.collect_set("place").alias("hot")) for c, t in rows.items()}
        often = {c: cut_lineage(t.join(often[c], "file_id")) for c, t in rows.items()}
        paired = hash_band_keys(words(), samples, cfg)
        keys = [F.xxhash64(F.get(paired, F.lit(k)), *same_folder) for k in range(len(_position_pairs(samples, quorum)) * len(band_layout(cfg.percent)) ** 2)]
        count = max(t.count() for t in often.values())
        found += join(often, keys, first_shared_key(lw, rw, samples, cfg), count, False,
                      F.array_contains("l.hot", _first_probe(lw, rw, samples, cfg)), more=("hot",))
    found = reduce(DataFrame.unionByName, found)
    paths = files.select("file_id", "path")
    px, py = paths.select(F.col("file_id").alias("x"), F.col("path").alias("px")), paths.select(F.col("file_id").alias("y"), F.col("path").alias("py"))
    found = found.join(px, "x").join(py, "y")
    first = F.struct(F.col("px").alias("p"), F.col("x").alias("i")) < F.struct(F.col("py").alias("p"), F.col("y").alias("i"))
    if mirrored:
        return found.where(first).select(F.col("x").alias("a"), F.col("y").alias("b"), "diff", "matches")
    return found.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"),
                        "diff", "matches")
