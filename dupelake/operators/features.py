"""Feature jobs over decoded rows: sample positions, hashes, darkness, audio words, embeddings, cache reuse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import DENSE_MAX_SLOTS, EntryFlag, ScanConfig
from ..functions import kernels as K

AUDIO_RATE, AUDIO_FRAME, AUDIO_HOP = 11025, 4096, 1365
#: Chroma comparisons: neighbours, minor thirds, tritones (fixed values).
CHROMA_PAIRS = [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 3) % 12) for i in range(12)] + [
    (i, (i + 6) % 12) for i in range(8)]
#: Temporal smoothing weights and their norm (fixed values).
FIR_WEIGHTS, FIR_NORM = (0.25, 0.50, 1.00, 0.50, 0.25), 2.5


def sample_positions(media: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(file_id, pos, sec): position ordinals and their seconds; images have one position at 0."""
    n = cfg.sample_count
    span = F.col("duration_s")
    if cfg.max_sampling_s > 0:
        span = F.least(span, F.lit(float(cfg.max_sampling_s)))
    step = np.float32(1.0) / np.float32(n + 1)
    acc, fractions = np.float32(0), []
    for _ in range(n):  # cumulative single-precision steps
        acc = np.float32(acc + step)
        fractions.append(float(acc))
    pos = F.explode(F.when(F.col("is_image"), F.array(F.struct(F.lit(0).alias("pos"), F.lit(0.0).alias("f")))).otherwise(
        F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("f")) for i, f in enumerate(fractions)])))
    return media.select("file_id", span.alias("__d"), pos.alias("p")).select(
        "file_id", "p.pos", (F.col("__d") * F.col("p.f")).alias("sec"))


def hash_frames(frames: DataFrame) -> DataFrame:
    return frames.withColumn("phash", K.phash("gray"))


def flip_frames(frames: DataFrame) -> DataFrame:
    return frames.withColumn("gray", K.flip("gray"))


def backfill_hashes(frames: DataFrame) -> DataFrame:
    """Hash only the frames that lack one."""
    done = frames.where("phash is not null")
    todo = frames.where("phash is null")
    return done.unionByName(hash_frames(todo).select(*frames.columns))


def dark_files(frames: DataFrame) -> DataFrame:
    """(file_id, too_dark): every sampled position is dark."""
    dark = F.col("dark") if "dark" in frames.columns else K.is_dark("gray")
    return frames.withColumn("__d", dark).groupBy("file_id").agg(F.bool_and("__d").alias("too_dark"))


def flag_too_dark(media: DataFrame, frames: DataFrame) -> DataFrame:
    j = media.join(dark_files(frames), "file_id", "left")
    bit = int(EntryFlag.TOO_DARK)
    return j.withColumn("flags", F.when(F.col("too_dark"), F.col("flags").bitwiseOR(F.lit(bit))).otherwise(
        F.col("flags"))).drop("too_dark")


def dense_slot_usability(dense: DataFrame, frame: str = "rgb") -> DataFrame:
    """A slot is usable when it is not dark and differs from the previous raw slot.

    Slots per file are capped by the sampling interval (at most 400), so the per-file window is bounded.
    """
    w = Window.partitionBy("file_id").orderBy("slot")
    same = F.coalesce(F.col(frame) == F.lag(frame).over(w), F.lit(False))
    return dense.withColumn("usable", ~F.coalesce(K.is_dark_rgb(frame), F.lit(True)) & ~same)


def dense_interval(duration) -> Column:
    """Seconds between dense slots: a sixtieth of the duration within 5..15 s, never more than 400 slots."""
    d = F.col(duration) if isinstance(duration, str) else duration
    return F.greatest(F.least(F.greatest(d / 60.0, F.lit(5.0)), F.lit(15.0)), d / float(DENSE_MAX_SLOTS))


# --- audio --------------------------------------------------------------------------------------------------------

def _chroma_map() -> np.ndarray:
    bins = np.arange(AUDIO_FRAME // 2 + 1)
    freq = bins * AUDIO_RATE / AUDIO_FRAME
    out = np.full(len(bins), -1)
    ok = (bins > 0) & (bins < AUDIO_FRAME // 2) & (freq >= 27.5) & (freq <= 3520.0)
    out[ok] = (12.0 * np.log2(freq[ok] / 27.5)).astype(int) % 12
    return out


def chroma_energies(pcm: np.ndarray) -> np.ndarray:
    """(frames, 4096) samples in [-1, 1] -> 12 squared-magnitude sums per frame."""
    i = np.arange(AUDIO_FRAME)
    hann = 0.5 * (1.0 - np.cos(i * (2.0 * np.pi / (AUDIO_FRAME - 1))))
    spec = np.fft.rfft(pcm * hann, axis=1)
    power = spec.real ** 2 + spec.imag ** 2
    classes = _chroma_map()
    return np.stack([power[:, classes == c].sum(axis=1) for c in range(12)], axis=1)


#: Frames transformed at once: a frame takes about 150 KB of scratch, a whole Arrow batch of them 1.5 GB.
FRAMES_AT_ONCE = 256


def frame_energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, frame, c0 .. c11) of (file_id, frame, samples) rows, some frames at a time."""
    for batch in batches:
        found = []
        for start in range(0, batch.num_rows, FRAMES_AT_ONCE):
            samples = batch.column("samples").slice(start, FRAMES_AT_ONCE)
            if (samples.value_lengths().to_numpy(zero_copy_only=False) != AUDIO_FRAME).any():
                raise ValueError("a track with missing chunks")
            pcm = samples.flatten().to_numpy(zero_copy_only=False).reshape(-1, AUDIO_FRAME)
            found.append(chroma_energies(pcm * (1.0 / 32768.0)))
        if found:
            values = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("frame"), *[pa.array(values[:, i]) for i in range(12)]],
                                             names=["file_id", "frame", *[f"c{i}" for i in range(12)]])


def audio_frames(pcm: DataFrame) -> DataFrame:
    """Overlapping analysis frames from PCM chunks (file_id, chunk, samples array<smallint>) of equal length.

    A frame spans a bounded number of chunks, so samples are regrouped per frame and no task holds a whole track.
    """
    size = pcm.groupBy("file_id").agg(F.max(F.size("samples")).alias("len"), F.max("chunk").alias("last"))
    total = pcm.groupBy("file_id").agg(F.sum(F.size("samples")).alias("total"))
    p = (pcm.join(size, "file_id").join(total, "file_id").withColumn("start", F.col("chunk") * F.col("len"))
         .withColumn("end", F.col("start") + F.size("samples")))
    lo = F.greatest(F.lit(0), F.ceil((F.col("start") - AUDIO_FRAME + 1) / F.lit(AUDIO_HOP))).cast("bigint")
    hi = F.least(F.floor((F.col("end") - 1) / F.lit(AUDIO_HOP)),
                 F.floor((F.col("total") - AUDIO_FRAME) / F.lit(AUDIO_HOP))).cast("bigint")
    p = p.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    e = p.withColumn("frame", F.explode(F.sequence("lo", "hi"))).withColumn("at", F.col("frame") * AUDIO_HOP)
    first = F.greatest(F.col("at") - F.col("start"), F.lit(0)).cast("int")
    last = F.least(F.col("at") + AUDIO_FRAME - F.col("start"), F.size("samples").cast("bigint")).cast("int")
    e = e.withColumn("piece", F.slice("samples", first + 1, last - first))
    g = e.groupBy("file_id", "frame").agg(F.sort_array(F.collect_list(F.struct("chunk", "piece"))).alias("p"))
    return g.select("file_id", "frame", F.flatten(F.transform("p", lambda x: x["piece"])).alias("samples"))


def audio_fingerprint(pcm: DataFrame) -> DataFrame:
    """(file_id, words): one 32-bit word per second, by per-bit majority over the second's frames."""
    chroma_schema = "file_id bigint, frame bigint, " + ", ".join(f"c{i} double" for i in range(12))

    chroma = audio_frames(pcm).mapInArrow(frame_energies, chroma_schema)
    # five-tap smoothing: every frame is sent to the five outputs it contributes to (oldest weight first)
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(FIR_WEIGHTS)]))
    spread = chroma.withColumn("t", taps).withColumn("out", F.col("frame") + 4 - F.col("t.k"))
    smooth = (spread.groupBy("file_id", "out").agg(
        F.count("*").alias("n"), *[(F.sum(F.col(f"c{i}") * F.col("t.w")) / FIR_NORM).alias(f"c{i}") for i in range(12)])
              .where("n = 5"))
    energy = sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(12)), F.lit(0.0))
    bits = []
    for b, (x, y) in enumerate(CHROMA_PAIRS):
        bits.append(F.when((F.col("e") >= 1e-10) & (F.col(f"c{x}") > F.col(f"c{y}")), 1).otherwise(0).alias(f"b{b}"))
    second = F.floor(F.col("out") * AUDIO_HOP / F.lit(float(AUDIO_RATE))).cast("int").alias("second")
    voted = (smooth.withColumn("e", energy).select("file_id", second, *bits).groupBy("file_id", "second")
             .agg(F.count("*").alias("n"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(32)]))
    word = sum((F.when(F.col(f"b{b}") >= F.floor(F.col("n") / 2) + 1, F.lit(1 << b).cast("bigint")).otherwise(
        F.lit(0).cast("bigint")) for b in range(32)), F.lit(0).cast("bigint"))
    signed = F.when(F.col("w") >= 2**31, F.col("w") - 2**32).otherwise(F.col("w")).cast("int")
    words = voted.withColumn("w", word).select("file_id", "second", signed.alias("word"))
    # one word per second of one file; a track without a whole second of frames has none
    found = words.groupBy("file_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("second", "word"))), lambda x: x["word"]).alias("words"))
    return (pcm.select("file_id").distinct().join(found, "file_id", "left")
            .withColumn("words", F.coalesce("words", F.array().cast("array<int>"))))


def fingerprint_status(media: DataFrame, audio: DataFrame) -> DataFrame:
    """Update audio flags: failed (null) -> error, empty -> no track, all zero -> silent; silent words are cleared."""
    j = media.join(audio.withColumn("__done", F.lit(True)), "file_id", "left")
    silent = (F.size("words") > 0) & F.forall("words", lambda x: x == 0)
    bit = (F.when(F.col("__done").isNull(), 0).when(F.col("words").isNull(), int(EntryFlag.AUDIO_FINGERPRINT_ERROR))
           .when(F.size("words") == 0, int(EntryFlag.NO_AUDIO_TRACK)).when(silent, int(EntryFlag.SILENT_AUDIO_TRACK))
           .otherwise(0))
    return (j.withColumn("flags", F.col("flags").bitwiseOR(bit))
            .withColumn("words", F.when(silent, F.lit(None)).otherwise(F.col("words"))).drop("__done"))


def word_sum(size: int, head: bytes, tail: bytes) -> str:
    """Size plus the 64-bit words of both ends, modulo 2 to the 64, in hex."""
    total = sum(int(np.frombuffer(part, "<u8").sum(dtype=np.uint64)) for part in (head, tail)) + size
    return f"{total % 2**64:016x}"


@F.pandas_udf(T.StringType())
def _content_key(size: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
    return pd.Series([word_sum(int(n), h, t) if n >= 65536 else None for n, h, t in zip(size, head, tail)], dtype=object)


def content_keys(files: DataFrame) -> DataFrame:
    """(path, size, content_key) from a binaryFile read: size plus the 64-bit words of the first and last 64 KiB."""
    head = F.substring("content", 1, 65536)
    tail = F.substring("content", F.greatest(F.col("length") - 65535, F.lit(1)).cast("int"), F.lit(65536))
    return files.select("path", F.col("length").alias("size"), _content_key("length", head, tail).alias("content_key"))


#: Bytes read at each end of a file.
KEY_BYTES = 65536


def head_and_tail(file, size: int) -> tuple[bytes, bytes]:
    """The first and the last 64 KiB of an open file, one ranged read each."""
    head = file.read_at(KEY_BYTES, 0)
    return head, (head if size == KEY_BYTES else file.read_at(KEY_BYTES, size - KEY_BYTES))


def _file_system(path: str, known: dict):
    """(file system, path in it); file systems are opened once per task."""
    from pyarrow import fs
    scheme, cut, rest = path.partition("://")
    if not cut or scheme == "file":
        if "file" not in known:
            known["file"] = fs.LocalFileSystem()
        return known["file"], "/" + path.removeprefix("file:").lstrip("/")
    host, _, inner = rest.partition("/")
    if (scheme, host) not in known:
        known[scheme, host] = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    system, base = known[scheme, host]
    return system, f"{base.rstrip('/')}/{inner}" if base else inner


def ranged_content_keys(files: DataFrame) -> DataFrame:
    """(path, size, content_key) of (path, size) rows. Tasks read 128 KiB of a file whatever its size.

    The key is null for files below 64 KiB, with a null size, and for files that are gone or may not be read.
    """
    def run(batches):
        known: dict = {}
        for pdf in batches:
            keys = []
            for path, size in zip(pdf["path"], pdf["size"]):
                if path is None or pd.isna(size) or size < KEY_BYTES:
                    keys.append(None)
                    continue
                system, inner = _file_system(path, known)
                try:
                    with system.open_input_file(inner) as file:
                        head, tail = head_and_tail(file, int(size))
                except (FileNotFoundError, PermissionError):
                    head = tail = b""
                whole = len(head) == len(tail) == KEY_BYTES
                keys.append(word_sum(int(size), head, tail) if whole else None)
            yield pdf.assign(content_key=pd.Series(keys, index=pdf.index, dtype=object))

    return files.select("path", F.col("size").cast("bigint").alias("size")).mapInPandas(run, "path string, size bigint, content_key string")


# --- embeddings ---------------------------------------------------------------------------------------------------

def embed_frames(frames: DataFrame, model_fn: Callable[[], Callable[[list[bytes]], np.ndarray]], frame: str = "rgb",
                 keys: tuple[str, ...] = ("file_id", "pos")) -> DataFrame:
    """Batched inference with a user model: ``model_fn()`` builds a callable from frames to an (n, d) array once per
    task; vectors are L2 normalised and quantised to signed bytes."""
    schema = ", ".join(f"{k} {dict(frames.dtypes)[k]}" for k in keys) + ", vec array<tinyint>"

    def run(batches):
        model = model_fn()
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.asarray(model(list(pdf[frame])), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            q = np.clip(np.rint(v / np.where(norm > 0, norm, 1) * 127), -127, 127).astype(np.int8)
            out = pdf[list(keys)].copy()
            out["vec"] = list(q)
            yield out

    return frames.select(*keys, frame).mapInPandas(run, schema)


def missing_from_cache(media: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, size, modified) has no cached feature."""
    return media.join(cache.select("path", "size", "modified").distinct(), ["path", "size", "modified"], "left_anti")


def with_cache(media: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reuse valid cached features and compute the rest."""
    valid = cache.join(media.select("path", "size", "modified"), ["path", "size", "modified"], "left_semi")
    return valid.unionByName(compute(missing_from_cache(media, cache)).select(*cache.columns))


def detail_scores(frames: DataFrame, limit: int = 12) -> DataFrame:
    """(file_id, detail): median neighbour difference over the first frames of each file by time.

    ``limit`` is part of the measure, not a shortcut.
    """
    from .ranking import top_per_group
    usable = frames.where("gray is not null")
    scored = top_per_group(usable.select("file_id", "sec", K.frame_detail("gray").alias("d")), "file_id", [F.col("sec")], limit)
    return scored.groupBy("file_id").agg(
        F.coalesce(F.expr("percentile(d, 0.5) filter (where d > 0)"), F.lit(0.0)).alias("detail"))
