"""Monitoring streams: unfinished attempts, per-volume progress, collapsed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import EntryFlag
from ..functions.formats import normalize_message
from ..plans.skew import running_all


def stream_quarantine(attempts: DataFrame, timeout: str = "30 minutes") -> DataFrame:
    """Attempts that began and did not end within the timeout: (phase, path, ts, flag).

    A stream-stream outer join; the watermark releases a begin row once no end can still arrive. Events later than
    the watermark are dropped.
    """
    base = attempts.withWatermark("ts", timeout)
    b = base.where("event = 'begin'").select("phase", "path", F.col("ts").alias("begin_ts")).alias("b")
    e = base.where("event = 'end'").select(F.col("phase").alias("e_phase"), F.col("path").alias("e_path"),
                                           F.col("ts").alias("end_ts")).alias("e")
    j = b.join(e, (F.col("phase") == F.col("e_phase")) & (F.col("path") == F.col("e_path"))
               & (F.col("end_ts") >= F.col("begin_ts"))
               & (F.col("end_ts") <= F.col("begin_ts") + F.expr(f"interval {timeout}")), "left_outer")
    flag = F.when(F.col("phase") == "audio", int(EntryFlag.AUDIO_FINGERPRINT_ERROR)).otherwise(int(EntryFlag.THUMBNAIL_ERROR))
    return j.where("end_ts is null").select("phase", "path", F.col("begin_ts").alias("ts"), flag.alias("flag"))


def volume_progress(events: DataFrame) -> DataFrame:
    """Per volume: done and total files and bytes and the remaining seconds (elapsed * left / done).

    Works on a stream (complete or update mode) and on a table. ``events``: volume, size, done boolean, ts.
    """
    g = events.groupBy("volume").agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_bytes"), F.count_if("done").alias("done_files"),
        F.sum(F.when(F.col("done"), F.col("size")).otherwise(0)).alias("done_bytes"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    elapsed = F.col("t1").cast("double") - F.col("t0").cast("double")
    left = F.col("total_files") - F.col("done_files")
    return g.select("volume", "total_files", "total_bytes", "done_files", "done_bytes",
                    F.when(F.col("done_files") > 0, elapsed * left / F.col("done_files")).alias("remaining_s"))


def log_sessions(log: DataFrame, order: list[str]) -> DataFrame:
    """Number the sessions of a log: 0 before the first marker, then one per marker row."""
    return running_all(log, [F.col(o) for o in order], F.col("is_session_start").cast("bigint"), "session")


def collapse_log(log: DataFrame, session: str = "session", severity: int | None = None, search: str | None = None) -> DataFrame:
    """Equal normalised messages of a session fold into one row with a count; a search keeps whole groups.

    Stream form: give events that already carry their session id.
    """
    df = log.where(~F.col("is_session_start"))
    if severity is not None:
        df = df.where(F.col("severity") == severity)
    hit = F.contains(F.lower("message"), F.lit((search or "").lower()))
    g = df.groupBy(session, "severity", normalize_message("message").alias("message_key")).agg(
        F.count("*").alias("occurrences"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("message", "ts").alias("first_message"), F.bool_or(hit).alias("__hit"))
    return g.where("__hit").drop("__hit")


def log_view(log: DataFrame, order: list[str], severity: int | None = None, search: str | None = None) -> DataFrame:
    """Newest session first, chronological inside."""
    return collapse_log(log_sessions(log, order), "session", severity, search).orderBy(
        F.col("session").desc(), "first_ts", "message_key")
