"""Log, progress and incremental queries over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import ScanConfig
from ..operators.scoring import compare_snapshot
from ..plans.skew import ensure_checkpoint_dir
from ..sources.catalog import read_catalog
from ..streaming import incremental as IN, monitor as MO
from . import query
from .catalog import C, N, _catalog, _listing, _MOVES
from .derive import table
from .matching import _E, _SAD, vector_media

_LOG = """(SELECT event_id, ts, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS severity, event_type || ' of user ' || CAST(user_id % 7 AS VARCHAR) || ' ' || props AS message,
 event_type = 'signup' AND user_id % 10 = 0 AS is_session_start FROM events)"""


def _log(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.when(t == "error", 2).when(t == "purchase", 1).otherwise(0).alias("severity"),
        F.concat("event_type", F.lit(" of user "), (F.col("user_id") % 7).cast("string"), F.lit(" "), "props").alias("message"),
        ((t == "signup") & (F.col("user_id") % 10 == 0)).alias("is_session_start"))


@query(f"SELECT event_id, CAST(sum(CASE WHEN is_session_start THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM {_LOG}")
def log_sessions(spark, sf):
    return MO.log_sessions(_log(spark, sf), ["ts", "event_id"]).select("event_id", "session")


def _collapse(where: str = "", having: str = "") -> str:
    return f"""WITH l AS (SELECT *, CAST(sum(CASE WHEN is_session_start THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM {_LOG})
SELECT session, severity, regexp_replace(regexp_replace(message, '"[^"]*"', '"*"', 'g'), '[0-9]+', '#', 'g') AS message_key, count(*) AS occurrences FROM l
 WHERE NOT is_session_start {where} GROUP BY 1, 2, 3 {having}"""


@query(_collapse())
def collapsed_log(spark, sf):
    return MO.collapse_log(MO.log_sessions(_log(spark, sf), ["ts", "event_id"])).select("session", "severity", "message_key", "occurrences")


@query(_collapse("AND severity = 2", "HAVING bool_or(contains(lower(message), 'user 3 '))"))
def searched_log(spark, sf):
    return MO.collapse_log(MO.log_sessions(_log(spark, sf), ["ts", "event_id"]), severity=2, search="USER 3 ").select(
        "session", "severity", "message_key", "occurrences")


_PROG = "(SELECT 'vol' || CAST(user_id % 12 AS VARCHAR) AS volume, CAST(round(value * 100) AS BIGINT) AS size, event_type IN ('view', 'click') AS done, ts FROM events)"


def _progress(df):
    return df.select(F.concat(F.lit("vol"), (F.col("user_id") % 12).cast("string")).alias("volume"), F.round(F.col("value") * 100).cast("bigint").alias("size"),
                     F.col("event_type").isin("view", "click").alias("done"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"""SELECT volume, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (done) AS done_files, CAST(sum(CASE WHEN done THEN size ELSE 0 END) AS BIGINT) AS done_bytes,
 round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 * (count(*) - count(*) FILTER (done)) / count(*) FILTER (done), 2) AS remaining_s FROM {_PROG} GROUP BY 1""")
def volume_progress(spark, sf):
    return MO.volume_progress(_progress(table(spark, sf, "events"))).withColumn("remaining_s", F.round("remaining_s", 2))


def _stream(spark, sf, name):
    """The table as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _folder(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir() + "/stream-" + uuid.uuid4().hex


@query(f"""SELECT volume, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (done) AS done_files,
 CAST(sum(CASE WHEN done THEN size ELSE 0 END) AS BIGINT) AS done_bytes FROM {_PROG} GROUP BY 1""")
def streamed_volume_progress(spark, sf):
    """Stateful stream in complete mode; every trigger rewrites the small progress table."""
    root = _folder(spark)
    out = MO.volume_progress(_progress(_stream(spark, sf, "events")))
    q = (out.writeStream.outputMode("complete").option("checkpointLocation", root + "/state")
         .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(root + "/table")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(root + "/table").drop("remaining_s")


@query("""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS path, ts FROM events WHERE event_type = 'click'), e AS (SELECT CAST(user_id AS VARCHAR) AS path, ts FROM events WHERE event_type = 'view'),
 w AS (SELECT max(ts) - INTERVAL 30 MINUTE AS wm FROM events WHERE event_type IN ('click', 'view'))
SELECT path, epoch_us(ts) AS begin_us, 4 AS flag FROM b, w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.path = b.path AND e.ts >= b.ts AND e.ts <= b.ts + INTERVAL 30 MINUTE)
 AND b.ts < w.wm - INTERVAL 30 MINUTE""")
def streamed_quarantine(spark, sf):
    """Stream-stream outer join: clicks that no view of the same user follows within half an hour."""
    root = _folder(spark)
    ev = _stream(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("sampling").alias("phase"), F.col("user_id").cast("string").alias("path"),
        F.when(F.col("event_type") == "click", "begin").otherwise("end").alias("event"))
    q = (MO.stream_quarantine(ev).writeStream.outputMode("append").format("parquet").option("path", root + "/table")
         .option("checkpointLocation", root + "/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(root + "/table").select("path", F.unix_micros("ts").alias("begin_us"), "flag")


def _dropped(spark, folder, parts):
    """A stream that delivers the given tables one after the other."""
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(f"""WITH {_MOVES}, c AS (SELECT coalesce(new_path, path) AS path, path AS first_path, size, created, modified, content_key, new_path IS NOT NULL AS moved FROM {C} LEFT JOIN mv ON old_path = path)
SELECT coalesce(c.path, l.path) AS path, c.first_path, l.path IS NULL AS vanished, coalesce(l.size, c.size) AS size, coalesce(l.created, c.created) AS created
 FROM c FULL JOIN {N} l ON c.path = l.path""")
def streamed_refresh(spark, sf):
    """Three drops: the catalog as first listing, half of the new listing with what is gone from it, the other half.

    ``first_path`` is the path under which a file came in; a moved file keeps its id, so it keeps the first path too.
    """
    root = _folder(spark)
    cols = ["path", "size", F.timestamp_seconds("created").alias("created"), F.timestamp_seconds("modified").alias("modified"), "content_key"]
    known, listed = (d.select(*cols, F.lit(False).alias("gone")) for d in (_catalog(spark, sf), _listing(spark, sf)))
    gone = known.join(listed.select("path"), "path", "left_anti").withColumn("gone", F.lit(True)).select(*known.columns)
    half = F.pmod(F.hash("path"), F.lit(2)) == 0
    drops = _dropped(spark, root + "/drops", [known, listed.where(half).unionByName(gone), listed.where(~half)])
    schema = "file_id long, path string, size long, created timestamp, modified timestamp, content_key string, vanished boolean"
    IN.stream_refresh(drops, root + "/catalog", root + "/state", schema).awaitTermination()
    first = spark.read.parquet(root + "/catalog/changes/batch=0").select("file_id", F.col("path").alias("first_path"))
    seconds = F.unix_seconds("created").alias("created")
    return (read_catalog(spark, root + "/catalog", schema=schema).join(first, "file_id", "left")
            .select("path", "first_path", "vanished", "size", seconds))


def vectors_with_copies(spark, sf, cfg):
    """Snapshot rows of every vector, and of a copy of every fifth one whose path sorts before all others."""
    media, frames = vector_media(spark, sf, True)
    rows = compare_snapshot(media, frames, cfg)
    again = rows.where("file_id % 5 = 0").withColumn("file_id", F.col("file_id") + 1000000).withColumn("path", F.concat(F.lit("!"), "path"))
    return rows.unionByName(again)


@query(f"""WITH e AS MATERIALIZED {_E}, f AS (SELECT vec_id AS file_id, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS path, label, q FROM e
 UNION ALL SELECT vec_id + 1000000, '!' || lpad(CAST(vec_id AS VARCHAR), 12, '0'), label, q FROM e WHERE vec_id % 5 = 0),
 r AS MATERIALIZED (SELECT label, q, arg_min(file_id, path) AS id, min(path) AS path FROM f GROUP BY ALL),
 p AS (SELECT a.id AS a, b.id AS b, {_SAD} / 262144.0 AS diff FROM r a JOIN r b ON a.path < b.path)
SELECT a, b, CAST(diff AS DOUBLE) AS diff FROM p WHERE diff <= 0.135""")
def streamed_matches(spark, sf):
    """Vectors and copies in three drops; a copy may come before or after its original and always represents both."""
    root, cfg = _folder(spark), ScanConfig(percent=86.5)
    rows = vectors_with_copies(spark, sf, cfg)
    drop = F.pmod(F.col("file_id"), F.lit(3))
    IN.stream_match(_dropped(spark, root + "/drops", [rows.where(drop == k) for k in range(3)]), root + "/state", root + "/progress", cfg).awaitTermination()
    return IN.matched_edges(spark, root + "/state").select("a", "b", F.col("diff").cast("double").alias("diff"))
