"""Catalog tables as versioned Parquet folders, JSON exchange and scrubbed diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions: folders whose write finished (the commit marker is the last file written)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    out = []
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v") and name[1:].isdigit() and fs.exists(
                hadoop.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[1:]))
    return sorted(out)


def write_catalog(df: DataFrame, root: str) -> str:
    """Write the next version; readers switch when its commit marker appears, an aborted write is never seen."""
    versions = _versions(df.sparkSession, root)
    path = f"{root}/v{(versions[-1] + 1 if versions else 1):08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_catalog(spark: SparkSession, root: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """Latest (or a given) committed version; an empty table when there is none."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema or S.MEDIA)
    df = spark.read.parquet(f"{root}/v{(version or versions[-1]):08d}")
    if df.columns != MANIFEST:
        return df
    return _read_buckets(spark, [r.location for r in df.collect()], schema)


MANIFEST = ["bucket", "of", "location"]


def _read_buckets(spark: SparkSession, locations: list[str], schema: str | None) -> DataFrame:
    if not locations:
        return spark.createDataFrame([], schema or S.MEDIA)
    return spark.read.parquet(*sorted(locations))


def update_catalog(root: str, added: DataFrame, replaced: DataFrame, key: str, buckets: int = 64) -> None:
    """Next version of a table bucketed by the hash of ``key``: rows whose key is in ``replaced`` go, ``added`` come.

    Only the buckets that hold a changed key are read and written; a version is a manifest of one row per bucket that
    names the folder each bucket was last written to, and counts from the moment its commit marker is there. ``buckets``
    is settled by the first version. Both relations should be materialised by the caller.
    """
    spark = added.sparkSession
    versions = _versions(spark, root)
    at: dict[int, str] = {}
    if versions:
        for r in spark.read.parquet(f"{root}/v{versions[-1]:08d}").collect():  # one row per bucket
            at[r.bucket], buckets = r.location, r.of
    number = versions[-1] + 1 if versions else 1
    own = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    changed = replaced.select(key).unionByName(added.select(key))
    touched = [r[0] for r in changed.select(own.alias("b")).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    rows = added
    old = [at.pop(b) for b in touched if b in at]
    if old:
        rows = _read_buckets(spark, old, None).join(changed.where(F.col(key).isNotNull()).distinct(), key, "left_anti").unionByName(added.select(*added.columns), allowMissingColumns=True)
    folder = f"{root}/data/{number:08d}"
    rows.withColumn("__bucket", own).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
    written = [r[0] for r in spark.read.option("basePath", folder).parquet(folder).select("__bucket").distinct().collect()] if not rows.isEmpty() else []
    at.update({b: f"{folder}/__bucket={b}" for b in written})
    manifest = spark.createDataFrame([(b, buckets, p) for b, p in sorted(at.items())], "bucket int, of int, location string")
    manifest.select(*MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/v{number:08d}")


def catalog_to_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    if pretty:
        df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def catalog_from_json(spark: SparkSession, path: str, schema: str = S.MEDIA) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "false").json(path)


def scrubbed_frames(media: DataFrame, frames: DataFrame) -> DataFrame:
    """Path-free diagnostic rows: an opaque id, dimensions, duration, flags and frames ordered by second.

    Frames per file are bounded by the sample count.
    """
    shots = frames.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(
        "sec", F.base64("gray").alias("gray"), "phash"))).alias("frames"))
    dims = [F.col(c) for c in ("w", "h") if c in media.columns]
    return media.join(shots, "file_id").select(
        F.sha2(F.col("file_id").cast("string"), 256).substr(1, 16).alias("id"), *dims, "duration_s", "flags", "frames")


def export_scrubbed_frames(media: DataFrame, frames: DataFrame, path: str) -> None:
    scrubbed_frames(media, frames).write.mode("overwrite").json(path)
