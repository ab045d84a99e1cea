"""Media relations derived from the given tables. Each projection is plain SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Result rows: one duplicate group per order, one item per line.
ITEM_COLUMNS = {
    "group_id": "CAST(l_orderkey AS STRING)",
    "path": "'/vault/' || l_returnflag || '/s' || CAST(l_suppkey % 40 AS STRING) || '/d' || CAST(l_suppkey AS STRING) || "
            "'/o' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_p' || CAST(l_partkey AS STRING) "
            "|| '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) || '.mp4'",
    "folder": "'/vault/' || l_returnflag || '/s' || CAST(l_suppkey % 40 AS STRING) || '/d' || CAST(l_suppkey AS STRING)",
    "size": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "similarity": "CAST(90 + (l_linenumber % 3) * 5 AS DOUBLE)",
    "duration_s": "CAST(60 + (l_orderkey % 600) + (l_partkey % 3) AS DOUBLE)",
    "w": "CAST(640 + (l_partkey % 4) * 320 AS INT)",
    "h": "CAST(360 + (l_suppkey % 3) * 180 AS INT)",
    "frame_size_int": "CAST(1000 + (l_partkey % 4) * 320 + (l_suppkey % 3) * 180 AS INT)",
    "format": "CASE WHEN l_orderkey % 5 = 0 AND l_linenumber % 2 = 0 THEN 'hevc' ELSE 'h264' END",
    "audio_format": "'aac'",
    "audio_channel": "'stereo'",
    "audio_sample_rate": "CAST(44100 + (l_partkey % 2) * 3900 AS INT)",
    "audio_kbps": "CAST(128 + (l_suppkey % 3) * 64 AS BIGINT)",
    "kbps": "CAST(1000 + round(l_discount * 100) * 200 + round(l_tax * 100) * 20 AS BIGINT)",
    "fps": "CAST(l_quantity AS DOUBLE)",
    "hdr": "CASE WHEN l_orderkey % 7 = 0 AND l_linenumber % 3 = 0 THEN 'HDR10' ELSE '' END",
    "created": "CAST(l_shipdate AS TIMESTAMP)",
    "is_image": "l_orderkey % 11 = 0",
    "flags": "CAST(CASE l_orderkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 24 ELSE 0 END AS INT)",
    "clip_offset_s": "CAST(CASE WHEN l_orderkey % 9 = 0 THEN l_linenumber * 37 ELSE 0 END AS DOUBLE)",
    "checked": "l_linenumber = 1 AND l_orderkey % 3 = 0",
}
ITEMS_SQL = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in ITEM_COLUMNS.items()) + " FROM lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in ITEM_COLUMNS.items()])


#: Catalog rows: one file per page of the crawl.
MEDIA_COLUMNS = {
    "file_id": "page_id",
    "path": "replace(replace(url, 'https://', '/web/'), 'http://', '/web/') || '.p' || CAST(page_id AS STRING) || '.mp4'",
    "folder": "regexp_replace(replace(replace(url, 'https://', '/web/'), 'http://', '/web/'), '/[^/]*$', '')",
    "size": "CAST(length(html) * 4096 AS BIGINT)",
    "duration_s": "CAST(length(html) % 600 AS DOUBLE)",
    "is_image": "page_id % 4 = 0",
    "flags": "CAST(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 10 = 3 THEN 2 ELSE 0 END + CASE WHEN page_id % 15 = 7 THEN 4 "
             "ELSE 0 END + CASE WHEN page_id % 21 = 5 THEN 16 ELSE 0 END + CASE WHEN page_id % 17 = 2 THEN 64 ELSE 0 END AS INT)",
    "exists": "page_id % 6 <> 5",
}
MEDIA_SQL = "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in MEDIA_COLUMNS.items()) + " FROM pages)"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*[f"{e} AS `{n}`" for n, e in MEDIA_COLUMNS.items()])


#: Files with a duration and a folder, one per order.
ORDER_MEDIA_COLUMNS = {
    "file_id": "o_orderkey", "path": "'/o/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING)",
    "folder": "'/o/' || CAST(o_custkey AS STRING)", "duration_s": "CAST(o_totalprice / 100 AS DOUBLE)",
    "kind": "o_orderstatus", "is_image": "false",
}
ORDER_MEDIA_SQL = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in ORDER_MEDIA_COLUMNS.items()) + " FROM orders)"


def order_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in ORDER_MEDIA_COLUMNS.items()])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("embedding", F.expr("transform(embedding, x -> cast(x as double))"))


#: Catalog and listing split from the parts: some files kept, some re-dated, changed, moved, gone or new.
CATALOG_SQL = """(SELECT p_partkey AS file_id, '/m/' || p_brand || '/' || CAST(p_partkey AS STRING) || '.mkv' AS path,
 CAST(p_size * 1000 + p_partkey AS BIGINT) AS size, CAST(p_partkey % 100 AS BIGINT) AS created,
 CAST(p_partkey % 1000 AS BIGINT) AS modified, 'k' || CAST(p_partkey AS STRING) AS content_key, CAST(0 AS INT) AS flags,
 CAST(p_partkey % 900 AS DOUBLE) AS duration_s
 FROM part WHERE p_partkey % 10 <> 9)"""
LISTING_SQL = """(SELECT
 CASE WHEN p_partkey % 10 = 4 THEN '/moved/' || CAST(p_partkey AS STRING) || '.mkv'
      ELSE '/m/' || p_brand || '/' || CAST(p_partkey AS STRING) || '.mkv' END AS path,
 CAST(p_size * 1000 + p_partkey + CASE WHEN p_partkey % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS size,
 CAST(p_partkey % 100 + CASE WHEN p_partkey % 10 IN (1, 2) THEN 7 ELSE 0 END AS BIGINT) AS created,
 CAST(p_partkey % 1000 AS BIGINT) AS modified,
 CASE WHEN p_partkey % 10 = 2 THEN 'other' ELSE 'k' || CAST(p_partkey AS STRING) END AS content_key,
 CAST(p_partkey % 900 AS DOUBLE) AS duration_s
 FROM part WHERE p_partkey % 10 <> 5)"""


def from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run one of the shared projections over table views."""
    text = sql.strip()
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(f"v_{t}")
        text = text.replace(f"FROM {t}", f"FROM v_{t}")
    return spark.sql(text[1:-1])
