"""Group-wise building blocks that stay whole when one group holds a large share of the rows.

* aggregates are combined map-side and joined back, never windowed over a whole group;
* "first row per group" is a ``min_by`` aggregate;
* ranks and running totals split hot groups over range partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Above this many rows a group no longer goes through a single window partition.
HOT_ROWS_CONF = "spark.dupelake.hotGroupRows"
HOT_ROWS_DEFAULT = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a folder of its own only for a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex}")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """``cut_lineage`` through files, for loops: size estimates outlive a checkpoint and multiply with every join, files show their real size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store_alone(df: DataFrame) -> DataFrame:
    """``store`` for a frame that nothing else reads: the shuffle files behind it are gone afterwards (where Spark knows how)."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if before is None:
        return store(df)
    conf.set(_CLEANUP, "true")
    try:
        return store(df)
    finally:
        conf.set(_CLEANUP, before)


def _cols(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def attach_group(df: DataFrame, keys: str | Sequence[str], **aggs: Column) -> DataFrame:
    """Join per-group aggregates back to the rows (partial aggregation first, skew-splittable join after)."""
    keys = _cols(keys)
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    renamed = stats.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *aggs)
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = c if cond is None else cond & c
    return df.join(renamed, cond).drop(*[f"__k_{k}" for k in keys])


def first_per_group(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column],
                    columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each group in ``order`` as a map-side combined aggregate."""
    keys = _cols(keys)
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in columns]), F.struct(*order)).alias("__first"))
    return picked.select(*keys, *[F.col("__first")[c].alias(c) for c in columns])


def descending(column) -> Column:
    """Sort key that reverses a numeric, boolean or timestamp column inside a struct order."""
    c = F.col(column) if isinstance(column, str) else column
    return -c.cast("double")


def running_total(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], value: Column,
                  name: str, largest: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group; ``order`` must be total inside the group.

    ``largest`` is the size of the largest group, where the caller knows it.
    """
    keys = _cols(keys)
    spark = df.sparkSession
    limit = int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))
    if largest is None:
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(w))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    spread = cut_lineage(df.withColumn("__v", value)
                         .repartitionByRange(parts, *[F.col(k) for k in keys], *order)
                         .withColumn("__pid", F.spark_partition_id()))
    totals = spread.groupBy(*keys, "__pid").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*keys, "__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumn("__run", F.sum("__v").over(inside))
    return (local.join(offsets, [*keys, "__pid"])
            .withColumn(name, F.col("__run") + F.col("__off")).select(*df.columns, name))


def rank_within(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column], name: str, largest: int | None = None) -> DataFrame:
    """1-based row number inside each group; hot groups are spread over range partitions."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, largest)


def running_all(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Inclusive running sum over the whole table in ``order`` without a single-partition window."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = cut_lineage(df.withColumn("__v", value).repartitionByRange(parts, *order)
                         .withColumn("__pid", F.spark_partition_id()))
    totals = spread.groupBy("__pid").agg(F.sum("__v").alias("__t"))
    # one row per partition, so this window and the broadcast are bounded by the partition count
    offsets = totals.select("__pid", F.coalesce(F.sum("__t").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (spread.withColumn("__run", F.sum("__v").over(inside)).join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__run") + F.col("__off")).select(*df.columns, name))


def rank_all(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number over the whole table; ``order`` must be total."""
    return running_all(df, order, F.lit(1).cast("bigint"), name)


def hot_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame | None:
    """Keys of groups above the hot limit, or None when there are none."""
    keys = _cols(keys)
    limit = int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))
    hot = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    return hot if hot.limit(1).count() else None


class GroupPasses:
    """Repeated group aggregates on one table: windows for ordinary groups, aggregate-and-join for hot ones."""

    def __init__(self, keys: str | Sequence[str], hot: bool):
        self.keys, self.hot = _cols(keys), hot

    def add(self, df: DataFrame, **aggs: Column) -> DataFrame:
        if self.hot:
            return cut_lineage(attach_group(df, self.keys, **aggs))
        w = Window.partitionBy(*self.keys)
        return df.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])


def by_heat(df: DataFrame, keys: str | Sequence[str], step) -> DataFrame:
    """Run ``step(df, passes)`` on ordinary groups and, separately, on hot groups."""
    keys = _cols(keys)
    hot = hot_keys(df, keys)
    if hot is None:
        return step(df, GroupPasses(keys, False))
    hot = cut_lineage(hot)
    cold = step(df.join(hot, keys, "left_anti"), GroupPasses(keys, False))
    return cold.unionByName(step(cut_lineage(df.join(hot, keys, "left_semi")), GroupPasses(keys, True)))
