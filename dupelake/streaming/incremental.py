"""Incremental refresh and matching with ``foreachBatch`` over bucketed catalog versions.

Every batch reads what it has to judge and rewrites the touched buckets only. A batch that is replayed finds its rows
already there and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..functions.paths import folder_of
from ..operators.grouping import cluster, connected_components
from ..operators.maintenance import refresh
from ..operators.scoring import SNAPSHOT_COLUMNS, class_key, collapse_copies, matching_pairs
from ..plans.skew import cut_lineage
from ..sources.catalog import read_catalog, update_catalog


# --- refresh ------------------------------------------------------------------------------------------------------

def refresh_batch(root: str, schema: str | None = None, buckets: int = 64, whole_folders: bool = False) -> Callable[[DataFrame, int], None]:
    """Batch function of :func:`stream_refresh`.

    A drop names new and changed files; a row with a true ``gone`` says that its path has vanished. With
    ``whole_folders`` a drop lists every folder it mentions completely, so catalog rows of these folders that it does
    not name have vanished too. Vanished rows stay in the catalog with ``vanished`` set, and a new path with the same
    size and content key takes them over, features included, in the same drop or a later one. What happened to which
    file is written under ``<root>/changes``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "gone" not in batch.columns:
            batch = batch.withColumn("gone", F.lit(False))
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "modified").alias("r"), F.any_value("gone").alias("g"))
        latest = cut_lineage(latest.select("path", *[F.coalesce(F.col(f"r.{c}"), F.col("g")).alias(c) if c == "gone" else F.col(f"r.{c}").alias(c)
                                                    for c in batch.columns if c != "path"]))
        if latest.isEmpty():
            return
        listing = latest.where(~F.coalesce("gone", F.lit(False))).drop("gone")
        catalog = read_catalog(spark, root, schema=schema)
        if "vanished" not in catalog.columns:
            catalog = catalog.withColumn("vanished", F.lit(False))
        named = latest.select("path", F.lit(True).alias("__named"))
        judged = catalog.join(named, "path", "left").withColumn("__in", F.col("__named") | F.col("vanished"))
        if whole_folders:
            folders = listing.select(folder_of("path").alias("__folder")).distinct().withColumn("__listed", F.lit(True))
            judged = (judged.withColumn("__folder", folder_of("path")).join(folders, "__folder", "left")
                      .withColumn("__in", F.col("__in") | F.col("__listed")))
        scope = cut_lineage(judged.where("__in").select(*catalog.columns))
        was = scope.select("path", F.col("vanished").alias("__was"))
        full = refresh(scope, listing).withColumn("vanished", F.col("change") == "missing").join(was, "path", "left")
        same = (F.col("change").isin("kept", "missing")) & (F.col("vanished") == F.col("__was"))
        changed = cut_lineage(full.where(~F.coalesce(same, F.lit(False))))
        changed.select("file_id", "path", "change", "keep_features").write.mode("ignore").parquet(f"{root}/changes/batch={batch_id}")
        # the row of a moved file leaves its old path
        left = scope.select("path", "file_id").join(changed.where("change = 'relinked'").select("file_id"), "file_id", "left_semi").select("path")
        update_catalog(root, changed.select(*catalog.columns), cut_lineage(left), "path", buckets)

    return apply


def stream_refresh(drops: DataFrame, root: str, checkpoint: str, schema: str | None = None, buckets: int = 64,
                   whole_folders: bool = False) -> StreamingQuery:
    """Apply listing drops (a streaming DataFrame) to the catalog under ``root``."""
    return (drops.writeStream.foreachBatch(refresh_batch(root, schema, buckets, whole_folders))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- matching -----------------------------------------------------------------------------------------------------

def match_new(new: DataFrame, known: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Matching pairs that involve at least one new file: (a, b, diff, flags, plain) over file ids.

    Copies are folded over both sides together. A class that a new file now represents meets everything; every member
    of a class with a new member is one edge to its representative, so a copy that sorts before a known file is linked
    with it all the same.
    """
    fresh = new.select("file_id").withColumn("__new", F.lit(True))
    everything = known.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)
    reps, members = collapse_copies(everything, cfg)
    reps = reps.join(fresh, "file_id", "left").withColumn("is_new", F.coalesce("__new", F.lit(False))).drop("__new")
    pairs = matching_pairs(cut_lineage(reps), cfg)
    grown = members.join(fresh, "file_id", "left_semi").select("rep_id").distinct()
    copies = members.join(grown, "rep_id", "left_semi").where("file_id <> rep_id").select(
        F.col("rep_id").alias("a"), F.col("file_id").alias("b"), F.lit(0.0).cast("float").alias("diff"),
        F.lit(0).cast("smallint").alias("flags"), F.lit(True).alias("plain"))
    return pairs.unionByName(copies)


_FEATURES = ("file_id bigint, path string, folder string, size bigint, dev bigint, inode bigint, is_image boolean, duration_s double, gray binary, "
             "phash array<bigint>, vec binary, vec_ok array<boolean>, class_key string, rep_id bigint, component bigint")
_EDGES = "component bigint, a bigint, b bigint, diff float, flags smallint, plain boolean"
_GROUPS = "component bigint, group_id bigint, file_id bigint, path string, similarity float, flags smallint"


def matched_features(spark: SparkSession, root: str) -> DataFrame:
    """Snapshot rows with their class, its representative and their component (the least representative in it)."""
    return read_catalog(spark, f"{root}/features", schema=_FEATURES)


def matched_edges(spark: SparkSession, root: str) -> DataFrame:
    """Matching pairs of representatives."""
    return read_catalog(spark, f"{root}/edges", schema=_EDGES)


def matched_groups(spark: SparkSession, root: str) -> DataFrame:
    """Duplicate groups."""
    return read_catalog(spark, f"{root}/groups", schema=_GROUPS)


def match_batch(root: str, cfg: ScanConfig, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch function of :func:`stream_match`: the state afterwards equals one match of all rows so far.

    A class counts as new if its representative arrived in the batch or did not represent it before; only block
    meetings with such a class are scored. Components that lost or gained an edge or a member are clustered again,
    all others keep their groups and are not read beyond their labels.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*SNAPSHOT_COLUMNS).groupBy("file_id").agg(F.max(F.struct("path", *[c for c in SNAPSHOT_COLUMNS if c not in ("file_id", "path")])).alias("r"))
        new = cut_lineage(new.select("file_id", "r.*").withColumn("class_key", class_key(cfg)))
        if new.isEmpty():
            return
        stored = matched_features(spark, root)
        prior = cut_lineage(stored.select("file_id", F.col("path").alias("__path"), F.col("class_key").alias("__class"), F.col("rep_id").alias("__rep"),
                                          F.col("component").alias("__component")))
        same = prior.join(new, (prior["file_id"] == new["file_id"]) & (F.col("__class") == F.col("class_key")) & (F.col("__path") == F.col("path")), "left_semi")
        new = cut_lineage(new.join(same.select("file_id"), "file_id", "left_anti"))  # a replayed row is no news
        if new.isEmpty():
            return
        known = stored.select(*new.columns).join(new.select("file_id"), "file_id", "left_anti")
        arrived = new.select("file_id", F.lit(True).alias("__new"))
        reps, members = collapse_copies(known.unionByName(new), cfg)
        stood = F.col("__new").isNull() & (F.col("__rep") == F.col("file_id"))
        reps = cut_lineage(reps.join(arrived, "file_id", "left").join(prior.drop("__path", "__class"), "file_id", "left")
                           .withColumn("is_new", ~F.coalesce(stood, F.lit(False))))
        members = cut_lineage(members)
        found = cut_lineage(matching_pairs(reps.drop("__new", "__rep", "__component"), cfg))
        steady = reps.where("not is_new").select("file_id")
        old = matched_edges(spark, root)
        alive = old.join(steady.select(F.col("file_id").alias("a")), "a", "left_semi").join(steady.select(F.col("file_id").alias("b")), "b", "left_semi")
        ends = found.select(F.col("a").alias("file_id")).unionByName(found.select(F.col("b").alias("file_id")))
        grown = members.join(arrived, "file_id", "left_semi").select(F.col("rep_id").alias("file_id"))
        moved = ends.unionByName(grown).unionByName(reps.where("is_new").select("file_id")).unionByName(new.select("file_id"))
        hit = cut_lineage(prior.join(moved.distinct(), "file_id", "left_semi").select(F.col("__component").alias("component"))
                          .unionByName(old.join(alive.select("a", "b"), ["a", "b"], "left_anti").select("component")).distinct())
        again = cut_lineage(reps.join(hit.withColumnRenamed("component", "__component").withColumn("__hit", F.lit(True)), "__component", "left")
                            .where(F.col("is_new") | F.col("__hit")))
        kept = cut_lineage(alive.join(again.select(F.col("file_id").alias("a")), "a", "left_semi"))
        edges = cut_lineage(kept.select(*found.columns).unionByName(found))
        label = connected_components(edges.select("a", "b"))
        place = cut_lineage(again.select("file_id").join(label, F.col("file_id") == F.col("node"), "left")
                            .select(F.col("file_id").alias("rep_id"), F.coalesce("component", "file_id").alias("component")))
        own = members.join(place.select("rep_id"), "rep_id", "left_semi")
        # labels of a batch that broke off before its last write go as well
        void = cut_lineage(hit.unionByName(kept.select("component")).unionByName(place.select("component")).distinct())
        groups = cluster(again.drop("__new", "__rep", "__component", "__hit", "is_new"), own, edges, cfg, label)
        of_file = own.join(place, "rep_id").select("file_id", "rep_id", "component")
        groups = groups.join(of_file.select("file_id", "component"), "file_id")
        labelled = edges.join(place.select(F.col("rep_id").alias("a"), "component"), "a")
        placed = of_file.join(prior, "file_id", "left").where(~F.coalesce((F.col("__rep") == F.col("rep_id")) & (F.col("__component") == F.col("component")), F.lit(False)))
        placed = placed.select("file_id", "rep_id", "component").unionByName(
            of_file.join(arrived, "file_id", "left_semi")).distinct()
        rows = known.unionByName(new).join(placed, "file_id")
        cols = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
        update_catalog(f"{root}/edges", cut_lineage(labelled.select(*cols(_EDGES))), void, "component", buckets)
        update_catalog(f"{root}/groups", cut_lineage(groups.select(*cols(_GROUPS))), void, "component", buckets)
        # last: a batch that broke off before is found new again
        update_catalog(f"{root}/features", cut_lineage(rows.select(*cols(_FEATURES))), placed, "file_id", buckets)

    return apply


def stream_match(snapshots: DataFrame, root: str, checkpoint: str, cfg: ScanConfig, buckets: int = 64) -> StreamingQuery:
    """Match drops of snapshot rows with each other and with all earlier ones; the state is under ``root``."""
    return (snapshots.writeStream.foreachBatch(match_batch(root, cfg, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
