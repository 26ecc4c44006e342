"""Other places a change set can go: partitioned files, row-level catalogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.operators.apply import partition_rows, touched_partitions
from tablesync.operators.diff import DELETE, OP, UPDATE, values_differ
from tablesync.operators.keys import key_condition, right_side
from tablesync.sources import files

#: What one task writes of a partition at most, about.
SHARE_ROWS, SHARE_BYTES = 500_000, 64 << 20


def overwrite_partitions(
    path: str,
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    work: str,
) -> int:
    """Rewrite only the partitions of ``path`` that hold changed rows.

    ``target`` has to be read from the files of ``path`` as they are: the new
    contents are written to the folder ``work`` first, and emptied partitions are
    found by the files they are in. Publishing is per partition, not all at once; use
    a snapshot table where readers must never see a mixture. Returns the
    number of partitions touched.
    """
    spark = target.sparkSession
    changes = without_broadcast(changes, keys)
    touched_partitions(target, changes, keys, partition_by).write.parquet(f"{work}/touched")
    touched = spark.read.parquet(f"{work}/touched")
    partition_rows(target, changes, touched, keys, partition_by).write.parquet(f"{work}/rows")
    rows = spark.read.parquet(f"{work}/rows")
    # A folder's name is not its value: NULL and special characters are written in another form.
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder")
    named = target.select(*[F.col(f"`{p}`") for p in partition_by], folder).distinct()
    named.join(right_side(touched.select(*partition_by)), key_condition(partition_by), "left_semi").write.parquet(f"{work}/folders")
    folders = spark.read.parquet(f"{work}/folders")
    # Small partitions become one file each; a large one is split over several tasks, however small its values are stored.
    (
        shared_out(rows, keys, partition_by, files.size(spark, f"{work}/rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    filled = right_side(rows, partition_by).distinct()
    emptied = touched.join(filled, key_condition(partition_by), "left_anti")
    gone = folders.join(right_side(emptied.select(*partition_by)), key_condition(partition_by), "left_semi")
    for row in gone.select("_folder").distinct().toLocalIterator():
        files.delete_uri(spark, row["_folder"])
    return touched.count()


def without_broadcast(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes whose keys are joined by sorting, if they are too large for a broadcast as rows; files may hold them in far less."""
    spark = changes.sparkSession
    moved = changes.filter(F.col(OP).isin(UPDATE, DELETE)).select(*keys)
    size = moved.count() * (8 + int(moved._jdf.schema().defaultSize()))
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return changes.hint("merge") if size > threshold else changes


def shared_out(rows: DataFrame, keys: Sequence[str], partition_by: Sequence[str], size: int) -> DataFrame:
    """Stored rows of ``size`` bytes by partition, large ones in shares of :data:`SHARE_ROWS` rows or :data:`SHARE_BYTES` bytes.

    A writer sorts the rows of its task by partition; what it sorts is bounded by rows, as stored bytes say little about them.
    """
    n = rows.count()
    most = max(1, min(SHARE_ROWS, SHARE_BYTES * n // max(size, 1)))
    counts = right_side(rows.groupBy(*partition_by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_shares")))
    dealt = rows.join(counts, key_condition(partition_by), "inner")
    share = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.col("_r__shares"))
    by = [F.col(f"`{p}`") for p in partition_by]
    dealt = dealt.select(*[F.col(f"`{c}`") for c in rows.columns], share.alias("_share"))
    return dealt.repartition(max(1, -(-n // most)), *by, "_share").drop("_share")


def merge_into(
    table: str,
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    deletion: bool = False,
) -> None:
    """Update, insert and delete in a catalog table that supports row-level changes.

    The catalog writes only differing rows and commits once. ``target`` is the
    table's DataFrame, used for its column types.
    """
    mapped = staged.columns
    compared = [c for c in mapped if c not in keys]
    new = staged.alias("s")
    old = lambda name: F.col(f"{table}.`{name}`")
    fresh = lambda name: F.col(f"s.`{name}`")
    condition = reduce(and_, (old(k).eqNullSafe(fresh(k)) for k in keys))
    differ = F.lit(False)
    for name in compared:
        differ = differ | values_differ(old(name), fresh(name), target.schema[name].dataType)
    merge = new.mergeInto(table, condition)
    if compared:
        merge = merge.whenMatched(differ).update({c: fresh(c) for c in compared})
    merge = merge.whenNotMatched().insert({c: fresh(c) for c in mapped})
    if deletion:
        merge = merge.whenNotMatchedBySource().delete()
    merge.merge()
