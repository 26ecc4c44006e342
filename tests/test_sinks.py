import os

import pytest
from pyspark.errors import PySparkException

from tablesync import SnapshotTable, SyncError
from tablesync.operators import diff as D
from tablesync.sources import sinks
from tablesync.sources.sinks import merge_into, overwrite_partitions


def test_only_touched_partitions_are_rewritten(spark, folder):
    stored = [(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, "c", 4), (5, "d", 5)]
    spark.createDataFrame(stored, "id int, p string, v int").write.partitionBy("p").parquet(f"{folder}/t")
    untouched = {f: os.path.getmtime(f"{folder}/t/p=d/{f}") for f in os.listdir(f"{folder}/t/p=d")}
    target = spark.read.parquet(f"{folder}/t")
    # 1 changes, 3 moves to another partition (emptying b), 4 goes (emptying c), 6 opens a new one.
    fresh = [(1, "a", 10), (2, "a", 2), (3, "a", 3), (5, "d", 5), (6, "e", 6)]
    staged = spark.createDataFrame(fresh, "id int, p string, v int").select("id", "v", "p")
    D.changes_of(D.classify(target, staged, ["id"], deletion=True)).write.parquet(f"{folder}/changes")
    changes = spark.read.parquet(f"{folder}/changes")
    touched = overwrite_partitions(f"{folder}/t", target, changes, ["id"], ["p"], f"{folder}/work")
    assert touched == 4
    found = spark.read.parquet(f"{folder}/t").select("id", "p", "v").collect()
    assert sorted(tuple(r) for r in found) == fresh
    assert sorted(d for d in os.listdir(f"{folder}/t") if d.startswith("p=")) == ["p=a", "p=d", "p=e"]
    assert {f: os.path.getmtime(f"{folder}/t/p=d/{f}") for f in os.listdir(f"{folder}/t/p=d")} == untouched


def test_a_large_partition_is_written_in_shares_however_small_it_is_stored(spark, folder, monkeypatch):
    monkeypatch.setattr(sinks, "SHARE_ROWS", 1000, raising=False)
    spark.range(20_000).selectExpr("id", "'a' as p", "1 as v").write.partitionBy("p").parquet(f"{folder}/t")
    target = spark.read.schema("id long, v int, p string").parquet(f"{folder}/t")
    staged = spark.range(20_003).selectExpr("id", "2 as v", "if(id < 20000, null, 'b') as p")
    D.changes_of(D.classify(target, staged, ["id"], deletion=True)).write.parquet(f"{folder}/changes")
    assert overwrite_partitions(f"{folder}/t", target, spark.read.parquet(f"{folder}/changes"), ["id"], ["p"], f"{folder}/work") == 3
    stored = spark.read.schema("id long, v int, p string").parquet(f"{folder}/t")
    assert stored.exceptAll(staged.select("id", "v", "p")).isEmpty() and stored.count() == 20_003
    assert len(os.listdir(f"{folder}/t/p=b")) == 2
    per_file = [r["n"] for r in stored.groupBy("_metadata.file_path").count().withColumnRenamed("count", "n").collect()]
    assert len(per_file) > 10 and max(per_file) < 6000


def test_keys_are_broadcast_by_their_rows_not_their_files(spark, folder):
    spark.range(1_000_000).selectExpr("id", f"'{D.UPDATE}' as {D.OP}").write.parquet(f"{folder}/c")
    changes, target = spark.read.parquet(f"{folder}/c"), spark.range(10)
    joined = lambda c: target.join(sinks.right_side(c, ["id"]), sinks.key_condition(["id"]), "left_semi")
    plan = lambda c: joined(c)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(sinks.without_broadcast(changes, ["id"]))
    assert "BroadcastHashJoin" in plan(sinks.without_broadcast(changes.filter("id < 10"), ["id"]))


def test_merge_needs_a_catalog_with_row_level_changes(spark, folder):
    target = spark.createDataFrame([(1, "a")], "id int, v string")
    target.write.mode("overwrite").option("path", f"{folder}/m").saveAsTable("merge_target")
    staged = spark.createDataFrame([(1, "b")], "id int, v string")
    with pytest.raises(PySparkException, match="MERGE"):
        merge_into("merge_target", spark.table("merge_target"), staged, ["id"], deletion=True)


@pytest.mark.parametrize("rows", [[(1,), (1,)], [(None,)]])
def test_initial_rows_have_to_respect_the_key(spark, folder, rows):
    df = spark.createDataFrame(rows, "id int")
    with pytest.raises(SyncError, match="repeat, or lack"):
        SnapshotTable.create(spark, f"{folder}/t", df.schema, ["id"], rows=df)


def test_bucketed_data_is_found_again_without_its_catalog_entry(spark, folder):
    df = spark.range(100).selectExpr("id", "id * 2 as v")
    table = SnapshotTable.create(spark, f"{folder}/t", df.schema, ["id"], 4, df)
    name = "tablesync_" + table.current().data.rsplit("/", 1)[-1]
    spark.sql(f"DROP TABLE {name}")
    found = SnapshotTable(spark, f"{folder}/t").read()
    assert found.count() == 100 and found.filter("id = 7").first()["v"] == 14
