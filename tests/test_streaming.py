import os

import pytest
from pyspark.sql import types as T

from tablesync import LayerSpec, SnapshotTable, SyncError, TableSync
from tablesync.spec import SpecError
from tablesync.streaming import changed
from tablesync.streaming.incremental import incremental_pull, source_stream

SOURCE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("seq", T.IntegerType())])
TARGET = T.StructType(SOURCE.fields[:2])


def start(spark, folder):
    spec = LayerSpec(
        "layer", f"{folder}/source", "rows", "s", "t", allow_feature_deletion=True, on_duplicate_key="latest", order_by="seq"
    )
    sync = TableSync(spark, f"{folder}/tables", [spec])
    stored = spark.createDataFrame([(1, "a"), (9, "z")], TARGET)
    return sync, SnapshotTable.create(spark, f"{folder}/tables/s/t", TARGET, ["id"], rows=stored)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SOURCE).coalesce(1).write.mode("append").parquet(f"{folder}/source/rows")


def run(sync, folder):
    stream = source_stream(sync, "layer", SOURCE, max_files=1)
    incremental_pull(sync, "layer", stream, f"{folder}/progress").awaitTermination()


def contents(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_new_files_are_upserted_and_nothing_is_deleted(spark, folder):
    sync, table = start(spark, folder)
    arrive(spark, folder, [(1, "b", 1), (1, "c", 2), (2, "x", 1)])
    run(sync, folder)
    assert contents(table) == [(1, "c"), (2, "x"), (9, "z")]
    arrive(spark, folder, [(2, "y", 3)])
    arrive(spark, folder, [(3, "n", 4)])
    run(sync, folder)
    assert contents(table) == [(1, "c"), (2, "y"), (3, "n"), (9, "z")]
    # One run per file so far; nothing new means no further run.
    before = sync.jobs().count()
    run(sync, folder)
    assert before == sync.jobs().count() == 3


def test_a_repeated_batch_changes_nothing(spark, folder):
    sync, table = start(spark, folder)
    arrive(spark, folder, [(1, "b", 1)])
    run(sync, folder)
    version = table.current().number
    incremental_pull(sync, "layer", source_stream(sync, "layer", SOURCE), f"{folder}/other").awaitTermination()
    assert table.current().number == version


def ordered(spark, folder, **settings):
    spec = LayerSpec(
        "layer", f"{folder}/source", "rows", "s", "t", on_duplicate_key="latest", order_by="seq", keep_newer=True, **settings
    )
    sync = TableSync(spark, f"{folder}/tables", [spec])
    return sync, SnapshotTable.create(spark, f"{folder}/tables/s/t", SOURCE, ["id"])


def test_late_rows_do_not_overwrite_newer_ones(spark, folder):
    sync, table = ordered(spark, folder)
    for rows in ([(1, "new", 9), (2, "b", 4)], [(1, "old", 3), (2, "c", 5), (3, "x", None)], [(1, "none", None), (3, "y", 1)], [(2, "same", 5)]):
        arrive(spark, folder, rows)
    run(sync, folder)
    assert contents(table) == [(1, "new", 9), (2, "same", 5), (3, "y", 1)]
    counts = [(r["num_created"], r["num_updated"]) for r in sync.jobs().orderBy("time_added").collect()]
    assert counts == [(2, 0), (1, 1), (0, 1), (0, 1)]


def test_the_order_is_kept_in_the_target(spark, folder):
    spec = LayerSpec("layer", f"{folder}/source", "rows", "s", "t", order_by="seq", keep_newer=True)
    sync = TableSync(spark, f"{folder}/tables", [spec])
    SnapshotTable.create(spark, f"{folder}/tables/s/t", TARGET, ["id"])
    with pytest.raises(SyncError, match='needs the column "seq"'):
        sync.pull_rows("layer", spark.createDataFrame([(1, "a", 1)], SOURCE))
    with pytest.raises(SpecError, match="needs order_by"):
        LayerSpec("layer", "a", "rows", "s", "t", keep_newer=True)


# --- changed files ----------------------------------------------------------------


def write_file(folder, name, rows):
    os.makedirs(f"{folder}/source/rows.csv", exist_ok=True)
    with open(f"{folder}/source/rows.csv/{name}", "w") as file:
        file.write("id,v\n" + "".join(f"{i},{v}\n" for i, v in rows))


def changed_layer(spark, folder, **settings):
    spec = LayerSpec("layer", f"{folder}/source", "rows", "s", "t", source_format="csv", allow_feature_deletion=True, **settings)
    stored = spark.createDataFrame([(100, "own")], TARGET)
    sync = TableSync(spark, f"{folder}/tables", [spec])
    return sync, SnapshotTable.create(spark, f"{folder}/tables/s/t", TARGET, ["id"], rows=stored)


def test_only_changed_files_are_read(spark, folder, monkeypatch):
    sync, table = changed_layer(spark, folder)
    write_file(folder, "a b.csv", [(1, "a"), (2, "b")])
    write_file(folder, "c.csv", [(3, "c"), (4, "d")])
    read = []
    plain = changed.read_source
    monkeypatch.setattr(changed, "read_source", lambda spark, spec, paths: (read.append(sorted(p.rsplit("/", 1)[-1] for p in paths)), plain(spark, spec, paths))[1])
    result = changed.pull_changed_files(sync, "layer")
    assert (result.num_pulled, result.num_created) == (4, 4) and read == [["a b.csv", "c.csv"]]
    assert changed.pull_changed_files(sync, "layer") is None and len(read) == 1
    # A row leaves a file, another moves from one file to the other.
    write_file(folder, "a b.csv", [(1, "changed")])
    write_file(folder, "e%20f.csv", [(4, "moved")])
    write_file(folder, "c.csv", [(3, "c"), (5, "e"), (6, "f")])
    result = changed.pull_changed_files(sync, "layer")
    assert contents(table) == [(1, "changed"), (3, "c"), (4, "moved"), (5, "e"), (6, "f"), (100, "own")]
    assert result.num_deleted == 1 and read[-1] == ["a b.csv", "c.csv", "e%20f.csv"]
    os.remove(f"{folder}/source/rows.csv/c.csv")
    result = changed.pull_changed_files(sync, "layer")
    assert contents(table) == [(1, "changed"), (4, "moved"), (100, "own")] and len(read) == 2 and result.num_deleted == 3
    assert changed.pull_changed_files(sync, "layer") is None


def test_a_failed_pull_is_repeated(spark, folder):
    sync, table = changed_layer(spark, folder)
    write_file(folder, "a.csv", [(1, "a"), (1, "again")])
    with pytest.raises(SyncError, match="repeats 1 keys"):
        changed.pull_changed_files(sync, "layer")
    write_file(folder, "b.csv", [(2, "b")])
    write_file(folder, "a.csv", [(1, "mended")])
    assert changed.pull_changed_files(sync, "layer").num_created == 2
    assert contents(table) == [(1, "mended"), (2, "b"), (100, "own")]
