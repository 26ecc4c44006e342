"""Whole runs on small tables: rules, quirks, errors, all-or-nothing."""

import random
import struct
from unittest import mock

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync import ConflictError, LayerSpec, SnapshotTable, SyncError, TableSync
from tablesync.operators import diff as D
from tablesync.operators import keys as K
from tablesync.operators.casting import geometry_field, varchar

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("note", T.StringType()),
    ]
)
STORED = [(1, "a", 1.0, "keep"), (2, "b", 2.0, "keep"), (3, "c", None, "keep")]
FRESH = [(1, "a", 1.0), (2, "B", 2.0), (4, "d", 4.0)]


class Case:
    """A source, a target and a layer between them."""

    def __init__(self, spark, folder, stored=STORED, schema=SCHEMA, key=("id",), buckets=0, **settings):
        self.spark, self.folder = spark, folder
        self.spec = LayerSpec("layer", f"{folder}/source", "rows", "s", "t", **settings)
        self.sync = TableSync(spark, f"{folder}/tables", [self.spec])
        self.table = SnapshotTable.create(
            spark, f"{folder}/tables/s/t", schema, key, buckets, spark.createDataFrame(stored, schema)
        )

    def source(self, rows, schema="id int, name string, v double"):
        df = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, schema)
        df.write.mode("overwrite").parquet(f"{self.folder}/source/rows.parquet")
        return self

    def pull(self, condition=None):
        r = self.sync.pull("layer", condition)
        return (r.num_pulled, r.num_created, r.num_updated, r.num_deleted, r.num_ignored)

    def rows(self):
        return sorted((tuple(r) for r in self.table.read().collect()), key=repr)


@pytest.fixture
def case(spark, folder):
    return lambda **settings: Case(spark, folder, **settings)


# --- the incremental pull ---------------------------------------------------------------


@pytest.mark.parametrize("buckets", [0, 4])
def test_update_insert_delete(case, buckets):
    c = case(allow_feature_deletion=True, buckets=buckets).source(FRESH)
    assert c.pull() == (3, 1, 1, 1, 0)
    assert c.rows() == [(1, "a", 1.0, "keep"), (2, "B", 2.0, "keep"), (4, "d", 4.0, None)]
    assert {(r["_op"], r["id"]) for r in c.table.changes().collect()} == {("update", 2), ("insert", 4), ("delete", 3)}


def test_second_pull_changes_nothing_and_publishes_nothing(case):
    c = case(allow_feature_deletion=True).source(FRESH)
    c.pull()
    version = c.table.current().number
    assert c.pull() == (3, 0, 0, 0, 0)
    assert c.table.current().number == version


def test_without_deletion_vanished_rows_stay(case):
    c = case().source(FRESH)
    assert c.pull() == (3, 1, 1, 0, 0)
    assert (3, "c", None, "keep") in c.rows()


@pytest.mark.parametrize("layer_filter, request_filter", [("1 = 1", None), ("", " id <> 2 "), ("v > 0", "id <> 2")])
def test_any_filter_disables_deletion(case, layer_filter, request_filter):
    c = case(allow_feature_deletion=True, filter=layer_filter).source(FRESH)
    counts = c.pull(request_filter)
    assert counts[3] == 0 and (3, "c", None, "keep") in c.rows()
    assert counts[2] == (0 if request_filter else 1)


def test_null_and_value_differ_in_both_directions(case):
    c = case().source([(1, None, 1.0), (3, "c", 0.5)])
    assert c.pull() == (2, 0, 2, 0, 0)
    assert c.rows()[0] == (1, None, 1.0, "keep") and c.rows()[2] == (3, "c", 0.5, "keep")


def test_source_columns_unknown_to_the_target_are_ignored(case):
    c = case().source([(1, 9)], "id int, unknown int")
    assert c.pull() == (1, 0, 0, 0, 0)


def test_columns_match_in_lower_case_and_values_are_cast(case):
    c = case().source([("1", "a", "2.5")], "ID string, Name string, V string")
    assert c.pull() == (1, 0, 1, 0, 0)
    assert c.rows()[0] == (1, "a", 2.5, "keep")


def test_empty_source_empties_the_target_unless_guarded(case):
    c = case(allow_feature_deletion=True, max_delete_fraction=0.5).source([])
    with pytest.raises(SyncError, match="would delete 3 rows"):
        c.pull()
    assert len(c.rows()) == 3
    c2 = TableSync(c.spark, f"{c.folder}/tables", [LayerSpec("layer", f"{c.folder}/source", "rows", "s", "t", allow_feature_deletion=True)])
    assert c2.pull("layer").num_deleted == 3 and c.rows() == []


# --- keys ------------------------------------------------------------------------------------


def test_override_updates_every_row_with_that_key(case):
    stored = [(1, "a", 1.0, "n"), (2, "a", 2.0, "n"), (3, "b", 9.0, "n"), (4, None, 0.0, "n")]
    c = case(stored=stored, key=(), primary_key_columns=("name",), allow_feature_deletion=True)
    c.source([("a", 2.0), (None, 5.0), ("z", 7.0)], "name string, v double")
    assert c.pull() == (3, 1, 2, 1, 0)
    expected = [(1, "a", 2.0, "n"), (2, "a", 2.0, "n"), (4, None, 5.0, "n"), (None, "z", 7.0, None)]
    assert c.rows() == sorted(expected, key=repr)
    assert c.pull() == (3, 0, 0, 0, 0)


def test_override_may_not_leave_the_table_key_empty(case):
    c = case(primary_key_columns=("name",)).source([("z", 7.0)], "name string, v double")
    with pytest.raises(SyncError, match="NOT NULL"):
        c.pull()


@pytest.mark.parametrize("bulk", [False, True])
def test_override_may_not_repeat_the_table_key(case, bulk):
    c = case(primary_key_columns=("name",), bulk_mode=bulk).source([("a", 5), ("b", 5)], "name string, id int")
    with pytest.raises(SyncError, match="repeat the primary key"):
        c.pull()
    assert c.rows() == STORED


def test_override_in_not_in_mode(case):
    stored = [(1, "a", 1.0, "n"), (3, "b", 9.0, "n"), (4, None, 0.0, "n")]
    c = case(stored=stored, key=(), primary_key_columns=("name",), allow_feature_deletion=True, key_nulls="not_in")
    c.source([("a", 2.0), ("z", 7.0)], "name string, v double")
    # A NULL key in the target keeps anything from being inserted, and is itself never deleted.
    assert c.pull() == (2, 0, 1, 1, 0)
    assert c.rows() == [(1, "a", 2.0, "n"), (4, None, 0.0, "n")]


def test_table_key_must_be_known(case):
    c = case().source([(None, "x", 1.0)])
    with pytest.raises(SyncError, match="without a value for id"):
        c.pull()


def test_duplicate_source_keys(case):
    rows = [(1, "a", 1.0), (1, "b", 3.0), (1, "c", 2.0)]
    with pytest.raises(SyncError, match="repeats 1 keys.*such as .1,. 3 times"):
        case().source(rows).pull()


@pytest.mark.parametrize("policy, order_by, kept", [("latest", "seq", "b"), ("any", None, "c")])
def test_duplicate_policies(case, policy, order_by, kept):
    c = case(on_duplicate_key=policy, order_by=order_by)
    c.source([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "id int, name string, seq int")
    assert c.pull() == (3, 0, 1, 0, 0)
    assert c.rows()[0][1] == kept


def test_feature_id_as_key(case):
    schema = T.StructType([T.StructField("OGC_FID", T.IntegerType()), T.StructField("name", T.StringType())])
    c = case(stored=[(1, "a")], schema=schema, key=("OGC_FID",), fid_column="OGC_FID")
    c.source([(1, "b"), (2, "c")], "OGC_FID int, Name string")
    assert c.pull() == (2, 1, 1, 0, 0)
    assert c.rows() == [(1, "b"), (2, "c")]


# --- values that do not fit -------------------------------------------------------------------


DIRTY = [("1", "a", "x"), ("2", "B", "2.0"), ("5", "e", "5")]


def test_one_bad_value_fails_the_pull(case):
    c = case().source(DIRTY, "id string, name string, v string")
    with pytest.raises(SyncError, match="column v cannot take x"):
        c.pull()
    assert c.rows() == STORED and c.sync.status()["num_failed_jobs"] == 1


def test_bad_rows_are_ignored_counted_and_kept_aside(case):
    c = case(ignore_failures=True, allow_feature_deletion=True).source(DIRTY, "id string, name string, v string")
    result = c.sync.pull("layer")
    assert (result.num_pulled, result.num_created, result.num_updated, result.num_ignored) == (3, 1, 1, 1)
    # The row set aside is not staged, so its old version goes with deletion on.
    assert result.num_deleted == 2
    assert [r[0] for r in c.rows()] == [2, 5]
    (bad,) = c.sync.quarantine(c.spec, result.id).collect()
    assert bad["id"] == 1 and bad["_errors"][0]["value"] == "x"


def test_over_long_text(case):
    schema = T.StructType([varchar("id", 4, False), varchar("country", 5)])
    c = case(stored=[("1", "x")], schema=schema, ignore_failures=True)
    c.source([("1", "Ghana"), ("2", "Nigeria")], "id string, country string")
    assert c.pull() == (2, 0, 1, 0, 1)


def test_not_null_columns_are_checked_even_when_ignoring(case):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType(), False)])
    c = case(stored=[(1, "a")], schema=schema, ignore_failures=True).source([(1, None)], "id int, name string")
    with pytest.raises(SyncError, match="NOT NULL"):
        c.pull()


# --- geometry --------------------------------------------------------------------------------


def point(x, y):
    return bytearray(struct.pack("<BIdd", 1, 1, x, y))


def test_geometry_layer(case):
    schema = T.StructType([T.StructField("id", T.IntegerType()), geometry_field("the_geom", 3857, 2)])
    c = case(stored=[], schema=schema, geometry_source={"encoding": "wkb", "column": "w", "name": "shape"}, source_srid=4326)
    c.source([(1, point(0, 0)), (2, None)], "id int, w binary")
    assert c.pull() == (2, 2, 0, 0, 0)
    assert [r["the_geom"] and r["the_geom"]["srid"] for r in c.table.read().orderBy("id").collect()] == [3857, None]
    assert c.pull() == (2, 0, 0, 0, 0)
    c.source([(1, point(1, 0)), (2, None)], "id int, w binary")
    assert c.pull() == (2, 0, 1, 0, 0)


def test_declared_dimension_is_enforced(case):
    schema = T.StructType([T.StructField("id", T.IntegerType()), geometry_field("g", 0, 2)])
    c = case(stored=[], schema=schema, geometry_source={"encoding": "wkb", "column": "w"})
    c.source([(1, bytearray(struct.pack("<BIddd", 1, 1001, 0, 0, 0)))], "id int, w binary")
    with pytest.raises(SyncError, match="geometry rule"):
        c.pull()


# --- full refresh -------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["delete", "truncate"])
def test_bulk_refresh_ignores_the_delete_permission(case, method):
    c = case(bulk_mode=True, bulk_delete_method=method).source(FRESH)
    assert c.pull() == (3, 3, 0, 3, 0)
    assert c.rows() == [(i, n, v, None) for i, n, v in FRESH]


@pytest.mark.parametrize("method, deleted", [("truncate", 1), ("delete", 2)])
def test_truncation_counts_known_keys_only(case, method, deleted):
    stored = [(1, None, 1.0, "n"), (2, "b", 1.0, "n")]
    c = case(stored=stored, bulk_mode=True, bulk_delete_method=method, primary_key_columns=("name",))
    assert c.source(FRESH).pull()[3] == deleted


def test_bulk_refresh_rejects_a_request_filter(case):
    c = case(bulk_mode=True).source(FRESH)
    with pytest.raises(SyncError, match="in bulk"):
        c.pull("id = 1")
    assert c.rows() == STORED


def test_bulk_refresh_with_a_permitted_filter_keeps_filtered_rows_only(case):
    c = case(bulk_mode=True, allow_bulk_filter=True).source(FRESH)
    assert c.pull("id = 1") == (1, 1, 0, 3, 0)
    assert c.rows() == [(1, "a", 1.0, None)]


# --- removal ---------------------------------------------------------------------------------------


def test_remove_by_attributes(case):
    c = case(allow_feature_deletion=True)
    assert c.sync.remove_by_attributes("layer", [{"name": "a", "v": "1"}, {}, {"v": None}]).num_deleted == 2
    assert [r[0] for r in c.rows()] == [2]
    assert {r["id"] for r in c.table.changes().collect()} == {1, 3}


def test_remove_nothing(case):
    c = case(allow_feature_deletion=True)
    assert c.sync.remove_by_attributes("layer", [{}]).num_deleted == 0
    assert c.sync.remove_by_attributes("layer", [{"id": "77"}]).num_deleted == 0
    assert c.table.current().number == 0


def test_remove_needs_permission(case):
    c = case()
    with pytest.raises(SyncError, match="does not permit"):
        c.sync.remove_by_attributes("layer", [{"id": "1"}])
    assert len(c.rows()) == 3


def test_remove_checks_columns(case):
    with pytest.raises(SyncError, match='no column "nope"'):
        case(allow_feature_deletion=True).sync.remove_by_attributes("layer", [{"nope": None}])


def test_remove_by_many_sets_and_by_table(case):
    c = case(allow_feature_deletion=True)
    many = [{"id": str(n)} for n in range(3, 400)] + [{"name": "a", "note": "keep"}]
    assert c.sync.remove_by_attributes("layer", many).num_deleted == 2
    criteria = c.spark.createDataFrame([("b",), ("b",), (None,)], "name string")
    assert c.sync.remove_by_attributes("layer", criteria).num_deleted == 1
    assert c.rows() == []


def test_remove_request(case):
    c = case(allow_feature_deletion=True, buckets=4)
    result = c.sync.remove_request('{"layerName": "layer", "attributeSets": [{"name": "b", "v": "2.0"}]}')
    assert result.num_deleted == 1 and [r[0] for r in c.rows()] == [1, 3]
    shown = c.sync.job(result.id)
    assert shown["attributeSets"] == [{"name": "b", "v": "2.0"}] and "filter" not in shown


# --- errors, conflicts, all-or-nothing ----------------------------------------------------------


@pytest.mark.parametrize("condition", ["nope = 1", "id = = 1"])
def test_invalid_filter(case, condition):
    c = case().source(FRESH)
    with pytest.raises(SyncError, match="cannot be filtered by") as caught:
        c.pull(condition)
    assert condition in str(caught.value)


def test_target_must_exist(spark, folder):
    spark.createDataFrame(FRESH, "id int, name string, v double").write.parquet(f"{folder}/source/rows.parquet")
    sync = TableSync(spark, f"{folder}/tables", [LayerSpec("layer", f"{folder}/source", "rows", "s", "t")])
    with pytest.raises(SyncError, match="no table"):
        sync.pull("layer")


def test_nothing_is_published_when_publishing_fails(case):
    c = case(allow_feature_deletion=True).source(FRESH)
    with mock.patch.object(SnapshotTable, "publish", side_effect=SyncError("disk gone")):
        with pytest.raises(SyncError, match="disk gone"):
            c.pull()
    assert c.rows() == STORED
    failed = c.sync.jobs().filter("status = 'failed'").first()
    assert failed["num_pulled"] == 3 and failed["message"] == "disk gone"
    assert c.pull() == (3, 1, 1, 1, 0)


def test_the_second_of_two_writers_fails(case):
    c = case().source(FRESH)
    stale = c.table.current()
    c.pull()
    after = c.rows()
    with pytest.raises(ConflictError):
        c.table.publish(stale, c.table.write_rows(c.table.read(stale), stale))
    assert c.rows() == after


def test_old_versions_stay_readable_until_vacuumed(case):
    c = case(allow_feature_deletion=True).source(FRESH)
    c.pull()
    assert len(c.table.read(c.table.version(0)).collect()) == 3
    removed = c.table.vacuum(keep=1)
    assert len(removed) == 1
    assert len(c.rows()) == 3
    assert c.pull() == (3, 0, 0, 0, 0)


def test_columns_may_appear_between_runs(case):
    c = case().source([(1, "a", 1.0, "new")], "id int, name string, v double, note string")
    assert c.pull() == (1, 0, 1, 0, 0)
    assert c.rows()[0] == (1, "a", 1.0, "new")


def test_a_bucketed_table_needs_a_key(spark, folder):
    with pytest.raises(SyncError, match="primary key"):
        SnapshotTable.create(spark, folder, SCHEMA, buckets=4)


def test_staging_is_removed(case, spark):
    from tablesync.sources import files

    c = case().source(FRESH)
    result = c.sync.pull("layer")
    assert not files.exists(spark, files.run_folder(spark, result.id))


# --- change sets on top of the data --------------------------------------------------------------


@pytest.mark.parametrize("buckets", [0, 4])
def test_small_changes_are_published_without_rewriting(case, buckets):
    c = case(allow_feature_deletion=True, buckets=buckets, max_delta_share=1e9)
    data = c.table.current().data
    assert c.source(FRESH).pull() == (3, 1, 1, 1, 0)
    assert c.pull() == (3, 0, 0, 0, 0)
    # 3 returns, 4 changes again, 1 goes, 2 is left alone.
    assert c.source([(2, "B", 2.0), (3, "c2", 3.0), (4, "D", 4.0)]).pull() == (3, 1, 1, 1, 0)
    expected = [(2, "B", 2.0, "keep"), (3, "c2", 3.0, None), (4, "D", 4.0, None)]
    assert c.rows() == expected
    assert c.table.current().data == data and len(c.table.current().deltas) == 2
    assert c.sync.remove_by_attributes("layer", [{"name": "D"}]).num_deleted == 1
    assert c.pull("id > 2") == (2, 1, 0, 0, 0)
    assert c.rows() == expected
    assert len(c.table.current().deltas) == 4
    compacted = c.table.compact()
    assert not compacted.deltas and compacted.data != data and c.rows() == expected
    assert c.pull() == (3, 0, 0, 0, 0)
    c.table.vacuum(keep=1)
    assert c.rows() == expected


def test_many_small_change_sets_become_one(case):
    c = case(allow_feature_deletion=True, max_delta_share=1e9, max_deltas=1).source(FRESH)
    data = c.table.current().data
    c.pull()
    c.source([(1, "x", 1.0), (3, "c", 3.0)])
    assert c.pull() == (2, 1, 1, 2, 0)
    version = c.table.current()
    assert version.data == data and len(version.deltas) == 1
    assert version.changes != version.deltas[0]
    assert c.rows() == [(1, "x", 1.0, "keep"), (3, "c", 3.0, None)]
    assert c.pull() == (2, 0, 0, 0, 0)


def test_unexpected_errors_are_logged_and_raised_as_they_are(case):
    c = case().source(FRESH)
    with mock.patch.object(SnapshotTable, "publish_changes", side_effect=ZeroDivisionError("odd")):
        with pytest.raises(ZeroDivisionError):
            c.pull()
    assert c.sync.status()["num_failed_jobs"] == 1 and c.sync.status()["num_in_process_jobs"] == 0


def test_many_changes_lead_to_a_rewrite(case):
    c = case(allow_feature_deletion=True, max_delta_share=0.0).source(FRESH)
    c.pull()
    assert c.table.current().deltas == () and len(c.rows()) == 3


def test_override_and_refresh_on_top_of_change_sets(case):
    c = case(allow_feature_deletion=True, max_delta_share=1e9).source(FRESH)
    c.pull()
    assert c.table.current().deltas
    settings = dict(source=c.spec.source, source_layer="rows", target_table_schema="s", target_table_name="t")
    override = LayerSpec("o", primary_key_columns=("name",), **settings)
    refresh = LayerSpec("r", bulk_mode=True, **settings)
    sync = TableSync(c.spark, f"{c.folder}/tables", [override, refresh])
    c.source([(1, "a", 7.0), (2, "B", 2.0)])
    assert sync.pull("o").num_updated == 1
    assert c.rows()[0] == (1, "a", 7.0, "keep")
    # The next change set lies on top of the rows written for the other key.
    assert c.source([(1, "a", 8.0)]).pull() == (1, 0, 1, 2, 0)
    assert c.rows() == [(1, "a", 8.0, "keep")] and c.table.current().deltas
    assert sync.pull("r").num_deleted == 1
    assert c.table.current().deltas == () and c.rows() == [(1, "a", 8.0, None)]


# --- run records ------------------------------------------------------------------------------------


def test_run_record(case):
    c = case(allow_feature_deletion=True).source(FRESH)
    result = c.sync.pull_request('{"layerName": "layer", "filter": " id <> 9 "}')
    shown = c.sync.job(result.id)
    assert shown["status"] == "finished" and shown["filter"] == "id <> 9" and shown["layerName"] == "layer"
    assert (shown["numPulled"], shown["numCreated"], shown["numUpdated"], shown["numDeleted"], shown["numIgnored"]) == (3, 1, 1, 0, 0)
    assert shown["timeAdded"].endswith("Z") and shown["timeFinished"] >= shown["timeAdded"]
    assert c.sync.status() == {
        "num_layers": 1, "num_queued_jobs": 0, "num_in_process_jobs": 0, "num_finished_jobs": 1, "num_failed_jobs": 0,
    }
    with pytest.raises(KeyError):
        c.sync.job("nope")
    c.sync.log.max_age_seconds = -3600
    assert c.sync.status()["num_finished_jobs"] == 0
    c.sync.log.expire()
    c.sync.log.max_age_seconds = 3600
    # Today's records stay until the day is over.
    assert c.sync.jobs().count() == 1


@pytest.mark.parametrize("plan", ["merge", "probe", "split"])
def test_every_plan_gives_the_same_result(case, plan):
    with mock.patch.object(TableSync, "choose_plan", return_value=plan):
        c = case(allow_feature_deletion=True).source(FRESH)
        assert c.pull() == (3, 1, 1, 1, 0)
        assert c.rows() == [(1, "a", 1.0, "keep"), (2, "B", 2.0, "keep"), (4, "d", 4.0, None)]


def _not_in(row, others):
    return not any(all(a is None or b is None or a == b for a, b in zip(row, other)) for other in others)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_not_in_for_any_pattern_of_nulls(spark, width):
    rng = random.Random(width)
    names = [f"k{n}" for n in range(width)]
    some = lambda n, nulls: [tuple(None if rng.random() < nulls else rng.randrange(6) for _ in names) for _ in range(n)]
    schema = ", ".join(f"{n} int" for n in names)
    for mine, theirs in ((some(60, 0.2), some(5, 0.3)), (some(60, 0), some(9, 0)), (some(40, 0.5), []), ([], some(4, 0.5))):
        df, others = spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema)
        got = sorted(map(tuple, D.missing_rows_not_in(df, others, names).collect()), key=repr)
        assert got == sorted((r for r in mine if _not_in(r, theirs)), key=repr)


def test_a_null_key_does_not_gather_all_rows(spark):
    """With a NULL on the other side every row has the same cut: no task may get them all."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    others = spark.createDataFrame([(None,), (7,)], "k long")
    flagged = K.flag_not_in_blocked(df, others, ["k"])
    assert flagged.filter("not _blocked").isEmpty()
    assert K.flag_not_in_blocked(df, others.filter("k = 7"), ["k"]).filter("_blocked").count() == 10_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = [r["n"] for r in K.flag_not_in_blocked(df, others, ["k"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(per_task) == 20_000 and max(per_task) < 6_000
