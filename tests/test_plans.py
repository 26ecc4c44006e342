"""Physical plans: what is shuffled, pushed down, split or broadcast."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame
from pyspark.sql.readwriter import DataFrameWriter

from catalogue.fixtures import view
from catalogue.queries import QUERIES, published
from tablesync import SnapshotTable
from tablesync.operators import apply as A
from tablesync.operators import diff as D
from tablesync.operators import keys as K
from tablesync.operators import predicates as P

# These run whole jobs and return what was published.
RUNS = {n for n in QUERIES if "published" in n or n in ("pull_counters", "partitions_overwritten", "stream_incremental")}


@contextlib.contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pair(spark, sf_dir):
    target = view(spark, sf_dir, "tgt")
    return target, view(spark, sf_dir, "src").drop("src_only")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS))
def test_no_query_compares_all_pairs(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_safe_classification_is_one_shuffled_join(spark, sf_dir):
    with settings(spark, **NO_BROADCAST):
        target, staged = pair(spark, sf_dir)
        plan = plan_of(D.classify(target, staged, ["id"], deletion=True))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1


def test_bucketed_target_is_not_shuffled(spark, sf_dir, folder):
    target, staged = pair(spark, sf_dir)
    table = SnapshotTable.create(spark, f"{folder}/t", target.schema, ["id"], 8, target)
    with settings(spark, **NO_BROADCAST):
        plan = plan_of(D.classify(table.read(), staged, ["id"], deletion=True, null_safe=False))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in plan


def test_small_source_never_shuffles_the_target(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    plan = plan_of(D.classify(target, staged.filter("cust = 17"), ["id"], null_safe=False, plan="probe"))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
    # The one exchange holds the target keys found in the small source.
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(_known" in plan


def test_small_change_set_is_applied_without_a_shuffle(spark, sf_dir, folder):
    target, staged = pair(spark, sf_dir)
    D.changes_of(D.classify(target, staged, ["id"], deletion=True)).write.parquet(f"{folder}/changes")
    plan = plan_of(A.apply_changes(target, spark.read.parquet(f"{folder}/changes"), ["id"], null_safe=False))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_repeated_target_keys_are_distinct_before_their_shuffle(spark, sf_dir):
    with settings(spark, **NO_BROADCAST):
        target, staged = pair(spark, sf_dir)
        plan = plan_of(D.missing_rows(staged, target, ["cust"]))
    shuffled = re.findall(r"Exchange hashpartitioning", plan)
    assert len(shuffled) == 2 and plan.count("HashAggregate") == 2


def test_only_comparisons_of_texts_are_not_pushed_down(spark, sf_dir):
    condition = "l_quantity > 10 and l_returnflag = 'a' and l_linestatus >= 'F' and not (l_linestatus in ('f') or l_tax = 0.0)"
    with settings(spark, spark__sql__maxMetadataStringLength="10000"):
        plan = plan_of(P.apply_filter(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), condition, "x"))
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(l_quantity,10.0)" in pushed and "GreaterThanOrEqual(l_linestatus,F)" in pushed and "l_tax" in pushed
    assert "EqualTo(l_returnflag" not in pushed and "lower(l_returnflag" in plan and "lower(l_linestatus" in plan


def test_repeated_keys_are_counted_in_the_exchange_of_the_join(spark, sf_dir):
    with settings(spark, **NO_BROADCAST):
        target, staged = pair(spark, sf_dir)
        rows = D.classify(target, K.numbered(staged, ["id"]), ["id"], deletion=True, null_safe=False)
        watched = A.watched_changes(D.changes_of(A.Watched(rows, repeated=F.col(K.NTH) > 1).df.drop(K.NTH)))
        plan = plan_of(watched.df)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Window [") == 1
    assert len(re.findall(r"\bSort \[", plan)) == 2 and plan.count("CollectMetrics") == 2
    assert plan.count("FileScan") == 2


def test_a_pull_reads_its_source_once(spark, sf_dir, monkeypatch):
    """Counters, repeated keys and changes come from the staging and from the one join that is written."""
    written = []
    save = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(self._df), save(self, path, *a, **k))[1])
    collected = []
    for name in ("collect", "first", "count", "isEmpty"):
        plain = getattr(ClassicFrame, name)
        monkeypatch.setattr(ClassicFrame, name, lambda self, *a, _plain=plain, **k: (collected.append(plan_of(self)), _plain(self, *a, **k))[1])
    with settings(spark, **NO_BROADCAST, spark__sql__maxMetadataStringLength="10000"):
        target, source = pair(spark, sf_dir)
        sync, spec, stored = published(spark, source, target, ["id"], buckets=4, allow_feature_deletion=True, source_format="csv")
        written.clear(), collected.clear()
        result = sync.pull(spec.name)
        runs = [plan_of(df) for df in written]
    staging = [plan for plan in runs if "Scan csv" in plan or "FileScan csv" in plan]
    joins = [plan for plan in runs if "/staged" in plan]
    assert len(staging) == 1 and len(joins) == 1 and "CollectMetrics" in staging[0] and joins[0].count("CollectMetrics") == 2
    assert not [plan for plan in collected if "/staged" in plan or "source/layer" in plan]
    assert result.num_updated and result.num_deleted and stored.read().count()


@pytest.mark.parametrize("keys", [["id"], ["id", "cust"], ["id", "cust", "status"]])
def test_not_in_reads_each_side_as_often_for_any_number_of_keys(spark, sf_dir, keys):
    target, staged = pair(spark, sf_dir)
    plan = D.missing_rows_not_in(staged, target, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= 6 and "Union" not in plan and plan.count("Join ") == 2


def test_latest_row_is_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(K.one_row_per_key(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts"))
    assert plan.count("WindowGroupLimit") == 2


def test_duplicate_count_is_combined_before_the_shuffle(spark, sf_dir):
    plan = plan_of(K.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey"]))
    assert "partial_count" in plan


def test_filter_reaches_the_scan_and_columns_are_pruned(spark, sf_dir):
    condition = P.compose_filter("l_quantity > 10", "l_returnflag = 'A'")
    lines = P.apply_filter(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), condition, "x", ignore_case=False).select("l_orderkey")
    plan = plan_of(lines)
    assert "l_quantity,10.0)" in plan and "EqualTo(l_returnfl" in plan
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>", plan)


HOT = dict(
    spark__sql__shuffle__partitions="64",
    spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
    spark__sql__adaptive__advisoryPartitionSizeInBytes="100KB",
    spark__sql__autoBroadcastJoinThreshold="-1",
    spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
)


@pytest.mark.parametrize("hot", ["value", "null"])
def test_hot_target_key_is_split(spark, folder, hot):
    """A third of the target shares one key (or has none): its partition is split."""
    cold = "cast(id % 5000 as string)"
    key = f"case when id % 3 = 0 then {'null' if hot == 'null' else repr('hot')} else {cold} end"
    spark.range(150_000).selectExpr(f"{key} as k", "uuid() as filler", "1 as v").write.parquet(f"{folder}/t")
    target = spark.read.parquet(f"{folder}/t")
    staged = spark.range(0, 5000).selectExpr("cast(id as string) as k", "2 as v")
    staged = staged.unionByName(spark.createDataFrame([(None if hot == "null" else "hot", 2)], "k string, v int"))
    with settings(spark, **HOT):
        classified = D.classify(target, staged, ["k"], deletion=True, plan="split")
        executed = classified.select(D.OP, "filler", "v")
        rows = executed.collect()
        plan = plan_of(executed)
    assert len(rows) == 150_000 and {r[D.OP] for r in rows} == {"update"}
    assert "skew=true" in plan


def test_hot_source_key_sends_one_row_per_task(spark):
    """A third of the source shares one key; the rank limit thins it on the map side."""
    rows = spark.range(0, 90_000, 1, 6).selectExpr("case when id % 3 = 0 then -1 else id end as k", "id as v")
    latest = K.one_row_per_key(rows, ["k"], "v")
    found = latest.filter("k = -1").collect()
    assert [tuple(r) for r in found] == [(-1, 89_997)]
    assert latest.count() == 60_001


def test_counts_come_from_footers(spark, sf_dir, folder):
    target, staged = pair(spark, sf_dir)
    D.classify(target, staged, ["id"], deletion=True).write.partitionBy(D.OP).parquet(f"{folder}/c")
    plan = plan_of(A.counts_per_op(spark.read.parquet(f"{folder}/c")))
    assert "ReadSchema: struct<>" in plan
    assert A.counters(spark.read.parquet(f"{folder}/c")) == {
        r["_op"]: r["n"] for r in A.counts_per_op(spark.read.parquet(f"{folder}/c")).collect()
    }


def test_geometry_comparison_skips_unchanged_rows(spark):
    from tablesync.functions.geometry import geometry, geometry_changed, point_wkb

    df = spark.range(10).select(geometry(point_wkb(F.col("id").cast("double"), F.lit(1.0)), 4326).alias("g"))
    assert df.filter(geometry_changed(F.col("g"), F.col("g"))).count() == 0


def test_change_sets_on_top_leave_the_bucketed_data_in_place(spark, sf_dir, folder):
    """Classifying against data plus change sets shuffles the source and the change sets only."""
    from tablesync import LayerSpec, TableSync
    from tablesync.operators.columns import plan_columns
    from tablesync.plans.sync import _Stage

    target, staged = pair(spark, sf_dir)
    spec = LayerSpec("l", "x", "x", "s", "t", max_delta_share=1e9)
    sync = TableSync(spark, folder, [spec])
    table = SnapshotTable.create(spark, f"{folder}/s/t", target.schema, ["id"], 16, target)
    changes = D.changes_of(D.classify(target, staged.filter("cust < 100"), ["id"]))
    base = table.publish_changes(table.current(), table.write_by_op(changes), 1e9)
    assert len(base.deltas) == 1
    plan = plan_columns("l", staged.schema, base.schema, base.primary_key)
    with settings(spark, **NO_BROADCAST):
        physical = plan_of(sync._classified(spec, table, base, _Stage(staged, 0, 0, 1 << 40), plan, True))
    data = base.data.rsplit("/", 1)[-1]
    lines = physical.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    (scan,) = [i for i, line in enumerate(lines) if f"tablesync_{data}" in line and "FileScan" in line]
    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert "Bucketed: true" in lines[scan]
    assert sum("SortMergeJoin" in line for line in above) == 2
    assert not any("Exchange" in line for line in above)
