"""Every operator as a query over the driver tables."""

from __future__ import annotations

import atexit
import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue.fixtures import table, view
from tablesync import LayerSpec, SnapshotTable, SyncError, TableSync
from tablesync import runlog as R
from tablesync.functions import geometry as G
from tablesync.functions import text as X
from tablesync.functions.nearest import nearest_name
from tablesync.operators import apply as A
from tablesync.operators import casting as C
from tablesync.operators import diff as D
from tablesync.operators import keys as K
from tablesync.operators import predicates as P
from tablesync.operators.columns import plan_columns
from tablesync.sources import files
from tablesync.sources.readers import lower_names
from tablesync.sources.sinks import overwrite_partitions
from tablesync.streaming.changed import pull_changed_files
from tablesync.streaming.incremental import incremental_pull

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- shared steps --------------------------------------------------------------------


def mapped(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source columns the target knows, in target order."""
    plan = plan_columns("query", source.schema, target.schema, keys)
    return source.select(*[F.col(s).alias(t) for t, s in plan.mapped.items()])


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Target and staged source of the orders fixture."""
    target = view(spark, sf_dir, "tgt")
    return target, mapped(view(spark, sf_dir, "src"), target, ["id"])


def op_counts(classified: DataFrame) -> DataFrame:
    return A.counts_per_op(classified).withColumnRenamed(D.OP, "op")


_folders: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """A folder of its own for a query that stores tables; it goes when the driver ends, as its result reads it until then."""
    _folders.append((spark, files.run_folder(spark, f"query-{uuid.uuid4().hex}")))
    return _folders[-1][1]


@atexit.register
def clean() -> None:
    while _folders:
        spark, path = _folders.pop()
        if spark.sparkContext._jsc is not None:
            files.delete(spark, path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def published(
    spark: SparkSession, source: DataFrame, target: DataFrame, keys: Sequence[str], buckets: int = 0, **settings
) -> tuple[TableSync, LayerSpec, SnapshotTable]:
    """A stored source layer and a stored target, ready for runs."""
    root = work_folder(spark)
    source_format = settings.get("source_format", "parquet")
    source.write.option("header", True).format(source_format).save(f"{root}/source/layer.{source_format}")
    spec = LayerSpec("layer", f"{root}/source", "layer", "stored", "target", **settings)
    sync = TableSync(spark, f"{root}/tables", [spec])
    stored = SnapshotTable.create(
        spark, f"{root}/tables/stored/target", nullable(target.schema), keys, buckets, rows=target
    )
    return sync, spec, stored


# --- change detection -----------------------------------------------------------------


@query
def sync_classify_counts(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return op_counts(D.classify(target, staged, ["id"], deletion=True, null_safe=False))


@query
def sync_change_feed(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return D.change_feed(target, staged, ["id"], null_safe=False)


@query
def sync_updated_rows(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return D.updated_rows(target, staged, ["id"])


@query
def sync_insert_missing(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return D.missing_rows(staged, target, ["id"], unique=True)


@query
def sync_delete_removed(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return D.vanished_rows(target, staged, ["id"])


@query
def sync_result_full(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return A.result_rows(D.classify(target, staged, ["id"], deletion=True, null_safe=False))


@query
def sync_result_no_delete(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return A.result_rows(D.classify(target, staged, ["id"], null_safe=False))


@query
def sync_result_filtered(spark, sf_dir):
    """Layer and request filter on source columns; a filter switches deletion off."""
    target = view(spark, sf_dir, "tgt")
    condition = P.compose_filter("src_only in ('1-URGENT', '2-HIGH')", " price > 50000 ")
    source = P.apply_filter(view(spark, sf_dir, "src"), condition, "query")
    staged = mapped(source, target, ["id"])
    return A.result_rows(D.classify(target, staged, ["id"], deletion=not condition, null_safe=False, plan="probe"))


@query
def sync_keep_target_only_columns(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    classified = D.classify(target, staged, ["id"], deletion=True, null_safe=False)
    return classified.groupBy(F.col(D.OP).alias("op"), "note").agg(F.count(F.lit(1)).alias("n"))


@query
def sync_key_override(spark, sf_dir):
    """Keyed by customer, which many target rows share; every one of them is updated."""
    target = view(spark, sf_dir, "tgt")
    staged = mapped(view(spark, sf_dir, "src_segment"), target, ["cust"])
    classified = D.classify(target, staged, ["cust"], deletion=True, plan="split")
    return classified.withColumnRenamed(D.OP, "op")


@query
def sync_composite_key(spark, sf_dir):
    target = view(spark, sf_dir, "tgt_conv")
    staged = mapped(view(spark, sf_dir, "src_conv"), target, ["conv_id", "turn"])
    return op_counts(D.classify(target, staged, ["conv_id", "turn"], deletion=True))


@query
def sync_null_safe_keys(spark, sf_dir):
    target, staged = view(spark, sf_dir, "tgt_null"), view(spark, sf_dir, "src_null")
    classified = D.classify(target, staged, ["k1", "k2"], deletion=True)
    return classified.withColumnRenamed(D.OP, "op")


@query
def sync_not_in_keys(spark, sf_dir):
    """The same pair where inserts and deletes follow SQL ``NOT IN``."""
    target, staged = view(spark, sf_dir, "tgt_null"), view(spark, sf_dir, "src_null")
    classified = D.classify(target, staged, ["k1", "k2"], deletion=True, key_nulls="not_in")
    return classified.withColumnRenamed(D.OP, "op")


@query
def sync_not_in_single_key(spark, sf_dir):
    target = view(spark, sf_dir, "tgt_null").filter("k1 is not null")
    return D.missing_rows_not_in(view(spark, sf_dir, "src_null"), target, ["k1"])


@query
def sync_not_in_null_trap(spark, sf_dir):
    """With a NULL among the target's keys no key is surely missing there: no rows."""
    return D.missing_rows_not_in(view(spark, sf_dir, "src_null"), view(spark, sf_dir, "tgt_null"), ["k1"])


@query
def sync_duplicate_keys(spark, sf_dir):
    return K.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def sync_latest_per_key(spark, sf_dir):
    return K.one_row_per_key(table(spark, sf_dir, "events"), ["user_id"], "ts")


@query
def sync_idempotent(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    result = A.result_rows(D.classify(target, staged, ["id"], deletion=True, null_safe=False))
    return op_counts(D.classify(result, staged, ["id"], deletion=True, null_safe=False))


@query
def sync_apply_changes(spark, sf_dir):
    """The result again, from the target and its change set."""
    target, staged = pair(spark, sf_dir)
    changes = D.changes_of(D.classify(target, staged, ["id"], deletion=True, null_safe=False))
    return A.apply_changes(target, changes, ["id"], null_safe=False)


@query
def sync_labels_of_documents(spark, sf_dir):
    """Documents as source, their labels as target: partial cover, one common value."""
    target = table(spark, sf_dir, "labels")
    staged = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return op_counts(D.classify(target, staged, ["doc_id"], deletion=True))


@query
def list_columns(spark, sf_dir):
    """Array columns compared natively, and as array text."""

    def tags(name):
        return view(spark, sf_dir, name).select("id", F.array("brand", "kind").alias("tags"))

    classified = D.classify(tags("tgt_tags"), tags("src_tags"), ["id"], deletion=True)
    return classified.select(F.col(D.OP).alias("op"), "id", X.text_array_literal(F.col("tags")).alias("tags_text"))


# --- casting ---------------------------------------------------------------------------

DIRTY_TARGET = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_txt", T.LongType()),
        T.StructField("day_txt", T.DateType()),
        T.StructField("kind", T.StringType()),
        T.StructField("dbl", T.DoubleType()),
    ]
)


def cast_to(source: DataFrame, target: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    plan = plan_columns("query", source.schema, target, [key])
    return C.split_rows(C.cast_rows(source, target, plan))


@query
def cast_valid_rows(spark, sf_dir):
    return cast_to(view(spark, sf_dir, "src_dirty"), DIRTY_TARGET, "id")[0]


@query
def cast_quarantine(spark, sf_dir):
    """One row per value that did not fit."""
    bad = cast_to(view(spark, sf_dir, "src_dirty"), DIRTY_TARGET, "id")[1]
    error = F.explode(C.ERRORS).alias("e")
    return bad.select("id", error).select("id", F.col("e.column").alias("column_name"), F.col("e.value").alias("value"))


@query
def cast_empty_temporal(spark, sf_dir):
    source = view(spark, sf_dir, "src_dirty")
    day, bad = C.cast_value(F.col("day_txt"), T.StringType(), DIRTY_TARGET["day_txt"])
    return source.select("id", day.alias("day"), bad.alias("bad"))


@query
def cast_year_month_day(spark, sf_dir):
    """Dates and timestamps from the accepted spellings."""
    dates = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/M/d"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02")))
    )
    day, stamp = T.StructField("day", T.DateType()), T.StructField("stamp", T.TimestampNTZType())
    return dates.select(
        "o_orderkey",
        C.cast_value(spelled, T.StringType(), day)[0].alias("day"),
        C.cast_value(spelled, T.StringType(), stamp)[0].alias("stamp"),
    )


@query
def cast_varchar_limit(spark, sf_dir):
    target = T.StructType([T.StructField("c_custkey", T.LongType(), False), C.varchar("c_mktsegment", 9)])
    bad = cast_to(table(spark, sf_dir, "customer"), target, "c_custkey")[1]
    return bad.select("c_custkey", F.col(C.ERRORS)[0]["value"].alias("value"))


@query
def cast_round_half_even(spark, sf_dir):
    halves = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 2).alias("half"))
    rounded, _ = C.cast_value(F.col("half"), T.DoubleType(), T.StructField("half", T.IntegerType()))
    return halves.groupBy("half", rounded.alias("rounded")).agg(F.count(F.lit(1)).alias("n"))


@query
def cast_numbers_to_text(spark, sf_dir):
    target = T.StructType(
        [
            T.StructField("l_orderkey", T.StringType()),
            T.StructField("l_extendedprice", T.StringType()),
            T.StructField("l_quantity", T.StringType()),
            T.StructField("l_shipdate", T.DateType()),
        ]
    )
    return cast_to(table(spark, sf_dir, "lineitem"), target, "l_orderkey")[0]


@query
def cast_real_scale(spark, sf_dir):
    """Doubles rounded before they are compared, where a layer asks for it."""
    value, _ = C.cast_value(
        F.col("l_extendedprice") / 4, T.DoubleType(), T.StructField("p", T.LongType()), real_scale=0
    )
    return table(spark, sf_dir, "lineitem").groupBy(value.alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query
def cast_bool_words(spark, sf_dir):
    return view(spark, sf_dir, "words").select("id", X.bool_from_words(F.col("word")).alias("flag"))


# --- filters -----------------------------------------------------------------------------


@query
def filter_compare_between_in(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    layer_filter = "l_quantity between 10 and 20 and l_returnflag in ('A', 'R')"
    request_filter = "not (l_discount >= 0.05 or l_tax < 0.02) and l_linestatus <> 'F' and l_linenumber != 3"
    condition = P.compose_filter(layer_filter, request_filter)
    return P.apply_filter(lines, condition, "query").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"
    )


@query
def filter_ci_equality(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    chosen = P.eq_ci(segment, "Building") | P.in_ci(segment, ["machinery"]) & P.ne_ci(F.col("c_name"), "x")
    return customer.filter(chosen & (segment < "b")).select("c_custkey", "c_mktsegment").union(
        customer.filter(chosen & (segment >= "M")).select("c_custkey", "c_mktsegment")
    )


@query
def filter_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(P.like_ci(F.col("p_type"), "s%ARD")).select("p_partkey", "p_type")


# --- removal -------------------------------------------------------------------------------


def removed(target: DataFrame, sets) -> DataFrame:
    return P.flag_matches(target, P.parse_attribute_sets(sets)).filter("not _matched").drop("_matched")


@query
def remove_by_attributes(spark, sf_dir):
    source = view(spark, sf_dir, "src").drop("src_only")
    return removed(source, '[{"status": "F", "cust": "10"}, {}, {"status": null}]')


@query
def remove_by_many_sets(spark, sf_dir):
    """Enough sets to be joined instead of spelled out, over two column groups."""
    sets = [{"cust": str(n), "status": "F"} for n in range(1, 251)] + [{"status": None}]
    return removed(view(spark, sf_dir, "src").drop("src_only"), sets)


@query
def remove_by_criteria_table(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    criteria = customer.filter("c_nationkey < 5").select(F.col("c_custkey").alias("cust"), F.lit("F").alias("status"))
    flagged = P.flag_criteria_matches(view(spark, sf_dir, "tgt"), criteria)
    return flagged.filter("not _matched").drop("_matched")


@query
def attribute_sets_parse(spark, sf_dir):
    text = F.concat(
        F.lit('[{"cust":"'), F.col("c_custkey"), F.lit('","seg":"'), F.col("c_mktsegment"),
        F.lit('"},{},{"seg":null}]'),
    )
    sets = X.attribute_sets_from_json(text)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.size(sets).alias("n_sets"), sets[0]["seg"].alias("seg"),
        F.map_contains_key(sets[1], "seg").alias("has_null_seg"), sets[1]["seg"].isNull().alias("seg_is_null"),
    )


# --- full refresh ------------------------------------------------------------------------------


@query
def bulk_refresh(spark, sf_dir):
    target, staged = pair(spark, sf_dir)
    return A.refreshed_rows(target, staged)


@query
def bulk_truncate_count(spark, sf_dir):
    return A.rows_deleted_by_refresh(view(spark, sf_dir, "tgt_null"), ["k1", "k2"], "truncate")


@query
def bulk_delete_count(spark, sf_dir):
    return A.rows_deleted_by_refresh(view(spark, sf_dir, "tgt_null"), ["k1", "k2"], "delete")


# --- run log -------------------------------------------------------------------------------------


@query
def runlog_status(spark, sf_dir):
    return R.status_counts(view(spark, sf_dir, "runs"))


@query
def runlog_list(spark, sf_dir):
    return R.list_runs(view(spark, sf_dir, "runs"))


@query
def runlog_get(spark, sf_dir):
    return R.find_run(view(spark, sf_dir, "runs"), 42)


@query
def runlog_expire(spark, sf_dir):
    now = dt.datetime(2024, 1, 20, 0, 10)
    return R.unexpired(view(spark, sf_dir, "runs"), now)


@query
def runlog_json(spark, sf_dir):
    """Runs as JSON documents, read back into columns."""
    runs = view(spark, sf_dir, "runs").select(
        F.col("id").cast("string"),
        F.when(F.col("id") % 2 == 0, R.PULL).otherwise(R.REMOVE).alias("type"),
        "time_added", "time_finished", "status", F.lit("layer").alias("layer_name"), F.lit("a = 1").alias("filter"),
        F.lit('[{"a": "1", "b": null}]').alias("attribute_sets"), F.lit(None).cast("string").alias("message"),
        *[F.col("id").alias(c) for c in R.COUNTERS],
    )
    shown = R.run_json(runs)
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return shown.select(
        "id", field("timeAdded").alias("added"), field("timeFinished").alias("finished"), field("filter").alias("filter"),
        field("attributeSets").alias("sets"), field("numCreated").alias("created"),
    )


# --- names and text ----------------------------------------------------------------------------


@query
def nearest_layer_name(spark, sf_dir):
    """Closest table name to the first word of each part type, where close enough."""
    layers = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]
    wanted = F.lower(X.split_on(F.col("p_type"), " ")[0])
    near = nearest_name(wanted, layers)
    return table(spark, sf_dir, "part").select("p_partkey", wanted.alias("wanted"), near["name"].alias("name"), near["distance"].alias("distance"))


@query
def name_normalise(spark, sf_dir):
    """Lower-case names, then trim, split, join, replace and distance on text."""
    upper = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("KEY"), F.col("p_name").alias("Name"))
    named = lower_names(upper)
    padded = F.concat(F.lit("\t "), F.col("name"), F.lit(" \r\n"))
    parts = X.split_on(F.col("name"), " ")
    return named.select(
        "key",
        X.trim_chars(padded).alias("trimmed"),
        X.lower_name(F.col("name")).alias("lowered"),
        F.size(parts).alias("n_parts"),
        X.join_with(parts, "+").alias("joined"),
        X.replace_all(F.col("name"), "e", "ee").alias("replaced"),
        X.edit_distance(F.col("name"), F.lit("almond")).alias("distance"),
    )


@query
def value_text(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    stamp = F.col("o_orderdate")
    return orders.select(
        "o_orderkey",
        X.fixed_point(F.col("o_totalprice")).alias("fixed"),
        X.date_text(stamp).alias("day"),
        X.time_text(stamp).alias("clock"),
        X.timestamp_text(stamp).alias("stamp"),
        X.utc_instant_text(stamp).alias("instant"),
    )


# --- geometry ----------------------------------------------------------------------------------


def points(spark, sf_dir) -> DataFrame:
    pts = view(spark, sf_dir, "pts").withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double"))
    return pts.withColumn("geom", G.geometry(G.point_wkb("x", "y"), F.col("srid")))


@query
def geom_bad_values_quarantined(spark, sf_dir):
    """Points by text coordinates; those without numbers or too far north for the target are set aside."""
    pts = view(spark, sf_dir, "pts").select(
        "id", F.when(F.col("id") % 10 == 0, "n/a").otherwise(F.col("x").cast("string")).alias("x"),
        (F.col("y").cast("double") + 10).cast("string").alias("y"), F.col("srid").alias("code"),
    )
    root = work_folder(spark)
    pts.write.parquet(f"{root}/source/places.parquet")
    target = T.StructType([T.StructField("id", T.LongType()), C.geometry_field("geometry", G.MERCATOR, 2)])
    stored = SnapshotTable.create(spark, f"{root}/tables/geo/places", target, ["id"])
    spec = LayerSpec(
        "places", f"{root}/source", "places", "geo", "places", ignore_failures=True,
        geometry_source={"encoding": "xy", "x": "x", "y": "y"}, source_srid=G.DEGREES,
    )
    sync = TableSync(spark, f"{root}/tables", [spec])
    result = sync.pull("places")
    bad = sync.quarantine(spec, result.id).select("id", F.lit(True).alias("bad"))
    return stored.read().select("id", F.lit(False).alias("bad")).union(bad)


@query
def geom_srid_plan(spark, sf_dir):
    """Reference system and bytes after each kind of target column."""
    pts = points(spark, sf_dir)
    moved = G.to_target_srid(F.col("geom"), G.MERCATOR)
    return pts.select(
        "id",
        G.srid(G.to_target_srid(F.col("geom"), None)).alias("kept"),
        G.srid(G.to_target_srid(F.col("geom"), -1)).alias("undefined"),
        G.srid(moved).alias("moved"),
        (moved["wkb"] != F.col("geom.wkb")).alias("bytes_differ"),
    )


@query
def geom_reproject_points(spark, sf_dir):
    """Coordinates in the bytes after moving points to the other system and back."""
    there = G.transform(G.geometry(F.col("geom.wkb"), G.DEGREES), G.MERCATOR)
    moved = points(spark, sf_dir).select("id", there.alias("there"))
    moved = moved.select("id", "there", G.transform(F.col("there"), G.DEGREES).alias("back"))
    there, back = G.point_coordinates(F.col("there.wkb")), G.point_coordinates(F.col("back.wkb"))
    return moved.select(
        "id",
        F.round(there[0], 3).alias("mx"),
        F.round(there[1], 3).alias("my"),
        F.round(back[1], 6).alias("lat"),
        F.round(back[0], 6).alias("lon"),
    )


@query
def geom_utm_points(spark, sf_dir):
    """Degrees to a UTM zone, and what is stored there to web mercator."""
    near = view(spark, sf_dir, "pts").select("id", (15 + F.col("x") / 60).alias("x"), F.col("y").alias("y"))
    placed = near.select("id", G.geometry(G.point_wkb(F.col("x").cast("double"), F.col("y").cast("double")), G.DEGREES).alias("geom"))
    folder = f"{work_folder(spark)}/utm"
    placed.select("id", G.transform(F.col("geom"), 32633).alias("utm")).write.parquet(folder)
    moved = spark.read.parquet(folder)
    plane = moved.select("id", "utm", G.transform(F.col("utm"), G.MERCATOR)["wkb"].alias("plane"))
    at, flat = G.point_coordinates(F.col("utm.wkb")), G.point_coordinates(F.col("plane"))
    return plane.select(
        "id", G.srid(F.col("utm")).alias("srid"), F.round(at[0], 3).alias("east"), F.round(at[1], 3).alias("north"),
        F.round(flat[0], 3).alias("mx"), F.round(flat[1], 3).alias("my"),
    )


@query
def geom_is_collection(spark, sf_dir):
    """Type, dimension and embedded reference system of binary headers in both byte orders."""
    kind = F.col("c_custkey") % 7 + 1
    code = kind + F.when(F.col("c_custkey") % 2 == 0, F.lit(W_Z)).otherwise(F.lit(0))
    digits = F.lpad(F.hex(code), 8, "0")
    little = F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
    header = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("00"), digits)).otherwise(F.concat(F.lit("01"), little))
    wkb = F.unhex(F.concat(header, F.lit("00000000")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        G.geometry_kind(wkb).alias("kind"),
        G.is_collection(wkb).alias("collection"),
        G.coordinate_dimension(wkb).alias("dims"),
    )


W_Z = 0x80000000


@query
def geom_from_hex(spark, sf_dir):
    """Hexadecimal geometries with an embedded reference system."""
    plain = F.hex(F.col("geom.wkb"))
    srid = F.when(F.col("id") % 2 == 0, "E6100000").otherwise("110F0000")
    embedded = F.concat(F.lit("0101000020"), srid, F.substring(plain, 11, 32))
    read = G.geometry_from_hex(embedded)
    return points(spark, sf_dir).select(
        "id", read["srid"].alias("srid"), (G.geometry_hex(read) == plain).alias("same_bytes")
    )


@query
def geom_changed(spark, sf_dir):
    """Stored and new shapes: equal, reversed, moved, missing, in a collection."""
    at = lambda dx, dy: F.concat(
        F.lit("["), (F.col("x") + dx).cast("string"), F.lit(","), (F.col("y") + dy).cast("string"), F.lit("]")
    )
    line = lambda *pts: F.concat(F.lit("["), F.concat_ws(",", *pts), F.lit("]"))
    json = lambda kind, coords: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coords, F.lit("}"))
    forth, back = line(at(0, 0), at(1, 1), at(2, 5)), line(at(2, 5), at(1, 1), at(0, 0))
    case = F.col("id") % 6
    new = (
        F.when(case == 1, json("LineString", back))
        .when(case == 2, json("LineString", line(at(0, 0), at(1, 1), at(2, 6))))
        .when(case == 3, F.lit(None))
        .when(case == 4, json("MultiLineString", F.concat(F.lit("["), forth, F.lit("]"))))
        .when(case == 5, json("LineString", line(at(0, 0), at(1, 1), at(1, 1), at(2, 5))))
        .otherwise(json("LineString", forth))
    )
    shapes = points(spark, sf_dir).select(
        "id",
        G.geometry(G.geojson_wkb(json("LineString", forth)), G.DEGREES).alias("old"),
        G.geometry(G.geojson_wkb(new), G.DEGREES).alias("new"),
    )
    return shapes.select("id", F.coalesce(G.geometry_changed(F.col("old"), F.col("new")), F.lit(False)).alias("changed"))


# --- whole runs ----------------------------------------------------------------------------------


@query
def pull_published(spark, sf_dir):
    """Staging, change set, new version: what a reader of the target sees afterwards."""
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], allow_feature_deletion=True
    )
    sync.pull(spec.name)
    return stored.read()


@query
def pull_published_bucketed(spark, sf_dir):
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], buckets=8, allow_feature_deletion=True
    )
    sync.pull(spec.name)
    return stored.read()


@query
def pull_counters(spark, sf_dir):
    """Counters of a pull that ignores rows it cannot cast."""
    dirty = view(spark, sf_dir, "src_dirty")
    target = cast_to(dirty, DIRTY_TARGET, "id")[0].filter("id % 4 <> 0")
    # Old rows of source rows that are set aside now are not in the source any more.
    old = dirty.filter("id % 4 <> 0 and (user_txt = 'n/a' or day_txt = 'n/a')")
    old = old.select("id", F.lit(None).cast("long").alias("user_txt"), F.lit(None).cast("date").alias("day_txt"), "kind", "dbl")
    target = target.select(old.columns).union(old)
    target = target.withColumn("dbl", F.when(F.col("id") % 9 == 0, -F.lit(1.0)).otherwise(F.col("dbl")))
    sync, spec, _ = published(
        spark, view(spark, sf_dir, "src_dirty"), target, ["id"], ignore_failures=True, allow_feature_deletion=True
    )
    sync.pull(spec.name)
    return sync.log.list().select(
        "status", "num_pulled", "num_created", "num_updated", "num_deleted", "num_ignored"
    )


@query
def pull_override_published(spark, sf_dir):
    """A pull by another key than the table's own; the table stays bucketed."""
    target = view(spark, sf_dir, "tgt")
    source = view(spark, sf_dir, "src_segment").join(target.select("cust").distinct(), "cust", "left_semi")
    sync, spec, stored = published(spark, source, target, ["id"], buckets=4, primary_key_columns=("cust",))
    sync.pull(spec.name)
    return stored.read()


@query
def pull_override_inserts_published(spark, sf_dir):
    """A pull by a key that the table does not declare: rows it lacks are inserted, and it is written anew."""
    target = view(spark, sf_dir, "tgt")
    sync, spec, stored = published(spark, view(spark, sf_dir, "src_segment"), target, [], primary_key_columns=("cust",))
    sync.pull(spec.name)
    return stored.read()


@query
def pull_filter_ci_published(spark, sf_dir):
    """Comparisons of a request that ignore case."""
    sync, spec, stored = published(spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], allow_feature_deletion=True)
    conditions = [
        {"column": "src_only", "operator": "in", "value": ["1-urgent", "2-HIGH"]},
        {"column": "status", "operator": "like", "value": "f%"},
        {"column": "price", "operator": ">", "value": 50000},
    ]
    sync.pull(spec.name, conditions=conditions)
    return stored.read()


@query
def pull_filter_text_ci_published(spark, sf_dir):
    """Filter text: equality, lists and LIKE on texts ignore case at any depth; orderings mind it."""
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], allow_feature_deletion=True,
        filter="not (src_only = '3-medium' or src_only in ('4-NOT specified', 'none'))",
    )
    sync.pull(spec.name, "(status like 'F%' or status <=> null or (status <> 'o' and price < 90000)) and src_only < '2-h' and status >= 'A'")
    return stored.read()


@query
def pull_changed_files_published(spark, sf_dir):
    """Files that changed, went and came between two pulls; a third one finds nothing to read."""
    root, source, target = work_folder(spark), view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt")
    folder = f"{root}/source/layer.parquet"
    spec = LayerSpec("layer", f"{root}/source", "layer", "stored", "target", allow_feature_deletion=True)
    sync = TableSync(spark, f"{root}/tables", [spec])
    stored = SnapshotTable.create(spark, f"{root}/tables/stored/target", nullable(target.schema), ["id"], rows=target)
    for part in range(3):
        source.filter(F.col("id") % 3 == part).write.parquet(f"{folder}/k{part}")
    first = pull_changed_files(sync, "layer")
    changed = source.filter("id % 3 = 1 and id % 4 <> 0").withColumn("price", F.col("price") + 1)
    changed.write.mode("overwrite").parquet(f"{folder}/k1")
    files.delete(spark, f"{folder}/k2")
    source.filter("id % 3 = 2 and id % 5 = 0").write.parquet(f"{folder}/k3")
    second, third = pull_changed_files(sync, "layer"), pull_changed_files(sync, "layer")
    return stored.read().select(
        "*",
        F.lit(first.num_pulled).cast("long").alias("first_read"),
        F.lit(second.num_pulled).cast("long").alias("second_read"),
        F.lit(third is None).alias("third_idle"),
    )


@query
def pull_filtered_published(spark, sf_dir):
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], allow_feature_deletion=True,
        filter="src_only in ('1-URGENT', '2-HIGH')",
    )
    sync.pull(spec.name, "price > 50000")
    return stored.read()


@query
def pull_on_change_sets_published(spark, sf_dir):
    """A partial pull, published as a change set, then a full one on top of it."""
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], buckets=8, allow_feature_deletion=True,
        max_delta_share=1e9,
    )
    sync.pull(spec.name, "src_only in ('1-URGENT', '2-HIGH')")
    sync.pull(spec.name)
    return stored.read()


@query
def source_csv_published(spark, sf_dir):
    """Text files as source: every value is cast to the target's type."""
    target = view(spark, sf_dir, "tgt")
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), target, ["id"], source_format="csv", allow_feature_deletion=True
    )
    sync.pull(spec.name)
    return stored.read()


@query
def source_geojson_published(spark, sf_dir):
    """Line-delimited GeoJSON points, reprojected to the target's reference system."""
    root = work_folder(spark)
    at = F.array(F.col("x").cast("double"), F.col("y").cast("double"))
    features = view(spark, sf_dir, "pts").select(
        F.lit("Feature").alias("type"),
        F.struct("id", F.col("srid").alias("code")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), at.alias("coordinates")).alias("geometry"),
    )
    features.select(F.to_json(F.struct("*"))).write.text(f"{root}/source/places.geojsonl")
    target = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("code", T.IntegerType()), C.geometry_field("shape", G.MERCATOR, 2)]
    )
    stored = SnapshotTable.create(spark, f"{root}/tables/geo/places", target, ["id"])
    spec = LayerSpec(
        "places", f"{root}/source", "places", "geo", "places", source_format="geojsonseq",
        geometry_source={"encoding": "geojson"},
    )
    TableSync(spark, f"{root}/tables", [spec]).pull("places")
    geom, at = F.col("shape"), G.point_coordinates(F.col("shape.wkb"))
    return stored.read().select(
        "id", "code", G.srid(geom).alias("srid"), F.round(at[0], 3).alias("mx"), F.round(at[1], 3).alias("my")
    )


def _pulled_places(spark, rows: DataFrame, target: T.StructType, **settings):
    """A layer of places pulled into an empty table, and the rows it set aside."""
    root = work_folder(spark)
    rows.write.parquet(f"{root}/source/layer.parquet")
    stored = SnapshotTable.create(spark, f"{root}/tables/stored/target", target, ["id"])
    spec = LayerSpec("layer", f"{root}/source", "layer", "stored", "target", ignore_failures=True, **settings)
    result = TableSync(spark, f"{root}/tables", [spec]).pull("layer")
    return stored.read().withColumn("ignored", F.lit(result.num_ignored).cast("long"))


@query
def source_wkt_published(spark, sf_dir):
    """Well-known text with and without a reference system; every tenth text is broken."""
    at = lambda dx, dy: F.concat_ws(" ", (F.col("x") + dx).cast("string"), (F.col("y") + dy).cast("string"))
    ring = F.concat_ws(", ", at(0, 0), at(1, 0), at(1, 1), at(0, 0))
    text = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("POINT("), at(0, 0), F.lit(")")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("LineString ("), F.concat_ws(",", at(0, 0), at(1, 2)), F.lit(")")))
        .otherwise(F.concat(F.lit("MULTIPOLYGON((("), ring, F.lit(")))")))
    )
    named = F.when(F.col("srid") == 0, text).otherwise(F.concat(F.lit("SRID=4326;"), text))
    broken = F.when(F.col("id") % 10 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    rows = view(spark, sf_dir, "pts").withColumn("text", named).select("id", broken.alias("shape"))
    target = T.StructType([T.StructField("id", T.LongType()), C.geometry_field("shape")])
    places = _pulled_places(spark, rows, target, geometry_source={"encoding": "wkt", "column": "shape", "name": "shape"})
    geom = F.col("shape")
    read = places.select("id", "ignored", G.srid(geom).alias("srid"), G.geometry_kind(geom["wkb"]).alias("kind"), G.vertices(geom["wkb"]).alias("v"))
    last = F.element_at("v", -1)
    return read.select(
        "id", "ignored", "srid", "kind", F.size("v").alias("n"),
        F.col("v")[0][0].alias("x"), F.col("v")[0][1].alias("y"), last[0].alias("last_x"), last[1].alias("last_y"),
    )


@query
def source_gml_published(spark, sf_dir):
    """GML points whose official system names put the latitude first, brought to the target's system."""
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    official = F.concat(F.lit('<gml:Point srsName="urn:ogc:def:crs:EPSG::4326"><gml:pos>'), y, F.lit(" "), x, F.lit("</gml:pos></gml:Point>"))
    short = F.concat(F.lit('<gml:Point srsName="EPSG:4326"><gml:coordinates>'), x, F.lit(","), y, F.lit("</gml:coordinates></gml:Point>"))
    text = F.when(F.col("id") % 10 == 0, "<gml:Point><gml:pos>1</gml:pos></gml:Point>").when(F.col("id") % 2 == 0, official).otherwise(short)
    rows = view(spark, sf_dir, "pts").select("id", text.alias("shape"))
    target = T.StructType([T.StructField("id", T.LongType()), C.geometry_field("shape", G.MERCATOR, 2)])
    places = _pulled_places(spark, rows, target, geometry_source={"encoding": "gml", "column": "shape", "name": "shape"})
    at = G.point_coordinates(F.col("shape.wkb"))
    return places.select("id", "ignored", F.round(at[0], 3).alias("mx"), F.round(at[1], 3).alias("my"))


@query
def geom_truncated_quarantined(spark, sf_dir):
    """Bytes that hold less, more or other than their counts announce are set aside; what is stored stays."""
    at = lambda dx, dy: F.concat(
        F.lit("["), (F.col("x") + dx).cast("string"), F.lit(","), (F.col("y") + dy).cast("string"), F.lit("]")
    )
    shape = lambda kind, *pts: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), *pts, F.lit("}"))
    line = F.hex(G.geojson_wkb(shape("LineString", F.lit("["), F.concat_ws(",", at(0, 0), at(1, 1)), F.lit("]"))))
    ring = F.concat_ws(",", at(0, 0), at(1, 0), at(1, 1), at(0, 0))
    polygon = F.hex(G.geojson_wkb(shape("Polygon", F.lit("[["), ring, F.lit("]]"))))
    case = F.col("id") % 8
    text = (
        F.when(case == 0, F.expr("left(line, length(line) - 16)"))
        .when(case == 1, F.col("line"))
        .when(case == 2, F.col("polygon"))
        .when(case == 3, F.expr("left(polygon, length(polygon) - 32)"))
        .when(case == 4, "0000000002FFFFFFFF")
        .when(case == 5, "000000000700000000")
        .when(case == 6, F.concat(F.lit("010400000001000000"), F.col("line")))
        .otherwise(F.concat(F.col("line"), F.lit("00")))
    )
    shapes = view(spark, sf_dir, "pts").withColumns({"line": line, "polygon": polygon}).select("id", text.alias("shape"), "line")
    before = shapes.filter("id % 8 in (0, 4)").select("id", G.geometry_from_hex(F.col("line"), 0).alias("shape"))
    sync, spec, stored = published(
        spark, shapes.drop("line"), before, ["id"],
        geometry_source={"encoding": "hex", "column": "shape", "name": "shape", "byte_order": "mixed"}, ignore_failures=True,
    )
    result = sync.pull(spec.name)
    wkb = F.col("shape.wkb")
    return stored.read().select(
        "id", G.geometry_kind(wkb).alias("kind"), F.octet_length(wkb).alias("n_bytes"),
        F.lit(result.num_ignored).cast("long").alias("ignored"), F.lit(result.num_created).cast("long").alias("created"),
    )


@query
def failures_change_nothing(spark, sf_dir):
    """Requests that fail, each for its own reason: what the log says about them, and the target as it was."""
    source = view(spark, sf_dir, "src")
    target = view(spark, sf_dir, "tgt")
    root = work_folder(spark)
    source.write.parquet(f"{root}/source/layer.parquet")
    source.select("id", F.col("src_only").alias("price")).write.parquet(f"{root}/source/words.parquet")
    points = F.concat(F.lit("POINT("), F.col("id").cast("string"), F.lit(" 1)"))
    source.select("id", points.alias("shape")).write.parquet(f"{root}/source/shapes.parquet")
    fields = [*nullable(target.schema).fields, C.geometry_field("shape", G.DEGREES, 3)]
    fields = [T.StructField(f.name, f.dataType, f.name != "status", f.metadata) for f in fields]
    known = target.filter("status is not null").withColumn("shape", F.lit(None).cast(G.GEOMETRY))
    stored = SnapshotTable.create(spark, f"{root}/tables/stored/target", T.StructType(fields), ["id"], rows=known)
    layers = [
        LayerSpec("plain", f"{root}/source", "layer", "stored", "target"),
        LayerSpec("words", f"{root}/source", "words", "stored", "target"),
        LayerSpec("shapes", f"{root}/source", "shapes", "stored", "target", geometry_source={"encoding": "wkt", "column": "shape", "name": "shape"}),
        LayerSpec("closed", f"{root}/source", "layer", "stored", "target", enabled=False),
        LayerSpec("absent", f"{root}/source", "leyer", "stored", "target"),
    ]
    sync = TableSync(spark, f"{root}/tables", layers)
    requests = {
        "filter of an unknown column": lambda: sync.pull("plain", "nowhere = 1"),
        "missing value": lambda: sync.pull("plain"),
        "value that does not fit": lambda: sync.pull("words"),
        "geometry of another dimension": lambda: sync.pull("shapes"),
        "deletion without leave": lambda: sync.remove_by_attributes("plain", [{"status": "F"}]),
        "layer that is closed": lambda: sync.pull("closed"),
        "layer that is missing": lambda: sync.pull("absent"),
        "request without a layer": lambda: sync.pull_request('{"filter": "id = 1"}'),
    }
    for request in requests.values():
        try:
            request()
        except (SyncError, ValueError):
            pass
    said = sync.jobs().select("layer_name", "status", "message")
    reason = (
        F.when(F.col("message").contains("nowhere"), "filter")
        .when(F.col("message").contains("NOT NULL or geometry rule"), "rule")
        .when(F.col("message").contains("cannot take"), "value")
        .when(F.col("message").contains("does not permit"), "deletion")
        .when(F.col("message").contains("layer"), F.concat(F.lit("near "), F.regexp_extract("message", 'closest name there is "([^"]*)"', 1)))
    )
    return said.select("layer_name", "status", reason.alias("reason")).withColumn("rows", F.lit(stored.read().count()).cast("long"))


@query
def run_by_id(spark, sf_dir):
    """A run as its document shows it, looked up by its id."""
    sync, spec, _ = published(spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"])
    sync.pull(spec.name)
    shown = sync.job(sync.pull(spec.name, "price > 50000").id)
    names = ["status", "layerName", "type", "filter", "numPulled", "numCreated", "numUpdated"]
    return view(spark, sf_dir, "src").limit(1).select(*[F.lit(str(shown.get(n))).alias(n) for n in names])


DOCUMENT_IDS = 100_000


@query
def source_geojson_document_published(spark, sf_dir):
    """Documents of one line each, read by several tasks, with texts that look like their structure."""
    root = work_folder(spark)
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("x").cast("string"), F.col("y").cast("string"))
    note = F.when(F.col("id") % 3 == 0, '}]},{\\"type\\":\\"Feature\\"').when(F.col("id") % 3 == 1, "{[[").otherwise("\\\\")
    feature = F.format_string('{"type":"Feature","properties":{"id":"%s","note":"%s"},"geometry":%s}', F.col("id").cast("string"), note, point)
    features = F.array_join(F.array_sort(F.collect_list(feature)), ",")
    head = '{"type":"FeatureCollection","crs":{"type":"name"},"links":[{"type":"Link"}],"features":['
    # A document is one value of one task: each has the features of a bounded range of ids.
    parts = [(F.col("id") % 2).alias("half"), F.floor(F.col("id") / DOCUMENT_IDS).alias("part")]
    cores = spark.sparkContext.defaultParallelism
    rows = view(spark, sf_dir, "pts").select("*", *parts).repartition(3 * cores, "half", "part")
    document = rows.groupBy("half", "part").agg(F.concat(F.lit(head), features, F.lit("]}")).alias("value"))
    document.select("value").write.text(f"{root}/source/places.geojson")
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), C.geometry_field("geometry")])
    stored = SnapshotTable.create(spark, f"{root}/tables/geo/places", target, ["id"])
    spec = LayerSpec(
        "places", f"{root}/source", "places", "geo", "places", source_format="geojson", geometry_source={"encoding": "geojson"},
        source_schema="id string, note string",
    )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Short ranges, so that documents of any table are cut; as many as the cores need, not more with each row.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(20000, files.size(spark, f"{root}/source/places.geojson") // (4 * cores))))
    try:
        TableSync(spark, f"{root}/tables", [spec]).pull("places")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    at = G.point_coordinates(F.col("geometry.wkb"))
    return stored.read().select("id", "note", at[0].alias("x"), at[1].alias("y"))


@query
def geojson_lines_quarantined(spark, sf_dir):
    """Records with the separator of JSON sequences are read, broken ones set aside."""
    root = work_folder(spark)
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', F.col("x").cast("string"), F.col("y").cast("string"))
    whole = F.format_string('{"type":"Feature","properties":{"id":"%s"},"geometry":%s}', F.col("id").cast("string"), point)
    line = F.when(F.col("id") % 10 == 0, F.substring(whole, 1, 40)).otherwise(F.concat(F.lit("\x1e"), whole))
    view(spark, sf_dir, "pts").select(line.alias("value")).write.text(f"{root}/source/places.geojsons")
    target = T.StructType([T.StructField("id", T.LongType()), C.geometry_field("geometry")])
    stored = SnapshotTable.create(spark, f"{root}/tables/geo/places", target, ["id"])
    spec = LayerSpec(
        "places", f"{root}/source", "places", "geo", "places", source_format="geojsonseq",
        geometry_source={"encoding": "geojson"}, ignore_failures=True,
    )
    result = TableSync(spark, f"{root}/tables", [spec]).pull("places")
    at = G.point_coordinates(F.col("geometry.wkb"))
    return stored.read().select("id", at[0].alias("x"), at[1].alias("y"), F.lit(result.num_ignored).cast("long").alias("ignored"))


@query
def source_xml_published(spark, sf_dir):
    """Row elements of a folder of XML documents; identifiers are attributes."""
    root = work_folder(spark)
    rows = view(spark, sf_dir, "pts").select(F.col("id").alias("_id"), F.col("srid").alias("code"))
    rows.write.option("rowTag", "place").option("rootTag", "places").xml(f"{root}/source.xml")
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.IntegerType())])
    stored = SnapshotTable.create(spark, f"{root}/tables/geo/places", target, ["id"])
    spec = LayerSpec("places", f"{root}/source.xml", "place", "geo", "places", source_format="xml")
    TableSync(spark, f"{root}/tables", [spec]).pull("places")
    return stored.read()


@query
def bulk_published(spark, sf_dir):
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], bulk_mode=True,
        bulk_delete_method="truncate",
    )
    sync.pull(spec.name)
    return stored.read()


@query
def remove_published(spark, sf_dir):
    source = view(spark, sf_dir, "src").drop("src_only")
    sync, spec, stored = published(spark, source, source, ["id"], allow_feature_deletion=True)
    sync.remove_by_attributes(spec.name, [{"status": "F", "cust": "10"}, {"status": None}])
    return stored.read()


@query
def change_feed_published(spark, sf_dir):
    """Changed rows as stored next to the version they led to."""
    sync, spec, stored = published(
        spark, view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt"), ["id"], allow_feature_deletion=True
    )
    sync.pull(spec.name)
    return stored.changes().withColumnRenamed(D.OP, "op")


@query
def partitions_overwritten(spark, sf_dir):
    """Change set applied to a partitioned folder, touched partitions only."""
    folder = work_folder(spark)
    keep = ["id", "cust", "price", "note", "status"]
    view(spark, sf_dir, "tgt").select(*keep).write.partitionBy("status").parquet(f"{folder}/table")
    target = spark.read.parquet(f"{folder}/table")
    staged = mapped(view(spark, sf_dir, "src"), target, ["id"])
    changes = D.changes_of(D.classify(target, staged, ["id"], null_safe=False))
    changes.write.parquet(f"{folder}/changes")
    stored = spark.read.parquet(f"{folder}/changes")
    overwrite_partitions(f"{folder}/table", target, stored, ["id"], ["status"], f"{folder}/work")
    return spark.read.parquet(f"{folder}/table").select(*keep)


@query
def partitions_null_and_escaped(spark, sf_dir):
    """Partitions whose folders are not named by their values are emptied by the change set."""
    folder = work_folder(spark)
    part = F.element_at(F.array(F.lit(None).cast("string"), F.lit("a:b"), F.lit("a/b"), F.lit("50%"), F.lit("z")), (F.col("id") % 5 + 1).cast("int"))
    view(spark, sf_dir, "tgt").select("id", "note", part.alias("part")).write.partitionBy("part").parquet(f"{folder}/table")
    schema = "id bigint, note string, part string"
    target = spark.read.schema(schema).parquet(f"{folder}/table")
    staged = view(spark, sf_dir, "src").select("id", F.lit("z").alias("part"))
    D.changes_of(D.classify(target, staged, ["id"], deletion=True, null_safe=False)).write.parquet(f"{folder}/changes")
    stored = spark.read.parquet(f"{folder}/changes")
    overwrite_partitions(f"{folder}/table", target, stored, ["id"], ["part"], f"{folder}/work")
    return spark.read.schema(schema).parquet(f"{folder}/table")


@query
def remove_bad_literal(spark, sf_dir):
    """A text that its column cannot hold fails the removal, also where casts are lenient; the target stays."""
    source = view(spark, sf_dir, "src").drop("src_only")
    sync, spec, stored = published(spark, source, source, ["id"], allow_feature_deletion=True)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        sync.remove_by_attributes(spec.name, [{"cust": "abc"}])
    except SyncError:
        pass
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    failed = sync.status()["num_failed_jobs"]
    return stored.read().withColumn("failed", F.lit(failed).cast("long"))


@query
def stream_layer_filter(spark, sf_dir):
    """The layer's own filter holds for rows that arrive in a stream."""
    source, target = view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt")
    sync, spec, stored = published(spark, source, target, ["id"], filter="status = 'F'")
    arriving = f"{work_folder(spark)}/arriving"
    source.write.parquet(arriving)
    rows = spark.readStream.schema(source.schema).parquet(arriving)
    incremental_pull(sync, spec.name, rows, f"{work_folder(spark)}/progress").awaitTermination()
    return stored.read()


@query
def stream_late_rows_published(spark, sf_dir):
    """Files arrive newest first; the target keeps the order column, so older rows never replace newer ones."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    known = events.filter("event_id % 50 = 0").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("e"))
    known = known.select("user_id", "e.*")
    sync, spec, stored = published(
        spark, events, known, ["user_id"], on_duplicate_key="latest", order_by="event_id", keep_newer=True
    )
    arriving, size = f"{work_folder(spark)}/arriving", events.count() // 4 + 1
    for part in (3, 2, 1, 0):
        events.filter(F.floor(F.col("event_id") / size) == part).write.mode("append").parquet(arriving)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    incremental_pull(sync, spec.name, rows, f"{work_folder(spark)}/progress").awaitTermination()
    return stored.read()


@query
def stream_incremental(spark, sf_dir):
    """Source files upserted batch by batch; nothing is deleted."""
    source, target = view(spark, sf_dir, "src"), view(spark, sf_dir, "tgt")
    sync, spec, stored = published(spark, source, target, ["id"], allow_feature_deletion=True)
    arriving = f"{work_folder(spark)}/arriving"
    source.repartition(2, "id").write.parquet(arriving)
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    incremental_pull(sync, spec.name, rows, f"{work_folder(spark)}/progress").awaitTermination()
    return stored.read()
