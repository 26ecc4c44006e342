import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.geometry import geometry, point_wkb
from tablesync.operators import casting as C
from tablesync.operators.columns import plan_columns
from tablesync.spec import SyncError

INT, LONG, DBL, TXT = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
DAY, STAMP, BOOL = T.DateType(), T.TimestampNTZType(), T.BooleanType()


def cast_all(spark, values, source, field, **options):
    """``{value: (cast, bad)}`` in input order, as a list."""
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", source)]))
    value, bad = C.cast_value(F.col("v"), source, field, **options)
    return [(r["value"], r["bad"]) for r in df.select(value.alias("value"), bad.alias("bad")).collect()]


def field(data_type, **metadata):
    return T.StructField("v", data_type, True, metadata)


def good(*values):
    return [(v, False) for v in values]


BAD = (None, True)


def test_text_to_integer(spark):
    found = cast_all(spark, ["5", " -7 ", "+3", None, "n/a", "", "1.5", "99999999999"], TXT, field(INT))
    assert found == good(5, -7, 3, None) + [BAD] * 4


def test_text_to_double(spark):
    found = cast_all(spark, ["1.5", " 2e3", ".5", "-1", "1d", "x", ""], TXT, field(DBL))
    assert found == good(1.5, 2000.0, 0.5, -1.0) + [BAD] * 3


def test_double_to_integer_rounds_half_even(spark):
    found = cast_all(spark, [0.5, 1.5, 2.5, -2.5, 2.4, None, 1e12, float("nan")], DBL, field(INT))
    assert found == good(0, 2, 2, -2, 2, None) + [BAD] * 2


def test_wide_integers_keep_their_value(spark):
    assert cast_all(spark, [2**40], LONG, field(LONG)) == good(2**40)
    assert cast_all(spark, [2**40, 7], LONG, field(INT)) == [BAD, (7, False)]


def test_text_to_date(spark):
    values = ["2013-10-08", "2013/1/9", "20131008", "2013-10-08T11:12:13Z", "", None]
    d = dt.date(2013, 10, 8)
    assert cast_all(spark, values, TXT, field(DAY)) == good(d, dt.date(2013, 1, 9), d, d, None, None)
    assert cast_all(spark, ["2013-1", "2013-02-30", "n/a", "8.10.2013", "2013-10-08x"], TXT, field(DAY)) == [BAD] * 5


def test_text_to_timestamp_drops_the_zone(spark):
    values = ["2013-10-08 11:12:13.5", "2013-10-08T11:12:13+02:00", "2013/10/8 1:02", "2013-10-08", ""]
    expected = good(
        dt.datetime(2013, 10, 8, 11, 12, 13, 500000), dt.datetime(2013, 10, 8, 11, 12, 13),
        dt.datetime(2013, 10, 8, 1, 2), dt.datetime(2013, 10, 8), None,
    )
    assert cast_all(spark, values, TXT, field(STAMP)) == expected
    assert cast_all(spark, ["2013-10-08 25:00", "soon"], TXT, field(STAMP)) == [BAD] * 2


def test_time_of_day(spark):
    time = C.time_of_day("v")
    found = cast_all(spark, ["7:05", "23:59:58.25", "", None, "24:00", "noon"], TXT, time)
    assert found == good("07:05:00", "23:59:58", None, None) + [BAD] * 2
    assert cast_all(spark, [dt.datetime(2020, 1, 1, 4, 5, 6)], STAMP, time) == good("04:05:06")


def test_empty_text_stays_for_text(spark):
    assert cast_all(spark, ["", None], TXT, field(TXT)) == good("", None)


def test_varchar_limit_ignores_trailing_blanks(spark):
    found = cast_all(spark, ["abcd", "abcd  ", "abcde", "ab"], TXT, C.varchar("v", 4))
    assert [f[1] for f in found] == [False, False, True, False]
    assert [f[0] for f in found if not f[1]] == ["abcd", "abcd", "ab"]


def test_limit_of_catalog_varchar(spark):
    spark.sql("create or replace temporary view limited as select cast('x' as string) v")
    declared = T.StructField("v", TXT, True, {"__CHAR_VARCHAR_TYPE_STRING": "varchar(3)"})
    assert C.max_length(declared) == 3
    assert cast_all(spark, ["abcd"], TXT, declared)[0][1]


def test_numbers_to_text(spark):
    values = [1.0, 1.5, -0.25, 0.0, 123456789.25, 1e20, 0.1]
    found = cast_all(spark, values, DBL, field(TXT))
    assert found == good("1", "1.5", "-0.25", "0", "123456789.25", "1.0E20", "0.1")


def test_booleans(spark):
    found = cast_all(spark, ["yes", " T ", '"1"', "No", "f", "0", "maybe", None], TXT, field(BOOL))
    assert found == good(True, True, True, False, False, False) + [BAD] + good(None)


def test_real_scale(spark):
    assert cast_all(spark, [0.12345678], DBL, field(DBL), real_scale=6) == good(0.123457)


def test_arrays(spark):
    found = cast_all(spark, [["1", "2"], ["1", "x"], [None], None], T.ArrayType(TXT), field(T.ArrayType(INT)))
    assert found == [([1, 2], False), ([1, None], True), ([None], False), (None, False)]
    text = cast_all(spark, [['a"b', "c\\"]], T.ArrayType(TXT), field(TXT))
    assert text == good('{"a\\"b","c\\\\"}')
    assert cast_all(spark, [[1, 2]], T.ArrayType(INT), field(TXT)) == good("{1,2}")


def test_binary(spark):
    assert cast_all(spark, [b"\x00\x01", None], T.BinaryType(), field(T.BinaryType())) == good(b"\x00\x01", None)


@pytest.mark.parametrize(
    "source, target", [(DAY, INT), (DBL, BOOL), (T.MapType(TXT, TXT), TXT), (INT, DAY), (T.BinaryType(), TXT), (TXT, T.BinaryType())]
)
def test_unsupported_casts_fail_at_plan_time(spark, source, target):
    with pytest.raises(SyncError, match="no cast"):
        C.cast_value(F.col("v"), source, field(target))


def staged(spark, rows, schema, target):
    source = spark.createDataFrame(rows, schema)
    return C.cast_rows(source, target, plan_columns("a", source.schema, target, ["id"]))


TARGET = T.StructType([T.StructField("id", INT, False), T.StructField("n", INT), C.varchar("code", 2)])


def test_rows_are_split(spark):
    rows = staged(spark, [("1", "2", "ab"), ("2", "x", "abc"), ("3", None, None)], "id string, n string, code string", TARGET)
    ok, bad = C.split_rows(rows)
    assert sorted(r["id"] for r in ok.collect()) == [1, 3]
    assert ok.columns == ["id", "n", "code"]
    (row,) = bad.collect()
    assert [(e["column"], e["value"]) for e in row[C.ERRORS]] == [("n", "x"), ("code", "abc")]


def test_failing_on_errors_names_column_and_value(spark):
    rows = staged(spark, [("1", "x", "ab")], "id string, n string, code string", TARGET)
    with pytest.raises(Exception, match="column n cannot take x"):
        C.failing_on_errors(rows).collect()


def test_constraints(spark):
    target = T.StructType([T.StructField("id", INT, False), C.geometry_field("g", 4326, 2)])
    point = point_wkb(F.col("x"), F.col("x"))
    rows = spark.createDataFrame([(1, 4326, 1.0), (None, 4326, 1.0), (3, 3857, 1.0), (4, None, None)], "id int, s int, x double")
    rows = rows.select("id", geometry(point, F.col("s")).alias("g"))
    broken = rows.filter(C.breaks_constraints(target, ["id", "g"]))
    assert sorted((r["id"] for r in broken.collect()), key=str) == [3, None]
