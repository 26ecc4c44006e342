import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablesync.functions import text as X
from tablesync.functions.nearest import nearest_name
from tablesync.sources.readers import nearest_layer


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_trim(spark):
    assert one(spark, X.trim_chars(F.lit(" \t a b\r\n"))) == "a b"
    assert one(spark, X.trim_chars(F.lit("xxaxx"), "x")) == "a"
    assert one(spark, X.trim_chars(F.lit("  "), keep_blank=True)) == "  "
    assert one(spark, X.trim_chars(F.lit("  "))) == ""


def test_split_and_join(spark):
    assert one(spark, X.split_on(F.lit("a,,b,"), ",")) == ["a", "", "b", ""]
    assert one(spark, X.split_on(F.lit(""), ",")) == [""]
    assert one(spark, X.split_on(F.lit("a.b"), ".")) == ["a", "b"]
    assert one(spark, X.join_with(F.array(F.lit("a"), F.lit("b")), ", ")) == "a, b"
    assert one(spark, X.join_with(F.array().cast("array<string>"), ", ")) == ""


def test_replace(spark):
    assert one(spark, X.replace_all(F.lit("xx"), "x", "yx")) == "yxyx"
    assert one(spark, X.replace_all(F.lit("xx"), "", "y")) == "xx"


def test_edit_distance(spark):
    assert one(spark, X.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, X.edit_distance(F.lit(""), F.lit("abc"))) == 3


def test_value_texts(spark):
    stamp = F.lit(dt.datetime(2013, 1, 2, 3, 4, 5)).cast("timestamp_ntz")
    assert one(spark, X.fixed_point(F.lit(1.5))) == "1.500000"
    assert one(spark, X.date_text(stamp)) == "2013-01-02"
    assert one(spark, X.time_text(stamp)) == "03:04:05"
    assert one(spark, X.timestamp_text(stamp)) == "2013-01-02T03:04:05"
    assert one(spark, X.utc_instant_text(stamp)) == "2013-01-02T03:04:05Z"


def test_nearest(spark):
    names = ["africa", "asia", "asis"]
    assert one(spark, nearest_name(F.lit("asic"), names))["name"] == "asia"
    assert one(spark, nearest_name(F.lit("x" * 20), names)) is None
    assert one(spark, nearest_name(F.lit("x"), [])) is None
    assert nearest_layer(spark, "asic", names) == ("asia", 1)
    assert nearest_layer(spark, "x" * 20, names) is None
    assert nearest_layer(spark, "x", []) is None


@pytest.mark.parametrize("word, flag", [("Yes", True), ("'t'", True), ("0", False), ("N ", False), ("on", None)])
def test_bool_words(spark, word, flag):
    assert one(spark, X.bool_from_words(F.lit(word))) is flag
