import pytest
from pyspark.sql import types as T

from tablesync.functions.geometry import GEOMETRY
from tablesync.operators.columns import plan_columns
from tablesync.spec import SyncError


def schema(**columns):
    kinds = {"i": T.IntegerType(), "s": T.StringType(), "g": GEOMETRY}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


def test_columns_map_by_name():
    plan = plan_columns("a", schema(id="i", name="s", extra="s"), schema(id="i", name="s", note="s"), ["id"])
    assert plan.mapped == {"id": "id", "name": "name"}
    assert plan.updates == ["name"] and plan.keys_from_table


def test_geometry_maps_whatever_its_name():
    plan = plan_columns("a", schema(id="i", shape="g"), schema(id="i", the_geom="g"), ["id"])
    assert plan.mapped["the_geom"] == "shape" and plan.geometry == "the_geom"


def test_source_text_named_like_the_geometry_is_not_mapped_twice():
    plan = plan_columns("a", schema(id="i", the_geom="s", shape="g"), schema(id="i", the_geom="g"), ["id"])
    assert plan.mapped == {"id": "id", "the_geom": "shape"}


def test_override_frees_the_table_key():
    plan = plan_columns("a", schema(id="i", code="s"), schema(id="i", code="s"), ["id"], ["code"])
    assert plan.keys == ("code",) and plan.updates == ["id"] and not plan.keys_from_table


def test_all_key_table_has_nothing_to_update():
    assert plan_columns("a", schema(id="i"), schema(id="i"), ["id"]).updates == []


@pytest.mark.parametrize(
    "source, target, key, override, message",
    [
        (dict(id="i", a="g", b="g"), dict(id="i"), ["id"], [], "source .* 2 geometry"),
        (dict(id="i"), dict(id="i", a="g", b="g"), ["id"], [], "target .* several geometry"),
        (dict(id="i"), dict(id="i"), ["id"], ["nope"], "configured key column"),
        (dict(id="i"), dict(id="i"), [], [], "no primary key"),
        (dict(name="s"), dict(id="i", name="s"), ["id"], [], "lacks key columns: id"),
        (dict(name="s"), dict(id="i", name="s"), ["id"], ["name", "id"], "lacks key columns: id"),
    ],
)
def test_plan_errors(source, target, key, override, message):
    with pytest.raises(SyncError, match=message):
        plan_columns("a", schema(**source), schema(**target), key, override)


def test_repeated_target_name():
    target = T.StructType([T.StructField("id", T.IntegerType())] * 2)
    with pytest.raises(SyncError, match="repeats"):
        plan_columns("a", schema(id="i"), target, ["id"])
