import pytest

from tablesync import LayerSpec, SpecError, TableSync, UnknownLayerError, parse_request

BASE = {"source": "/data", "source_layer": "a", "target_table_schema": "s", "target_table_name": "t"}


def test_settings_from_text():
    spec = LayerSpec.from_settings(
        "a",
        {
            **BASE,
            "allow_feature_deletion": " 'Yes' ",
            "ignore_failures": "n",
            "primary_key_columns": " id, ,'code'",
            "bulk_mode": "T",
            "bulk_delete_method": " TRUNCATE ",
            "filter": "1 = 1",
        },
    )
    assert spec.allow_feature_deletion and not spec.ignore_failures and spec.bulk_mode
    assert spec.primary_key_columns == ("id", "code")
    assert spec.bulk_delete_method == "truncate"
    assert spec.target == "s.t"


def test_defaults():
    spec = LayerSpec.from_settings("a", BASE)
    assert spec.enabled
    assert not (spec.allow_feature_deletion or spec.ignore_failures or spec.bulk_mode)
    assert spec.bulk_delete_method == "delete" and spec.primary_key_columns == ()


@pytest.mark.parametrize("missing", sorted(BASE))
def test_mandatory_settings(missing):
    with pytest.raises(SpecError, match=missing):
        LayerSpec.from_settings("a", {k: v for k, v in BASE.items() if k != missing})


@pytest.mark.parametrize(
    "extra, message",
    [
        ({"colour": "red"}, "no setting called"),
        ({"bulk_mode": "maybe"}, "yes nor a no"),
        ({"bulk_delete_method": "drop"}, "none of delete"),
        ({"real_scale": "six"}, "no number"),
        ({"on_duplicate_key": "latest"}, "order_by"),
        ({"key_nulls": "x"}, "null policy"),
    ],
)
def test_bad_settings(extra, message):
    with pytest.raises(SpecError, match=message):
        LayerSpec.from_settings("a", {**BASE, **extra})


def test_disabled_layer_is_checked_then_unknown(spark, folder):
    with pytest.raises(SpecError):
        LayerSpec.from_settings("a", {"enabled": "no"})
    sync = TableSync(spark, folder, [LayerSpec.from_settings("a", {**BASE, "enabled": "no"})])
    assert sync.layers() == []
    with pytest.raises(UnknownLayerError):
        sync.pull("a")


def test_layers_are_listed_by_name(spark, folder):
    specs = [LayerSpec.from_settings(n, {**BASE, "description": n.upper()}) for n in ("b", "a")]
    listed = TableSync(spark, folder, specs).layers()
    assert listed == [{"name": "a", "description": "A"}, {"name": "b", "description": "B"}]


@pytest.mark.parametrize(
    "document, message",
    [
        ("{", "JSON"),
        ("[]", "object"),
        ("{}", "layerName"),
        ('{"layerName": 1}', "layerName"),
        ('{"layerName": "a", "filter": 3}', "filter"),
        ('{"layerName": "a", "attributeSets": {}}', "list"),
        ('{"layerName": "a", "attributeSets": [1]}', "object"),
        ('{"layerName": "a", "attributeSets": [{"x": 1}]}', "no text"),
    ],
)
def test_bad_requests(document, message):
    with pytest.raises(ValueError, match=message):
        parse_request(document)


def test_good_request():
    request = parse_request('{"layerName": "a", "filter": " id = 4 \\n", "attributeSets": [{}, {"x": null}]}')
    assert request == {"layerName": "a", "filter": "id = 4", "attributeSets": [{"x": None}]}
