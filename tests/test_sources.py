import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import queries
from tablesync import LayerSpec, SyncError
from tablesync.sources.geojson import feature_texts
from tablesync.sources.readers import lower_names, open_layer, read_source
from tests.test_plans import settings


def layer(source, source_layer, **settings):
    return LayerSpec("a", source, source_layer, "s", "t", **settings)


ROWS = [(1, "x", 1.5), (2, "y", None)]
SCHEMA = "ID int, Name string, v double"


@pytest.mark.parametrize("source_format, ending", [("parquet", "parquet"), ("orc", "orc"), ("json", "json")])
def test_columnar_and_json(spark, folder, source_format, ending):
    spark.createDataFrame(ROWS, SCHEMA).write.format(source_format).save(f"{folder}/data/places.{ending}")
    df = read_source(spark, layer(f"{folder}/data", "places", source_format=source_format))
    assert sorted(df.columns) == ["id", "name", "v"]
    assert sorted((r["id"], r["name"], r["v"]) for r in df.collect()) == ROWS


def test_csv_has_a_header_and_text_columns(spark, folder):
    spark.createDataFrame(ROWS, SCHEMA).write.option("header", True).csv(f"{folder}/data/places.csv")
    df = read_source(spark, layer(f"{folder}/data", "places", source_format="csv"))
    assert df.columns == ["id", "name", "v"] and {f.dataType for f in df.schema} == {T.StringType()}
    assert sorted(r["id"] for r in df.collect()) == ["1", "2"]


def test_single_file_is_its_own_layer(spark, folder):
    with open(f"{folder}/places.csv", "w") as f:
        f.write("id,name\n1,x\n")
    df = read_source(spark, layer(f"{folder}/places.csv", "Places", source_format="csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "x")]


def test_xml_attributes_become_columns(spark, folder):
    os.makedirs(f"{folder}/data")
    with open(f"{folder}/data/places.xml", "w") as f:
        f.write('<all><place code="A"><id>1</id></place><place code="B"><id>2</id></place></all>')
    options = {"rowTag": "place"}
    df = read_source(spark, layer(f"{folder}/data", "places", source_format="xml", source_options=options))
    assert sorted((r["code"], r["id"]) for r in df.collect()) == [("A", 1), ("B", 2)]


def test_table_in_a_database(spark, folder):
    spark.sql("create database if not exists geo")
    spark.createDataFrame(ROWS, SCHEMA).write.mode("overwrite").option("path", f"{folder}/t").saveAsTable("geo.places")
    df = read_source(spark, layer("geo", "places", source_format="table"))
    assert df.count() == 2
    with pytest.raises(SyncError, match='closest name there is "places"'):
        read_source(spark, layer("geo", "place", source_format="table"))
    with pytest.raises(SyncError, match="cannot be opened"):
        read_source(spark, layer("nowhere", "places", source_format="table"))


FEATURES = [
    {"type": "Feature", "id": "7", "properties": {"name": "x", "n": 3}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    {"type": "Feature", "id": "8", "properties": {"name": "y"}, "geometry": None},
]


@pytest.mark.parametrize("source_format, ending", [("geojson", "geojson"), ("geojsonseq", "geojsonl")])
def test_geojson(spark, folder, source_format, ending):
    os.makedirs(f"{folder}/data")
    with open(f"{folder}/data/places.{ending}", "w") as f:
        if source_format == "geojson":
            json.dump({"type": "FeatureCollection", "features": FEATURES}, f, indent=1)
        else:
            f.write("\n".join(json.dumps(feature) for feature in FEATURES))
    spec = layer(f"{folder}/data", "places", source_format=source_format, geometry_source={"encoding": "geojson"})
    rows = {r["fid"]: r for r in read_source(spark, spec).collect()}
    assert (rows["7"]["name"], rows["7"]["n"], rows["7"]["geometry"]["srid"]) == ("x", "3", 4326)
    assert rows["8"]["n"] is None and rows["8"]["geometry"] is None


@pytest.mark.parametrize(
    "how, srid",
    [
        ({"encoding": "xy", "x": "lon", "y": "lat"}, 4326),
        ({"encoding": "hex", "column": "h", "name": "shape"}, None),
        ({"encoding": "wkb", "column": "w"}, 3857),
        ({"encoding": "ewkb", "column": "w", "byte_order": "mixed"}, 0),
    ],
)
def test_geometry_encodings(spark, folder, how, srid):
    point = "0101000000000000000000F03F0000000000000040"
    df = spark.createDataFrame([(1, 1.0, 2.0, point)], "id int, lon double, lat double, h string")
    df.withColumn("w", F.unhex("h")).write.parquet(f"{folder}/data/p.parquet")
    found = read_source(spark, layer(f"{folder}/data", "p", geometry_source=how, source_srid=srid)).first()
    geom = found[how.get("name", "geometry")]
    assert geom["srid"] == srid and bytes(geom["wkb"]).hex().upper() == point


def test_unknown_encoding(spark, folder):
    spark.range(1).write.parquet(f"{folder}/data/p.parquet")
    with pytest.raises(SyncError, match="encoding"):
        read_source(spark, layer(f"{folder}/data", "p", geometry_source={"encoding": "svg", "column": "id"}))


def test_names_that_differ_in_case_only(spark):
    with pytest.raises(SyncError, match="differ in case"):
        lower_names(spark.createDataFrame([(1, 2)], "a int, b int").toDF("A", "a"))


def test_feature_id_keeps_its_name(spark):
    assert lower_names(spark.createDataFrame([(1, 2)], "OGC_FID int, B int"), "OGC_FID").columns == ["OGC_FID", "b"]


def test_missing_dataset(spark, folder):
    with pytest.raises(SyncError, match="cannot be opened"):
        read_source(spark, layer(f"{folder}/nothing", "a"))


def test_missing_layer_hints(spark, folder):
    spark.range(1).write.parquet(f"{folder}/data/africa.parquet")
    os.makedirs(f"{folder}/data/empty.parquet")
    with pytest.raises(SyncError) as caught:
        read_source(spark, layer(f"{folder}/data", "afrika"))
    assert 'which its dataset does not hold. The closest name there is "africa". Not readable: ' in str(caught.value)
    with pytest.raises(SyncError) as caught:
        read_source(spark, layer(f"{folder}/data", "something quite different"))
    assert "named" not in str(caught.value)


def test_unreadable_layer(spark, folder):
    os.makedirs(f"{folder}/data/empty.parquet")
    with pytest.raises(SyncError, match="exists, but cannot be read"):
        read_source(spark, layer(f"{folder}/data", "empty"))


def test_missing_driver(spark, folder):
    with pytest.raises(SyncError, match="cannot be opened"):
        read_source(spark, layer("jdbc:postgresql://localhost/x", "t", source_format="jdbc", source_options={"numPartitions": "1"}))


# --- GeoJSON documents in ranges --------------------------------------------------


def _document(seed, indent=None):
    rng = random.Random(seed)
    odd = ['}', '{', ']}', '"', '\\', '}{"type":"Feature"', 'é漢', '\n', '{[', '\\"}', ""]
    features = []
    for n in range(rng.randrange(0, 40)):
        properties = {"id": str(n), "note": "".join(rng.choice(odd) for _ in range(rng.randrange(6)))}
        if rng.random() < 0.3:
            properties["deep"] = {"a": [{"b": "}"}, []]}
        geometry = {"type": "LineString", "coordinates": [[n, k] for k in range(rng.choice([1, 2, 60]))]}
        features.append({"type": "Feature", "properties": properties, "geometry": rng.choice([geometry, None])})
    document = {"type": "FeatureCollection", "name": "a}{", "other": [{"type": "x", "y": {}}], "features": features, "end": {"a": {}}}
    return features, json.dumps(document, indent=indent, ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("seed", range(4))
def test_documents_are_read_in_ranges(spark, folder, seed):
    """Wherever a range starts, in a text, a name or a list of numbers, every feature comes out once and whole."""
    wanted = []
    os.makedirs(f"{folder}/d.geojson")
    for n in range(3):
        features, text = _document(10 * seed + n, indent=rng_indent(seed + n))
        wanted += features
        with open(f"{folder}/d.geojson/{n}.geojson", "w", encoding="utf-8") as file:
            file.write(text + "\n" * (n % 2))
    with settings(spark, spark__sql__files__maxPartitionBytes=str(150 + 177 * seed), spark__sql__files__openCostInBytes="1"):
        df = feature_texts(spark, f"{folder}/d.geojson", {})
        texts = [json.loads(r["line"]) for r in df.collect()]
    found = [t for t in texts if t.get("type") == "Feature"]
    key = lambda f: json.dumps(f, sort_keys=True)
    assert sorted(map(key, found)) == sorted(map(key, wanted))


def rng_indent(n):
    return (None, 1, 3)[n % 3]


def test_a_document_is_read_by_several_tasks_and_equals_its_lines(spark, folder):
    features, text = _document(77)
    features = features * 20
    os.makedirs(f"{folder}/s")
    with open(f"{folder}/s/whole.geojson", "w") as file:
        json.dump({"type": "FeatureCollection", "features": features}, file)
    with open(f"{folder}/s/lines.geojsonl", "w") as file:
        file.writelines(json.dumps(f) + "\n" for f in features)
    of = lambda layer, kind: LayerSpec("l", f"{folder}/s", layer, "a", "b", source_format=kind)
    with settings(spark, spark__sql__files__maxPartitionBytes="4000", spark__sql__files__openCostInBytes="1"):
        whole = open_layer(spark, of("whole", "geojson"))
        assert whole.rdd.getNumPartitions() > 4
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, open_layer(spark, of("lines", "geojsonseq")).collect()))


def test_a_truncated_document_sets_its_last_feature_aside(spark, folder):
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "1"}, "geometry": None}] * 3})
    with open(f"{folder}/cut.geojson", "w") as file:
        file.write(text[:-40])
    rows = open_layer(spark, LayerSpec("l", folder, "cut", "a", "b", source_format="geojson")).collect()
    assert [r["id"] for r in rows if r["id"]] == ["1", "1"] and sum(r["_unreadable"] is not None for r in rows) == 1


def test_documents_and_ranges_do_not_grow_with_the_table(spark, folder, monkeypatch):
    spark.range(250_000).withColumnRenamed("id", "c_custkey").write.parquet(f"{folder}/customer.parquet")
    seen = {}

    def look(sync, name):
        path = f"{sync._layers[name].source}/places.geojson"
        seen["ranges"] = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        seen["features"] = spark.read.text(path).select(F.max(F.size(F.split("value", '"Feature","properties"')))).first()[0] - 1

    monkeypatch.setattr(queries.TableSync, "pull", look)
    queries.source_geojson_document_published(spark, folder)
    assert seen["ranges"] <= 8 * spark.sparkContext.defaultParallelism
    assert 10_000 < seen["features"] <= queries.DOCUMENT_IDS // 2
