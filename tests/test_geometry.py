import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesync.functions import encodings as E
from tablesync.functions import geometry as G
from tablesync.functions import projections as P
from tablesync.functions import wkb as W
from tablesync.sources.readers import read_source
from tablesync.spec import LayerSpec


def point(x, y, order="<"):
    return struct.pack(order + "BIdd", 1 if order == "<" else 0, 1, x, y)


def shape(text):
    return W.write(W.from_geojson(json.loads(text)))


def line(*coords):
    return W.write(W.from_geojson({"type": "LineString", "coordinates": list(coords)}))


def polygon(*rings):
    return W.write(W.from_geojson({"type": "Polygon", "coordinates": list(rings)}))


def geoms(spark, *pairs):
    rows = [(i, None if p is None else (p[0], p[1])) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "id int, g struct<srid:int,wkb:binary>")


def changed(spark, old, new):
    df = spark.createDataFrame([(old, new)], "a struct<srid:int,wkb:binary>, b struct<srid:int,wkb:binary>")
    return df.select(G.geometry_changed(F.col("a"), F.col("b"))).first()[0]


SQUARE = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
HOLE = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]


@pytest.mark.parametrize(
    "a, b, equal",
    [
        (point(1, 2), point(1, 2, ">"), True),
        (point(0.0, 2), point(-0.0, 2), True),
        (point(1, 2), point(1, 3), False),
        (line([0, 0], [1, 1], [2, 5]), line([2, 5], [1, 1], [0, 0]), True),
        (line([0, 0], [2, 2]), line([0, 0], [1, 1], [1, 1], [2, 2]), True),
        (line([0, 0], [2, 2]), line([0, 0], [1, 1.0000001], [2, 2]), False),
        (line([0, 0], [2, 2], [1, 1]), line([0, 0], [1, 1]), False),
        (line([0, 0], [1, 0], [1, 1], [0, 0]), line([1, 0], [1, 1], [0, 0], [1, 0]), True),
        (polygon(SQUARE), polygon(SQUARE[::-1]), True),
        (polygon(SQUARE), polygon(SQUARE[2:] + SQUARE[1:3]), True),
        (polygon(SQUARE), polygon([[0, 0], [1, 0], *SQUARE[1:]]), True),
        (polygon(SQUARE, HOLE), polygon(SQUARE, HOLE[::-1]), True),
        (polygon(SQUARE, HOLE), polygon(SQUARE), False),
        (point(1, 1), line([1, 1], [2, 2]), False),
    ],
)
def test_shapes_equal(a, b, equal):
    assert (W.canonical(a) == W.canonical(b)) is equal


def test_third_ordinate_does_not_count():
    assert W.canonical(line([0, 0, 1], [1, 1, 2])) == W.canonical(line([0, 0], [1, 1]))


def test_empty_shapes_are_equal():
    empty_line = struct.pack("<BII", 1, 2, 0)
    empty_polygon = struct.pack("<BII", 1, 3, 0)
    assert W.canonical(empty_line) == W.canonical(empty_polygon)


MULTI = shape('{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}')
MULTI_SWAPPED = shape('{"type":"MultiPoint","coordinates":[[3,4],[1,2]]}')


@pytest.mark.parametrize(
    "old, new, expected",
    [
        ((1, point(1, 2)), (1, point(1, 2)), False),
        ((1, point(1, 2)), (2, point(1, 2)), True),
        ((0, point(1, 2)), (None, point(1, 2)), False),
        (None, None, False),
        (None, (1, point(1, 2)), True),
        ((1, point(1, 2)), None, True),
        ((1, line([0, 0], [1, 2])), (1, line([1, 2], [0, 0])), False),
        ((1, MULTI), (1, MULTI), False),
        ((1, MULTI), (1, MULTI_SWAPPED), True),
        ((1, point(1, 2)), (1, MULTI), True),
    ],
)
def test_geometry_changed(spark, old, new, expected):
    assert changed(spark, old, new) is expected


def test_header_fields(spark):
    cases = {
        point(1, 2): (1, False, 2),
        point(1, 2, ">"): (1, False, 2),
        line([0, 0, 1], [1, 1, 2]): (2, False, 3),
        MULTI: (4, True, 2),
        struct.pack("<BII", 1, 3003, 0): (3, False, 4),
        struct.pack("<BII", 1, 7, 0): (7, True, 2),
    }
    df = spark.createDataFrame([(bytearray(w),) for w in cases], "wkb binary")
    found = df.select(
        G.geometry_kind(F.col("wkb")), G.is_collection(F.col("wkb")), G.coordinate_dimension(F.col("wkb"))
    ).collect()
    assert [tuple(r) for r in found] == list(cases.values())


def test_no_bytes_is_no_geometry(spark):
    df = spark.createDataFrame([(b"",), (None,), (point(1, 2),)], "wkb binary").select(G.geometry(F.col("wkb"), 7).alias("g"))
    assert [r["g"] is None for r in df.collect()] == [True, True, False]


def test_hex_with_and_without_reference_system(spark):
    plain = point(1, 2).hex()
    embedded = (struct.pack("<BII", 1, 0x20000001, 4326) + struct.pack("<dd", 1, 2)).hex()
    big = (struct.pack(">BII", 0, 0x20000001, 4326) + struct.pack(">dd", 1, 2)).hex()
    df = spark.createDataFrame([(plain,), (embedded.upper(),), (big,), (None,)], "h string")
    read = [r["g"] for r in df.select(G.geometry_from_hex(F.col("h"), 99).alias("g")).collect()]
    assert (read[0]["srid"], bytes(read[0]["wkb"])) == (99, point(1, 2))
    assert (read[1]["srid"], bytes(read[1]["wkb"])) == (4326, point(1, 2))
    assert (read[2]["srid"], bytes(read[2]["wkb"])) == (4326, point(1, 2, ">"))
    assert read[3] is None


def test_little_endian(spark):
    df = spark.createDataFrame([(point(1, 2, ">"),), (point(1, 2),), (None,)], "w binary")
    found = [r[0] for r in df.select(G.little_endian("w")).collect()]
    assert [None if f is None else bytes(f) for f in found] == [point(1, 2), point(1, 2), None]


def xy(wkb):
    return W.read(bytes(wkb))[2][0].tolist()


def test_reprojection(spark):
    df = geoms(spark, (4326, point(10, 50)), (0, point(10, 50)), (3857, point(1, 2)), None, (4326, line([0, 0], [180, 0])))
    moved = [r["g"] for r in df.select("id", G.to_target_srid(F.col("g"), 3857).alias("g")).orderBy("id").collect()]
    assert moved[0]["srid"] == 3857
    assert xy(moved[0]["wkb"]) == pytest.approx([1113194.907932736, 6446275.841017161])
    assert (moved[1]["srid"], xy(moved[1]["wkb"])) == (3857, [10, 50])
    assert xy(moved[2]["wkb"]) == [1, 2]
    assert moved[3] is None
    assert W.read(bytes(moved[4]["wkb"]))[2][1, 0] == pytest.approx(math.pi * G.EARTH_RADIUS)


def test_reprojection_round_trip(spark):
    df = geoms(spark, (4326, point(-71.5, -33.25)))
    there = G.transform(F.col("g"), 3857)
    back = df.select(there.alias("g")).select(G.transform(F.col("g"), 4326).alias("g")).first()["g"]
    assert back["srid"] == 4326 and xy(back["wkb"]) == pytest.approx([-71.5, -33.25])


def test_coordinates_of_points(spark):
    df = spark.createDataFrame([(10.0, 50.0)], "x double, y double").select(G.point_wkb("x", "y").alias("w"))
    there = G.transform(G.geometry(F.col("w"), 4326), 3857)
    found = df.select("w", G.point_coordinates(there["wkb"]).alias("xy")).first()
    assert found["xy"] == pytest.approx([1113194.907932736, 6446275.841017161])
    assert bytes(found["w"]) == point(10, 50)


def test_undefined_target_resets(spark):
    df = geoms(spark, (4326, point(1, 2)))
    assert df.select(G.to_target_srid(F.col("g"), -1)["srid"]).first()[0] == 0
    assert df.select(G.to_target_srid(F.col("g"), None)["srid"]).first()[0] == 4326


def test_unsupported_pair_fails(spark):
    with pytest.raises(Exception, match="No transformation from SRID 4326 to 2056"):
        geoms(spark, (4326, point(1, 2))).select(G.to_target_srid(F.col("g"), 2056)).collect()


def test_geojson(spark):
    texts = ['{"type":"Point","coordinates":[1,2]}', None, '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(G.geojson_wkb("t")).collect()]
    assert bytes(found[0]) == point(1, 2) and found[1] is None
    assert W.read(bytes(found[2]))[0] == 7


# --- UTM zones ----------------------------------------------------------------------


def test_utm_agrees_with_known_places_and_comes_back():
    places = np.array([[-79.387139, 43.642567], [15.0, 0.0], [151.215297, -33.856159]])
    found = [P.system(s)[1](places[[n]])[0] for n, s in enumerate((32617, 32633, 32756))]
    assert np.allclose(found[0], [630084.3, 4833438.5], atol=1) and np.allclose(found[1], [500000, 0], atol=1e-6)
    north = P.system(32656)[1](places[[2]] * [1, -1])[0]
    assert np.allclose(found[2], [north[0], 10_000_000 - north[1]], atol=1e-6)
    rng = np.random.default_rng(3)
    for srid in (32601, 32631, 32660, 32701, 32733, 32760):
        back, forth = P.system(srid)
        meridian = 6.0 * (srid % 100) - 183
        lon = (meridian + rng.uniform(-15, 15, 500) + 180) % 360 - 180
        coords = np.column_stack([lon, rng.uniform(-84, 84, 500), rng.uniform(0, 9, 500)])
        again = back(forth(coords))
        assert np.abs((again[:, 0] - lon + 180) % 360 - 180).max() < 1e-9 and np.abs(again[:, 1:] - coords[:, 1:]).max() < 1e-9
    assert np.isnan(P.system(32633)[1](np.array([[100.0, 10.0], [15.0, 89.5]]))[:, 0]).tolist() == [True, True]
    assert P.system(32661) is None and P.system(4258) is None


def test_any_two_systems_are_a_pair(spark):
    here = np.array([[16.5, -48.25]])
    systems = (4326, 3857, 32733, 32734)
    rows = [(s, bytearray(W.write((1, 2, P.system(s)[1](here))))) for s in systems]
    df = spark.createDataFrame(rows, "s int, w binary").select("s", G.geometry(F.col("w"), F.col("s")).alias("g"))
    for target in systems:
        wanted = P.system(target)[1](here)[0]
        for row in df.select(G.transform(F.col("g"), target).alias("g")).collect():
            assert row["g"]["srid"] == target and np.allclose(struct.unpack("<2d", row["g"]["wkb"][5:]), wanted, rtol=1e-12)
    with pytest.raises(Exception, match="No transformation from SRID 4326 to 2154"):
        df.filter("s = 4326").select(G.transform(F.col("g"), 2154)).collect()


# --- whole bytes --------------------------------------------------------------------


def _geometry(rng, kind, dims, deep=0):
    points = lambda n: np.array([[rng.random() for _ in range(dims)] for _ in range(n)]).reshape(-1, dims)
    if kind < 3:
        return kind, dims, points(1 if kind == 1 else rng.randrange(5))
    if kind == 3:
        return kind, dims, [points(rng.randrange(1, 6)) for _ in range(rng.randrange(4))]
    if kind < 7:
        return kind, dims, [_geometry(rng, kind - 3, dims) for _ in range(rng.randrange(4))]
    return kind, dims, [_geometry(rng, rng.randrange(1, 8 if deep < 9 else 7), dims, deep + 1) for _ in range(rng.randrange(4))]


def _bytes(rng, geometry, order):
    """Bytes in one byte order, or in another one for some members."""
    kind, dims, parts = geometry
    code = kind | {2: 0, 3: W.FLAG_Z, 4: W.FLAG_Z | W.FLAG_M}[dims]
    out = [struct.pack(order + "BI", order == "<", code)]
    if kind > 1:
        out.append(struct.pack(order + "I", len(parts)))
    if kind < 3:
        out.append(np.asarray(parts, order + "f8").tobytes())
    for part in parts if kind > 2 else []:
        ring = kind == 3
        out.append(struct.pack(order + "I", len(part)) + np.asarray(part, order + "f8").tobytes() if ring else _bytes(rng, part, rng.choice("<>")))
    return b"".join(out)


def test_whole_bytes_are_told_from_cut_and_longer_ones():
    rng, values, wanted = random.Random(5), [], []
    for _ in range(1500):
        data = _bytes(rng, _geometry(rng, rng.randrange(1, 8), rng.choice([2, 3, 4])), rng.choice("<>"))
        values += [data, data[: rng.randrange(len(data))], data + b"x"]
        wanted += [True, False, False]
    assert W.whole(values).tolist() == wanted
    noise = [bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 255]) for _ in range(rng.randrange(60))) for _ in range(5000)]
    assert W.whole([]).tolist() == [] and not W.whole([bytes.fromhex("0102000000FFFFFFFF"), b"", b"\x01"]).any()
    for data, whole in zip(noise, W.whole(noise)):
        if whole:
            W.read(data)


def test_broken_bytes_leave_no_batch_function(spark):
    broken = ["0102000000FFFFFFFF", "0002FF", "01", "0103000000010000000400000000", "0000000002FFFFFFFF"]
    line = W.write((2, 2, np.array([[0.0, 0.0], [1.0, 1.0]]))).hex()
    df = spark.createDataFrame([(h, line) for h in broken], "a string, b string").select(F.unhex("a").alias("a"), F.unhex("b").alias("b"))
    rows = df.select(G.shapes_equal("a", "b").alias("e"), G.little_endian("a").alias("l"), G.is_whole(F.col("a")).alias("w"), "a").collect()
    assert all(not r["e"] and bytes(r["l"]) == bytes(r["a"]) and not r["w"] for r in rows)


# --- text forms ---------------------------------------------------------------------


def test_texts_of_geometries(spark):
    cases = [
        ("POINT (1 2)", 1, [[1, 2]], 0),
        ("srid=3857;point z(1 2 3)", 1, [[1, 2, 3]], 3857),
        ("LINESTRING (0 0, 1 1,2 .5e1)", 2, [[0, 0], [1, 1], [2, 5]], 0),
        ("POLYGON ((0 0,1 0,1 1,0 0),(.1 .1, .2 .1, .2 .2, .1 .1))", 3, [[0, 0], [1, 0], [1, 1], [0, 0], [0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]], 0),
        ("MULTIPOINT ((1 2),(3 4))", 4, [[1, 2], [3, 4]], 0),
        ("MULTIPOINT (1 2, 3 4)", 4, [[1, 2], [3, 4]], 0),
        ("GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION(LINESTRING(1 1, 2 2)))", 7, [[1, 2], [1, 1], [2, 2]], 0),
        ("MULTIPOLYGON EMPTY", 6, [], 0),
        ('<gml:Point srsName="urn:ogc:def:crs:EPSG::4326"><gml:pos>50 8</gml:pos></gml:Point>', 1, [[8, 50]], 4326),
        ('<gml:Point srsName="EPSG:4326"><gml:pos>8 50</gml:pos></gml:Point>', 1, [[8, 50]], 4326),
        ('<LineString xmlns="g"><posList srsDimension="3">1 2 3 4 5 6</posList></LineString>', 2, [[1, 2, 3], [4, 5, 6]], 0),
        ("<LineString><coordinates>1,2 3,4</coordinates></LineString>", 2, [[1, 2], [3, 4]], 0),
        (
            "<gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 1 0 1 1 0 0</gml:posList>"
            "</gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface>",
            6, [[0, 0], [1, 0], [1, 1], [0, 0]], 0,
        ),
    ]
    text, wkb = F.col("text"), F.col("g.wkb")
    data = F.when(text.startswith("<"), E.gml_ewkb(text)).otherwise(E.wkt_ewkb(text))
    df = spark.createDataFrame([(c[0],) for c in cases], "text string").select("text", G.geometry_from_ewkb(data, 0).alias("g"))
    df = df.select("text", G.geometry_kind(wkb).alias("kind"), G.vertices(wkb).alias("v"), G.srid(F.col("g")).alias("srid"), G.is_whole(wkb).alias("whole"))
    found = {r["text"]: r for r in df.collect()}
    for text, kind, tuples, srid in cases:
        row = found[text]
        assert (row["kind"], row["v"], row["srid"], row["whole"]) == (kind, tuples, srid, True), text


def test_texts_that_are_no_geometry(spark):
    texts = [
        "POINT (1)", "POINT (1 2", "POINT (1 2) x", "POINT (1 nan)", "LINESTRING (1 2, 3)", "LINESTRING ((1 2, 3 4))", "POLYGON (0 0, 1 1)", "", "CIRCLE (1 2)",
        "POINT (1 2, 3 4)", "GEOMETRYCOLLECTION (POINT (1 2), POINT Z (1 2 3))", "LINESTRING (0 0,, 1 1)", "POINT ((1 2))", "POINT (1e999 0)", "SRID=99999999999;POINT(1 2)",
        "<gml:Point><gml:pos>1</gml:pos></gml:Point>", "<gml:Point><gml:pos>1 x</gml:pos></gml:Point>", "<a/>", "<gml:Polygon/>",
        '<gml:Point srsName="here"><gml:pos>1 2</gml:pos></gml:Point>', "<!DOCTYPE a><Point><pos>1 2</pos></Point>", "(" * 5000,
        "GEOMETRYCOLLECTION(" * 3000,
    ]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = df.select(E.wkt_ewkb("t").alias("w"), E.gml_ewkb("t").alias("g"), "t").collect()
    assert [r["t"][:30] for r in rows if r["w"] or r["g"]] == []


ODD_TEXTS = [
    "POINT(1 2)", "SRID=4326;POINT Z(1 2 3)", "SRID=0;LINESTRING(0 0, 1 1)", "POINT EMPTY", "LINESTRING M(0 0 1, 1 1 2)", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))",
    "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))", "POINT(1)", "", None, "POLYGON((0 0, 1 0, 1 1, 0 0)",
    '<gml:Point srsName="urn:ogc:def:crs:EPSG::4326"><gml:pos>1 2</gml:pos></gml:Point>', "<gml:Point><gml:pos>1</gml:pos></gml:Point>", "<gml:Po",
]


def test_texts_read_at_once_are_those_read_by_steps(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(ODD_TEXTS)], "id int, t string")
    found = []
    for whole, steps in ((E.wkt_geometry, E.wkt_ewkb), (E.gml_geometry, E.gml_ewkb)):
        by_steps = df.select("id", G.geometry_from_ewkb(steps("t"), 25833).alias("g"))
        at_once = df.withColumn("r", whole("t")).select("id", G.geometry(F.col("r.wkb"), F.coalesce("r.srid", F.lit(25833))).alias("g"))
        assert at_once.orderBy("id").collect() == by_steps.orderBy("id").collect()
        found += [r["g"] is not None for r in at_once.collect()]
    assert sum(found) == 8


def _text_layer(spark, folder, encoding, rows):
    spark.createDataFrame(rows, "id int, shape string").coalesce(1).write.parquet(f"{folder}/layer.parquet")
    return LayerSpec("layer", folder, "layer", "a", "b", geometry_source={"encoding": encoding, "column": "shape", "name": "shape"})


@pytest.mark.parametrize("encoding, text", [("wkt", "POINT(1 2)"), ("gml", "<Point><pos>1 2</pos></Point>")])
def test_texts_of_one_row_group_are_read_by_all_cores(spark, folder, encoding, text):
    df = read_source(spark, _text_layer(spark, folder, encoding, [(n, text) for n in range(500)]))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    per_task = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("shape.wkb").alias("n")).collect()]
    assert sum(per_task) == 500 and max(per_task) < 100


@pytest.mark.parametrize(
    "encoding, text", [("wkt", "POINT(1 2)"), ("gml", "<Point><pos>1 2</pos></Point>"), ("geojson", '{"type":"Point","coordinates":[1,2]}')]
)
def test_texts_take_one_python_worker_of_a_task(spark, folder, encoding, text):
    df = read_source(spark, _text_layer(spark, folder, encoding, [(1, text)]))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_geojson_of_uneven_rings_is_none(spark):
    texts = ['{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0,0,1],[1,0,1],[1,1,1],[0,0,1]]]}', '{"type":"Point","coordinates":[1,2]}', "{", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, t string").coalesce(1)
    assert [r["b"] for r in df.orderBy("id").select(E.geojson_geometry("t")["wkb"].alias("b")).collect()] == [None, shape(texts[1]), None, None]
