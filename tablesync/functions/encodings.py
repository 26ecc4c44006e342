"""Text forms of geometries, well-known text and GML, read into bytes on Arrow batches.

Both give the extended binary form: the bytes carry a reference system where the text names
one. What is no geometry comes out as NULL, so that it is set aside like any value that does not fit.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import wkb as W

# The batch functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
MAX_SRID = 999_999

# --- well-known text ----------------------------------------------------------------

_HEAD = re.compile(r"\s*(?:SRID\s*=\s*([0-9]+)\s*;)?\s*([A-Z]+?)\s*(?:\b(ZM|Z|M))?\s*(EMPTY|\()", re.IGNORECASE)
_TUPLE = re.compile(rf"\s*({NUMBER}(?:\s+{NUMBER}){{1,3}})\s*")
_SHAPE = re.compile(r"[\s(),]*")

# Kinds by their names, and how deep their coordinates are nested.
KINDS = {
    "POINT": (1, 1),
    "LINESTRING": (2, 1),
    "POLYGON": (3, 2),
    "MULTIPOINT": (4, 1),
    "MULTILINESTRING": (5, 2),
    "MULTIPOLYGON": (6, 3),
    "GEOMETRYCOLLECTION": (7, 0),
}
_DIMS = {"": None, "Z": 3, "M": 3, "ZM": 4}


def _members(body: str) -> Iterator[str]:
    """The parts of a list that commas outside of all parentheses separate."""
    depth, start = 0, 0
    for match in re.finditer(r"[(),]", body):
        depth += {"(": 1, ")": -1, ",": 0}[match[0]]
        if match[0] == "," and not depth:
            yield body[start : match.start()]
            start = match.end()
    yield body[start:]


def _nested(body: str) -> list:
    """Coordinates in parentheses as nested lists: tuples of numbers become lists of numbers."""
    if _SHAPE.fullmatch(_TUPLE.sub("", body)) is None:
        raise ValueError("something else than numbers, commas and parentheses")
    tuples = _TUPLE.sub(lambda m: "[" + ",".join(repr(float(n)) for n in m[1].split()) + "]", body)
    return json.loads(tuples.replace("(", "[").replace(")", "]"))


def _coords(rows: list, dims: int) -> np.ndarray:
    array = np.array(rows, "f8")
    if array.ndim != 2 or array.shape[1] != dims:
        raise ValueError("tuples of different sizes")
    return array


def from_wkt(text: str) -> tuple[W.Geometry, int | None, bool]:
    """The geometry, its reference system if named, and whether its third number is a measure."""
    head = _HEAD.match(text)
    if head is None or head[2].upper() not in KINDS:
        raise ValueError("no geometry")
    kind, depth = KINDS[head[2].upper()]
    mark = (head[3] or "").upper()
    dims, srid = _DIMS[mark], int(head[1]) if head[1] else None
    rest = text[head.end() :].rstrip()
    if srid is not None and srid > MAX_SRID:
        raise ValueError("no reference system has such a number")
    if head[4] != "(":
        if rest:
            raise ValueError("text after the end")
        dims = dims or 2
        none = np.full((1, dims), np.nan) if kind == 1 else np.zeros((0, dims))
        return (kind, dims, none if kind < 3 else []), srid, mark == "M"
    if not rest.endswith(")"):
        raise ValueError("no end")
    body = rest[:-1]
    if kind == 7:
        parts = [from_wkt(part) for part in _members(body)]
        if any(part[1] is not None for part in parts) or len({(part[0][1], part[2]) for part in parts}) > 1:
            raise ValueError("members of different dimensions")
        measured = parts[0][2]
        if dims not in (None, parts[0][0][1]) or (mark and measured != (mark == "M")):
            raise ValueError("members of other dimensions than the collection")
        return (kind, parts[0][0][1], [part[0] for part in parts]), srid, measured
    if kind == 4:
        # Points stand with or without parentheses of their own.
        body = re.sub(rf"\(({_TUPLE.pattern})\)", r"\1", body)
    value = _nested("(" + body + ")")
    first = value
    for _ in range(depth):
        first = first[0]
    dims = dims or len(first)
    return (kind, dims, _parts(kind, value, dims)), srid, mark == "M"


def _parts(kind: int, value: list, dims: int):
    if kind in (1, 2):
        array = _coords(value, dims)
        if kind == 1 and len(array) != 1:
            raise ValueError("a point has one tuple")
        return array
    if kind == 3:
        return [_coords(ring, dims) for ring in value]
    if kind == 4:
        return [(1, dims, _coords([point], dims)) for point in value]
    return [(kind - 3, dims, _parts(kind - 3, part, dims)) for part in value]


# --- GML ----------------------------------------------------------------------------

# Names of elements by what they hold.
_PARTS = {"MultiPoint": 4, "MultiLineString": 5, "MultiCurve": 5, "MultiPolygon": 6, "MultiSurface": 6, "MultiGeometry": 7}
_HOLD = {
    "pointMember", "pointMembers", "lineStringMember", "lineStringMembers", "curveMember", "curveMembers", "polygonMember",
    "polygonMembers", "surfaceMember", "surfaceMembers", "geometryMember", "geometryMembers",
}
_OUTER, _INNER = {"exterior", "outerBoundaryIs"}, {"interior", "innerBoundaryIs"}
#: Systems whose first axis runs north: their official names give latitudes first, short ones do not.
NORTH_FIRST = {4326, 4258}
_SYSTEM = re.compile(r"(?:urn:ogc:def:crs:EPSG:[^:]*:|https?://www\.opengis\.net/def/crs/EPSG/[^/]+/)([0-9]+)")
_SHORT_SYSTEM = re.compile(r"(?:EPSG:|https?://www\.opengis\.net/gml/srs/epsg\.xml#)([0-9]+)", re.IGNORECASE)


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _system(element: ElementTree.Element) -> tuple[int | None, bool]:
    """The reference system that an element names, and whether its tuples start with the latitude."""
    name = element.get("srsName")
    if name is None:
        return None, False
    official, short = _SYSTEM.fullmatch(name), _SHORT_SYSTEM.fullmatch(name)
    if not (official or short):
        raise ValueError("an unknown reference system")
    srid = int((official or short)[1])
    if srid > MAX_SRID:
        raise ValueError("no reference system has such a number")
    return srid, bool(official) and srid in NORTH_FIRST


def _numbers(text: str | None, separator: str | None = None) -> list[float]:
    parts = (text or "").replace(separator, " ").split() if separator else (text or "").split()
    if not all(re.fullmatch(NUMBER, part) for part in parts):
        raise ValueError("no number")
    return [float(part) for part in parts]


def _tuples(element: ElementTree.Element, dims: int | None) -> np.ndarray:
    """The positions below an element, in any of their forms."""
    rows: list = []
    for child in element:
        name, own = _name(child), child.get("srsDimension")
        size = int(own) if own else dims
        if name == "pos":
            rows.append(_numbers(child.text))
        elif name == "posList":
            numbers = _numbers(child.text)
            size = size or 2
            if len(numbers) % size:
                raise ValueError("a broken list of positions")
            rows += [numbers[at : at + size] for at in range(0, len(numbers), size)]
        elif name == "coordinates":
            rows += [_numbers(part, child.get("cs", ",")) for part in (child.text or "").split(child.get("ts"))]
        elif name in ("pointProperty", "Point"):
            rows += _tuples(child if name == "Point" else child[0], size).tolist()
        elif name not in ("metaDataProperty", "description", "name", "boundedBy"):
            raise ValueError(f"an unknown element {name}")
    array = np.array(rows, "f8")
    if array.ndim != 2 or not 2 <= array.shape[1] <= 4:
        raise ValueError("no positions of one size")
    return array


def _gml(element: ElementTree.Element, dims: int | None) -> W.Geometry:
    name, own = _name(element), element.get("srsDimension")
    dims = int(own) if own else dims
    if name == "Point":
        array = _tuples(element, dims)
        if len(array) != 1:
            raise ValueError("a point has one position")
        return 1, array.shape[1], array
    if name == "LineString":
        array = _tuples(element, dims)
        return 2, array.shape[1], array
    if name == "Curve":
        lines = [_tuples(s, dims) for segments in element for s in segments if _name(s) == "LineStringSegment"]
        if not lines or sum(len(segments) for segments in element) != len(lines):
            raise ValueError("a curve of other than straight segments")
        array = np.concatenate([line if n == 0 else line[1:] for n, line in enumerate(lines)])
        return 2, array.shape[1], array
    if name in ("Polygon", "PolygonPatch"):
        outer = [_tuples(ring, dims) for part in element if _name(part) in _OUTER for ring in part]
        inner = [_tuples(ring, dims) for part in element if _name(part) in _INNER for ring in part]
        if len(outer) != 1 or len({ring.shape[1] for ring in outer + inner}) != 1:
            raise ValueError("a polygon has one outer ring")
        return 3, outer[0].shape[1], outer + inner
    if name == "Surface":
        patches = [_gml(patch, dims) for held in element for patch in held]
        if len(patches) != 1:
            raise ValueError("a surface of several patches")
        return patches[0]
    if name not in _PARTS:
        raise ValueError(f"an unknown geometry {name}")
    parts = [_gml(member, dims) for held in element if _name(held) in _HOLD for member in held]
    kind = _PARTS[name]
    if len({part[1] for part in parts}) > 1 or (kind < 7 and any(part[0] != kind - 3 for part in parts)):
        raise ValueError("members of another kind")
    return kind, parts[0][1] if parts else dims or 2, parts


def _swapped(coords: np.ndarray) -> np.ndarray:
    return coords[:, [1, 0, *range(2, coords.shape[1])]]


def from_gml(text: str) -> tuple[W.Geometry, int | None, bool]:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("no definitions in a geometry")
    # A fragment may use prefixes that its document declares.
    for prefix in sorted(set(re.findall(r"</?([A-Za-z_][\w.-]*):", text)) | set(re.findall(r"\s([A-Za-z_][\w.-]*):\w+\s*=", text))):
        if prefix not in ("xml", "xmlns") and f"xmlns:{prefix}" not in text:
            text = re.sub(r"<([A-Za-z_][\w.:-]*)", rf'<\1 xmlns:{prefix}="{prefix}"', text, count=1)
    element = ElementTree.fromstring(text)
    srid, north_first = _system(element)
    geometry = _gml(element, None)
    return W.map_coords(geometry, _swapped) if north_first else geometry, srid, False


# --- columns ------------------------------------------------------------------------


def _bytes(geometry: W.Geometry, srid: int | None, measured: bool) -> bytes:
    data = _measured(W.write(geometry)) if measured else W.write(geometry)
    if srid is None:
        return data
    (code,) = struct.unpack_from("<I", data, 1)
    return data[:1] + struct.pack("<II", code | W.FLAG_SRID, srid) + data[5:]


def _measured(data: bytes) -> bytes:
    """The third number of each tuple is a measure: the headers of the geometry and its members say so."""
    out, at = bytearray(data), [0]

    def walk() -> None:
        (code,) = struct.unpack_from("<I", out, at[0] + 1)
        if code & W.FLAG_Z and not code & W.FLAG_M:
            struct.pack_into("<I", out, at[0] + 1, (code ^ W.FLAG_Z) | W.FLAG_M)
        kind = code & 0xFF
        at[0] += 5
        if kind == 1:
            at[0] += 24
            return
        (count,) = struct.unpack_from("<I", out, at[0])
        at[0] += 4
        for _ in range(1 if kind == 2 else count):
            if kind == 2:
                at[0] += 24 * count
            elif kind == 3:
                at[0] += 4 + 24 * struct.unpack_from("<I", out, at[0])[0]
            else:
                walk()

    walk()
    return bytes(out)


def _column(values: pd.Series, read: Callable[[str], tuple[W.Geometry, int | None, bool]]) -> pd.Series:
    def one(value: str | None) -> bytes | None:
        try:
            return None if value is None else _bytes(*read(value))
        except (ElementTree.ParseError, RecursionError, AttributeError, *W.UNREADABLE):
            return None

    return pd.Series([one(value) for value in values], dtype=object)


@F.pandas_udf(T.BinaryType())
def wkt_ewkb(text: pd.Series) -> pd.Series:
    """Extended bytes of well-known text, with or without ``SRID=...;`` ahead; NULL if it is none."""
    return _column(text, from_wkt)


@F.pandas_udf(T.BinaryType())
def gml_ewkb(text: pd.Series) -> pd.Series:
    """Extended bytes of a GML geometry element; NULL if it is none."""
    return _column(text, from_gml)


# --- whole geometries: bytes without a reference system, and the system beside them ---

_READ = T.StructType([T.StructField("srid", T.IntegerType()), T.StructField("wkb", T.BinaryType())])


def _geometries(values: pd.Series, read: Callable[[str], tuple[W.Geometry, int | None, bool]]) -> pd.DataFrame:
    found = []
    for value in values:
        try:
            geometry, srid, measured = (None, None, False) if value is None else read(value)
            found.append((srid, None if geometry is None else _bytes(geometry, None, measured)))
        except (ElementTree.ParseError, RecursionError, AttributeError, *W.UNREADABLE):
            found.append((None, None))
    whole = W.whole([data or b"" for _, data in found])
    kept = [(srid, data) if ok else (None, None) for (srid, data), ok in zip(found, whole)]
    return pd.DataFrame({"srid": pd.array([srid for srid, _ in kept], "Int32"), "wkb": pd.Series([data for _, data in kept], dtype=object)})


@F.pandas_udf(_READ)
def wkt_geometry(text: pd.Series) -> pd.DataFrame:
    """Reference system, if named, and bytes of well-known text; no bytes if it is none."""
    return _geometries(text, from_wkt)


@F.pandas_udf(_READ)
def gml_geometry(text: pd.Series) -> pd.DataFrame:
    """Reference system, if named, and bytes of a GML geometry element; no bytes if it is none."""
    return _geometries(text, from_gml)


@F.pandas_udf(_READ)
def geojson_geometry(text: pd.Series) -> pd.DataFrame:
    """Bytes of a GeoJSON geometry object, which names no system; no bytes if it is none."""
    return _geometries(text, lambda value: (W.from_geojson(json.loads(value)), None, False))
