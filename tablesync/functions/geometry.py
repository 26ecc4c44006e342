"""Geometry columns: ``struct<srid:int, wkb:binary>``.

Header fields are read by native binary expressions. Only reprojection,
shape comparison and format conversion run as Arrow-batched functions, and
they receive NULL for every row that does not need them.
"""

from __future__ import annotations

import json
import struct
import sys
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import projections as R
from tablesync.functions import wkb as W

# The batch functions travel with their code, so executors need no copy of the package.
for module in (sys.modules[__name__], R, W):
    cloudpickle.register_pickle_by_value(module)

GEOMETRY = T.StructType([T.StructField("srid", T.IntegerType()), T.StructField("wkb", T.BinaryType())])

# Fixed value: the undefined reference system.
UNDEFINED_SRID = 0
DEGREES, MERCATOR, EARTH_RADIUS = R.DEGREES, R.MERCATOR, R.EARTH_RADIUS
MAX_BYTES = 2147483647


def is_geometry(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StructType) and [
        (f.name, f.dataType) for f in data_type.fields
    ] == [(f.name, f.dataType) for f in GEOMETRY.fields]


# --- building ------------------------------------------------------------------


def geometry(wkb: Column, srid: Column | int | None) -> Column:
    """Geometry from bytes; no bytes means no geometry."""
    if not isinstance(srid, Column):
        srid = F.lit(srid)
    return F.when(
        F.octet_length(wkb) > 0, F.struct(srid.cast("int").alias("srid"), wkb.cast("binary").alias("wkb"))
    )


def geometry_from_hex(text: Column, srid: Column | int | None = None) -> Column:
    """Hexadecimal bytes, with or without an embedded reference system."""
    return geometry_from_ewkb(F.unhex(F.btrim(text)), srid)


def geometry_from_ewkb(data: Column, srid: Column | int | None = None) -> Column:
    """Bytes whose header may carry the reference system; else ``srid`` is used."""
    if not isinstance(srid, Column):
        srid = F.lit(srid)
    head = F.hex(F.substring(data, 1, 9))
    code = _uint(head, 3)
    embedded = code.bitwiseAND(F.lit(W.FLAG_SRID)) != 0
    plain_code = F.lpad(F.hex(code - F.lit(W.FLAG_SRID)), 8, "0")
    swapped = F.concat(*[F.substring(plain_code, at, 2) for at in (7, 5, 3, 1)])
    little = F.substring(head, 1, 2) == "01"
    stripped = F.concat(
        F.substring(data, 1, 1),
        F.unhex(F.when(little, swapped).otherwise(plain_code)),
        F.substring(data, 10, MAX_BYTES),
    )
    return F.when(embedded, geometry(stripped, _uint(head, 11))).otherwise(geometry(data, srid))


def geometry_hex(geom: Column) -> Column:
    return F.hex(geom["wkb"])


# --- header ----------------------------------------------------------------------


def _uint(head: Column, at: int) -> Column:
    """Unsigned 32-bit value at hex digit ``at`` in the byte order of the header."""
    digits = F.substring(head, at, 8)
    swapped = F.concat(*[F.substring(digits, pos, 2) for pos in (7, 5, 3, 1)])
    ordered = F.when(F.substring(head, 1, 2) == "01", swapped).otherwise(digits)
    return F.conv(ordered, 16, 10).cast("bigint")


def type_code(wkb: Column) -> Column:
    return _uint(F.hex(F.substring(wkb, 1, 5)), 3)


def geometry_kind(wkb: Column) -> Column:
    """1 point, 2 line, 3 polygon, 4-6 their multiples, 7 collection."""
    return type_code(wkb).bitwiseAND(F.lit(0x0FFFFFFF)) % 1000


@F.pandas_udf(T.BooleanType())
def _holds_all(wkb: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(wkb), dtype=object)
    known = wkb.notna().to_numpy()
    if known.any():
        out[known] = W.whole(wkb[known].tolist())
    return out


def is_whole(wkb: Column) -> Column:
    """Whether the bytes are one geometry with all that its header and its members announce, and nothing after it.

    Points are judged by their header and length; only other kinds are walked through, in batches.
    """
    code, size = type_code(wkb), F.octet_length(wkb)
    plain = code.bitwiseAND(F.lit(0x0FFFFFFF))
    order = F.hex(F.substring(wkb, 1, 1)).isin("00", "01")
    known = order & (plain < 4000) & (plain % 1000).between(1, 17)
    head = F.when(code.bitwiseAND(F.lit(W.FLAG_SRID)) != 0, 9).otherwise(5)
    walked = _holds_all(F.when(known & (plain % 1000 != 1), wkb))
    return known & F.when(plain % 1000 == 1, size == head + 8 * coordinate_dimension(wkb)).otherwise(walked)


def is_collection(wkb: Column) -> Column:
    return geometry_kind(wkb).between(4, 7)


def coordinate_dimension(wkb: Column) -> Column:
    code = type_code(wkb)
    iso = F.floor(code.bitwiseAND(F.lit(0x0FFFFFFF)) / 1000)
    has_z = (code.bitwiseAND(F.lit(W.FLAG_Z)) != 0) | iso.isin(1, 3)
    has_m = (code.bitwiseAND(F.lit(W.FLAG_M)) != 0) | iso.isin(2, 3)
    return F.lit(2) + has_z.cast("int") + has_m.cast("int")


# --- reference systems -------------------------------------------------------------


def srid(geom: Column) -> Column:
    return F.coalesce(geom["srid"], F.lit(UNDEFINED_SRID))


def set_srid(geom: Column, value: int) -> Column:
    return geometry(geom["wkb"], value)


_POINT_DTYPE = np.dtype([("order", "u1"), ("code", "<u4"), ("xy", "<f8", (2,))])


def _is_plain_point(value: bytes | None) -> bool:
    return value is not None and len(value) == 21 and value[:5] == b"\x01\x01\x00\x00\x00"


def _move_all(values: pd.Series, move) -> pd.Series:
    """Move every geometry of a batch, plain points as one array; None where it is broken or the other system does not reach."""
    out = pd.Series([None] * len(values), dtype=object)
    plain = values.map(_is_plain_point).to_numpy(dtype=bool)
    if plain.any():
        points = np.frombuffer(b"".join(values[plain]), _POINT_DTYPE).copy()
        points["xy"] = move(points["xy"])
        packed, valid = points.tobytes(), np.isfinite(points["xy"]).all(axis=1)
        out[plain] = [packed[21 * n : 21 * n + 21] if ok else None for n, ok in enumerate(valid)]
    for at in np.flatnonzero(~plain & values.notna().to_numpy()):
        outside = []

        def checked(coords: np.ndarray) -> np.ndarray:
            moved = move(coords)
            outside.append(not np.isfinite(moved[:, :2]).all())
            return moved

        try:
            moved = W.write(W.map_coords(W.read(values.iloc[at]), checked))
        except W.UNREADABLE:
            continue
        out[at] = None if any(outside) else moved
    return out


@F.pandas_udf(T.BinaryType())
def _moved(wkb: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(wkb), index=wkb.index, dtype=object)
    for pair, rows in wkb[wkb.notna()].groupby([source, target]):
        to_degrees, from_degrees = R.system(int(pair[0]))[0], R.system(int(pair[1]))[1]
        moved = _move_all(rows.reset_index(drop=True), lambda coords, back=to_degrees, to=from_degrees: to(back(coords)))
        out.loc[rows.index] = moved.to_numpy()
    return out


def transform(geom: Column, target_srid: int) -> Column:
    """Reproject to ``target_srid``; an unsupported pair fails the job.

    The geometry stands in the result several times: make chains of steps, each a column of its own.
    """
    known = srid(geom)
    unsupported = F.raise_error(
        F.concat(F.lit("No transformation from SRID "), known.cast("string"), F.lit(f" to {target_srid}"))
    )
    result = F.when(geom.isNull(), F.lit(None)).when(known == target_srid, geom)
    if R.system(target_srid):
        supported = reduce(or_, (known.between(low, high) for low, high in R.RANGES))
        wanted = F.when(supported & (known != target_srid), geom["wkb"])
        result = result.when(supported, geometry(_moved(wanted, known, F.lit(target_srid)), target_srid))
    return result.otherwise(unsupported.cast(GEOMETRY))


def to_target_srid(geom: Column, target_srid: int | None) -> Column:
    """Bring a geometry to the reference system of the target column.

    No declared system: kept as read. Undefined (<= 0): set to undefined.
    Otherwise geometries without a system get the target's, others are moved.
    """
    if target_srid is None:
        return geom
    if target_srid <= 0:
        return set_srid(geom, UNDEFINED_SRID)
    return F.when(srid(geom) <= 0, set_srid(geom, target_srid)).otherwise(transform(geom, target_srid))


# --- comparison ----------------------------------------------------------------------


@F.pandas_udf(T.BooleanType())
def _shapes_equal(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else W.canonical(a) == W.canonical(b) for a, b in zip(left, right)],
        dtype=object,
    )


def shapes_equal(left: Column, right: Column) -> Column:
    """Equal shapes in the plane: vertex order, direction, ring start, repeated and
    straight-run vertices do not matter."""
    return _shapes_equal(left, right)


def geometry_changed(old: Column, new: Column) -> Column:
    """Whether replacing ``old`` by ``new`` changes the row.

    Collections are compared by their bytes, other geometries by shape; a
    different reference system, or NULL against a value, is a change.
    """
    same_bytes = old["wkb"] == new["wkb"]
    same_srid = srid(old) == srid(new)
    comparable = (
        same_srid & ~same_bytes & ~is_collection(old["wkb"]) & ~is_collection(new["wkb"])
    )
    equal = shapes_equal(F.when(comparable, old["wkb"]), F.when(comparable, new["wkb"]))
    return (
        F.when(old.isNull() & new.isNull(), F.lit(False))
        .when(old.isNull() | new.isNull() | ~same_srid, F.lit(True))
        .when(same_bytes, F.lit(False))
        .when(comparable, ~equal)
        .otherwise(F.lit(True))
    )


# --- conversion ------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def point_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    """Point bytes from two numeric columns; NULL when either is missing."""
    points = np.zeros(len(x), _POINT_DTYPE)
    points["order"], points["code"] = 1, 1
    points["xy"] = np.column_stack([x.to_numpy("f8"), y.to_numpy("f8")])
    packed = points.tobytes()
    out = pd.Series([packed[at : at + 21] for at in range(0, len(packed), 21)], dtype=object)
    out[(x.isna() | y.isna()).to_numpy()] = None
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def point_coordinates(wkb: pd.Series) -> pd.Series:
    """The coordinates in a plain point's bytes; NULL for anything else."""
    return wkb.map(lambda data: list(struct.unpack("<2d", data[5:21])) if _is_plain_point(data) else None)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def vertices(wkb: pd.Series) -> pd.Series:
    """All tuples of a geometry and its members in the order of its bytes; NULL for broken bytes."""

    def read(value: bytes | None) -> list | None:
        try:
            return None if value is None else [tuple_ for part in W.coordinates(W.read(value)) for tuple_ in part.tolist()]
        except W.UNREADABLE:
            return None

    return pd.Series([read(value) for value in wkb], dtype=object)


@F.pandas_udf(T.BinaryType())
def geojson_wkb(text: pd.Series) -> pd.Series:
    """Bytes of a GeoJSON geometry object given as text; NULL if it is none."""

    def read(value: str | None) -> bytes | None:
        try:
            return None if value is None else W.write(W.from_geojson(json.loads(value)))
        except (ValueError, KeyError, TypeError, AttributeError, IndexError):
            return None

    return pd.Series([read(value) for value in text], dtype=object)


@F.pandas_udf(T.BinaryType())
def little_endian(wkb: pd.Series) -> pd.Series:
    """The same geometry in little-endian byte order; broken bytes as they are."""

    def turned(value: bytes | None) -> bytes | None:
        try:
            return value if value is None or value[0] == 1 else W.write(W.read(value))
        except W.UNREADABLE:
            return value

    return pd.Series([turned(value) for value in wkb], dtype=object)
