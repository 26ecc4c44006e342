"""Cast source rows to the target schema, setting aside rows that do not fit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions import text as X
from tablesync.functions.geometry import (
    GEOMETRY,
    coordinate_dimension,
    is_geometry,
    srid,
    to_target_srid,
)
from tablesync.operators.columns import ColumnPlan
from tablesync.spec import SyncError

ERRORS = "_errors"
ORDER = "_order"
# Column of a source with what could not be read of a row, where anything could not.
UNREADABLE = "_unreadable"
ERRORS_TYPE = "array<struct<column:string,value:string>>"

# Accepted text forms.
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?|[nN]a[nN])\s*$"
YMD = r"^\s*(\d{4})(?:-(\d{1,2})-(\d{1,2})|/(\d{1,2})/(\d{1,2})|(\d{2})(\d{2}))"
CLOCK = r"(?:[T ]+(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?\d*)?)?"
ZONE = r"\s*(?:Z|[+-]\d{1,2}(?::?\d{2})?)?\s*$"
STAMP = YMD + CLOCK + ZONE
TIME = r"^\s*([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.\d+)?)?\s*$"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


# --- target fields -----------------------------------------------------------------


def varchar(name: str, length: int, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable, {"max_length": length})


def time_of_day(name: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable, {"temporal": "time"})


def geometry_field(name: str, reference: int | None = None, dims: int | None = None) -> T.StructField:
    """A geometry column; a declared ``reference`` (SRID) and ``dims`` are enforced on write."""
    declared = {"srid": reference, "dims": dims}
    return T.StructField(name, GEOMETRY, True, {k: v for k, v in declared.items() if v is not None})


def max_length(field: T.StructField) -> int | None:
    declared = field.metadata.get("max_length")
    if declared is None:
        raw = field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
        digits = "".join(ch for ch in raw if ch.isdigit())
        declared = int(digits) if digits else None
    return declared


def is_time(field: T.StructField) -> bool:
    return field.metadata.get("temporal") == "time"


# --- one value -------------------------------------------------------------------


def ymd_date(text: Column) -> Column:
    """Date from year-month-day text; NULL when it is none."""
    return F.when(text.rlike(STAMP), F.regexp_replace(text, STAMP, "$1-$2$4$6-$3$5$7").try_cast("date"))


def ymd_timestamp(text: Column) -> Column:
    """Timestamp without zone; a zone in the text is dropped, not applied."""
    plain = F.regexp_replace(text, STAMP, "$1-$2$4$6-$3$5$7 $8:$9:$10$11")
    whole = F.regexp_replace(F.regexp_replace(plain, " ::$", " 00:00:00"), ":$", ":00")
    return F.when(text.rlike(STAMP), whole.try_cast("timestamp_ntz"))


def clock_text(text: Column) -> Column:
    """``HH:mm:ss`` from time text; NULL when it is none."""
    part = lambda at: F.regexp_extract(text, TIME, at)
    seconds = F.when(part(3) == "", "00").otherwise(part(3))
    return F.when(
        text.rlike(TIME), F.concat(F.lpad(part(1), 2, "0"), F.lit(":"), part(2), F.lit(":"), seconds)
    )


def _unsupported(source: T.DataType, field: T.StructField) -> SyncError:
    return SyncError(f'Column "{field.name}": no cast from {source.simpleString()} to {field.dataType.simpleString()}')


def _to_text(col: Column, source: T.DataType, field: T.StructField) -> Column:
    if isinstance(source, FLOATING):
        return X.double_text(col.cast("double"))
    if isinstance(source, T.ArrayType):
        return X.text_array_literal(col) if isinstance(source.elementType, T.StringType) else X.array_literal(col)
    if isinstance(source, (T.BinaryType, T.MapType, T.StructType)):
        raise _unsupported(source, field)
    return col.cast("string")


def _cast(col: Column, source: T.DataType, field: T.StructField) -> Column:
    target = field.dataType
    from_text = isinstance(source, T.StringType)
    if isinstance(target, T.StringType):
        text = _to_text(col, source, field)
        if is_time(field):
            return X.time_text(col) if isinstance(source, TEMPORAL[1:]) else clock_text(text)
        return text
    if isinstance(target, INTEGRAL):
        if from_text or isinstance(source, INTEGRAL + (T.BooleanType,)):
            return col.try_cast(target)
        if isinstance(source, FLOATING):
            return F.rint(col).try_cast(target)
        if isinstance(source, T.DecimalType):
            return F.round(col, 0).try_cast(target)
    elif isinstance(target, FLOATING + (T.DecimalType,)):
        if from_text:
            return F.when(col.rlike(NUMBER), F.btrim(col).try_cast(target))
        if isinstance(source, INTEGRAL + FLOATING + (T.DecimalType,)):
            return col.try_cast(target)
    elif isinstance(target, TEMPORAL):
        if from_text:
            return ymd_date(col) if isinstance(target, T.DateType) else ymd_timestamp(col).cast(target)
        if isinstance(source, TEMPORAL):
            return col.try_cast(target)
    elif isinstance(target, T.BooleanType):
        if from_text:
            return X.bool_from_words(col)
        if isinstance(source, INTEGRAL + (T.BooleanType,)):
            return col.try_cast(target)
    elif isinstance(target, T.BinaryType) and isinstance(source, T.BinaryType):
        return col
    elif isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        element = T.StructField(field.name, target.elementType)
        return F.transform(col, lambda item: _cast(item, source.elementType, element))
    elif source == target:
        return col
    raise _unsupported(source, field)


def _prepared(col: Column, source: T.DataType, field: T.StructField, real_scale: int | None) -> Column:
    """The value as it enters the cast: scaled, empty text missing for temporal columns."""
    if real_scale is not None and isinstance(source, FLOATING):
        return F.round(col, real_scale)
    if isinstance(source, T.StringType) and (isinstance(field.dataType, TEMPORAL) or is_time(field)):
        return F.nullif(col, F.lit(""))
    return col


def _converted(col: Column, source: T.DataType, field: T.StructField) -> Column:
    if not is_geometry(field.dataType):
        return _cast(col, source, field)
    if not is_geometry(source):
        raise _unsupported(source, field)
    return to_target_srid(col, field.metadata.get("srid"))


def _always_fits(source: T.DataType, field: T.StructField) -> bool:
    """No value of the source type can fail: same type, wider number, any type as text."""
    target = field.dataType
    if is_geometry(target):
        return field.metadata.get("srid", 0) <= 0
    if max_length(field) is not None or is_time(field):
        return False
    if isinstance(target, T.StringType) or source == target:
        return True
    if isinstance(source, INTEGRAL) and isinstance(target, INTEGRAL):
        return INTEGRAL.index(type(source)) <= INTEGRAL.index(type(target))
    return isinstance(source, INTEGRAL + (T.FloatType,)) and isinstance(target, T.DoubleType)


def _misfit(col: Column, value: Column, source: T.DataType, field: T.StructField) -> Column:
    if _always_fits(source, field):
        return F.lit(False)
    bad = col.isNotNull() & value.isNull()
    if isinstance(field.dataType, T.ArrayType):
        missing = lambda items: F.size(F.filter(items, lambda item: item.isNull()))
        bad = bad | (col.isNotNull() & (missing(value) > missing(col)))
    limit = max_length(field)
    if limit is not None:
        bad = bad | (F.length(F.rtrim(value)) > limit)
    return F.coalesce(bad, F.lit(False))


def _fitted(value: Column, field: T.StructField) -> Column:
    limit = max_length(field)
    return value if limit is None else F.substring(value, 1, limit)


def cast_value(
    col: Column, source: T.DataType, field: T.StructField, real_scale: int | None = None
) -> tuple[Column, Column]:
    """``(value, bad)``: the value in the target type, and whether it did not fit.

    A missing value is never bad. An empty text for a temporal column counts
    as missing. Fractions round half to even; text longer than its column is
    bad unless the excess is blanks.
    """
    col = _prepared(col, source, field, real_scale)
    value = _converted(col, source, field)
    return _fitted(value, field), _misfit(col, value, source, field)


# --- whole rows ----------------------------------------------------------------------


def _raw_text(raw: Column, source: T.DataType, field: T.StructField) -> Column:
    if is_geometry(source):
        return F.hex(raw["wkb"])
    return F.hex(raw) if isinstance(source, T.BinaryType) else _to_text(raw, source, field)


def cast_rows(
    source: DataFrame,
    target: T.StructType,
    plan: ColumnPlan,
    real_scale: int | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """Project the source onto the mapped target columns, plus ``_errors``.

    ``_errors`` lists the columns whose value did not fit together with the
    value read; it is empty for good rows. Two projections, no shuffle: the
    first casts each value once, the second looks for those that came out
    missing. Columns whose types rule that out are not looked at.
    """
    read, values, bad, problems = [], [], [], []
    for position, (name, source_name) in enumerate(plan.mapped.items()):
        field, source_type = target[name], source.schema[source_name].dataType
        col = _prepared(F.col(f"`{source_name}`"), source_type, field, real_scale)
        value = F.col(f"_value_{position}")
        read.append(_converted(col, source_type, field).alias(f"_value_{position}"))
        values.append(_fitted(value, field).alias(name))
        if not _always_fits(source_type, field):
            raw = F.col(f"_read_{position}")
            read.append(col.alias(f"_read_{position}"))
            shown = _raw_text(raw, source_type, field)
            bad.append(_misfit(raw, value, source_type, field))
            problems.append(F.when(bad[-1], F.struct(F.lit(name).alias("column"), shown.alias("value"))))
    if UNREADABLE in source.columns:
        read.append(F.col(UNREADABLE))
        bad.append(F.col(UNREADABLE).isNotNull())
        problems.append(F.when(bad[-1], F.struct(F.lit(UNREADABLE).alias("column"), F.col(UNREADABLE).alias("value"))))
    none = F.array().cast(ERRORS_TYPE)
    errors = F.when(reduce(or_, bad), F.array_compact(F.array(*problems)).cast(ERRORS_TYPE)).otherwise(none) if bad else none
    order = [F.col(f"`{order_by}`").alias(ORDER)] if order_by else []
    kept = [F.col(ORDER)] if order_by else []
    return source.select(*read, *order).select(*values, *kept, errors.alias(ERRORS))


def all_always_fit(source: T.StructType, target: T.StructType, plan: ColumnPlan) -> bool:
    """No row of a source of this schema can be set aside."""
    return UNREADABLE not in source.names and all(_always_fits(source[s].dataType, target[t]) for t, s in plan.mapped.items())


def failing_on_errors(staged: DataFrame) -> DataFrame:
    """Let the job fail at the first row with a value that does not fit."""
    message = F.concat_ws(
        "; ",
        F.transform(
            F.col(ERRORS), lambda e: F.concat(F.lit("column "), e["column"], F.lit(" cannot take "), e["value"])
        ),
    )
    checked = F.when(F.size(ERRORS) == 0, F.col(ERRORS)).otherwise(F.raise_error(message).cast(ERRORS_TYPE))
    return staged.withColumn(ERRORS, checked)


def split_rows(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``; good rows lose the error column."""
    return staged.filter(F.size(ERRORS) == 0).drop(ERRORS), staged.filter(F.size(ERRORS) > 0)


def breaks_constraints(target: T.StructType, columns: Sequence[str]) -> Column:
    """Condition that a row breaks a NOT NULL, declared SRID or dimension rule."""
    broken = [F.col(f"`{n}`").isNull() for n in columns if not target[n].nullable]
    for name in columns:
        if is_geometry(target[name].dataType):
            declared, col = target[name].metadata, F.col(f"`{name}`")
            if "srid" in declared:
                broken.append(col.isNotNull() & (srid(col) != max(declared["srid"], 0)))
            if "dims" in declared:
                broken.append(col.isNotNull() & (coordinate_dimension(col["wkb"]) != declared["dims"]))
    return F.coalesce(reduce(or_, broken, F.lit(False)), F.lit(False))
