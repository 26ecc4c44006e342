"""Source filters, structured predicates and attribute-set criteria."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.text import BLANKS
from tablesync.operators.keys import key_condition, right_side
from tablesync.spec import SyncError

AttributeSet = Mapping[str, str | None]
Condition = Mapping[str, Any]

# --- filter text -------------------------------------------------------------------


def compose_filter(layer_filter: str | None, request_filter: str | None) -> str:
    """Both filters must hold; an absent one is left out."""
    parts = [part for part in (layer_filter or "", (request_filter or "").strip(BLANKS)) if part]
    return parts[0] if len(parts) == 1 else " and ".join(f"({part})" for part in parts)


def apply_filter(df: DataFrame, condition: str, layer_name: str, ignore_case: bool = True) -> DataFrame:
    """Keep the source rows that satisfy ``condition`` (text over source columns).

    With ``ignore_case`` texts are equal, listed by ``IN`` or matched by ``LIKE`` whatever their
    case, wherever in the condition they are compared; ``<``, ``<=``, ``>`` and ``>=`` mind it.
    """
    if not condition:
        return df
    try:
        filtered = df.filter(F.expr(condition))
        return without_case(df, filtered) if ignore_case else filtered
    except (ParseException, AnalysisException) as error:
        raise SyncError(f'The rows of layer "{layer_name}" cannot be filtered by {condition!r}: {error}') from error


#: Comparisons whose sides are all texts or none, by the name of their expression.
_EQUALITIES = {"EqualTo", "EqualNullSafe", "In", "Like"}
#: Comparisons with patterns that are values of the expression, not parts of it.
_MANY_PATTERNS = {"LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny"}


def without_case(df: DataFrame, filtered: DataFrame) -> DataFrame:
    """``df`` under the condition of ``filtered``, made from it, with texts compared in lower case.

    Spark has parsed and typed the condition; its tree is walked once and only the comparisons of
    texts are built anew. Everything else is the same expression, so it is still pushed to the source.
    """
    jvm = df.sparkSession._jvm
    condition = filtered._jdf.queryExecution().analyzed().condition()
    new = _lowered(jvm, condition)
    return filtered if new is None else df.filter(Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(new)))


def _lowered(jvm, node):
    """The expression with texts compared in lower case; None where nothing in it changes."""
    package = jvm.org.apache.spark.sql.catalyst.expressions
    parts = _items(node.children())
    new = [_lowered(jvm, part) for part in parts]
    changed = any(part is not None for part in new)
    parts = [old if part is None else part for old, part in zip(parts, new)]
    kind = node.getClass().getSimpleName()
    if kind in _EQUALITIES and parts[0].dataType().simpleString() == "string":
        parts, changed = [package.Lower(part) for part in parts], True
    elif kind in _MANY_PATTERNS and parts[0].dataType().simpleString() == "string":
        patterns = [None if text is None else text.toLowerCase() for text in _items(node.patterns())]
        return getattr(package, kind)(package.Lower(parts[0]), jvm.PythonUtils.toSeq(patterns))
    return node.withNewChildren(jvm.PythonUtils.toSeq(parts)) if changed else None


def _items(seq) -> list:
    return [seq.apply(n) for n in range(seq.size())]


# --- structured predicates ------------------------------------------------------------


def eq_ci(col: Column, value: str) -> Column:
    """Text equality that ignores case."""
    return F.lower(col) == F.lower(F.lit(value))


def ne_ci(col: Column, value: str) -> Column:
    return ~eq_ci(col, value)


def in_ci(col: Column, values: Iterable[str]) -> Column:
    return F.lower(col).isin([value.lower() for value in values])


def like_ci(col: Column, pattern: str) -> Column:
    """LIKE and ILIKE alike ignore case."""
    return col.ilike(pattern)


def condition_column(schema: T.StructType, condition: Condition, layer_name: str) -> Column:
    """One comparison ``{column, operator, value}``; texts are compared without regard to case."""
    name, operator = condition.get("column"), str(condition.get("operator", "=")).lower()
    if name not in schema.names:
        raise SyncError(f'Layer "{layer_name}" cannot compare "{name}", which is no source column')
    col, value = F.col(f"`{name}`"), condition.get("value")
    text = isinstance(schema[name].dataType, T.StringType)
    if operator in ("in", "between") and (isinstance(value, (str, bytes)) or not isinstance(value, Sequence)):
        raise SyncError(f'Layer "{layer_name}": "{operator}" needs a list of values, not {value!r}')
    if operator == "between" and len(value) != 2:
        raise SyncError(f'Layer "{layer_name}": "between" needs two values, not {len(value)}')
    if not operator.startswith("is ") and (value is None or (operator in ("in", "between") and None in value)):
        raise SyncError(f'Layer "{layer_name}" cannot compare "{name}" with NULL; use "is null" or "is not null"')
    known = {
        "=": lambda: eq_ci(col, value) if text else col == value,
        "<>": lambda: ne_ci(col, value) if text else col != value,
        "<": lambda: col < value,
        "<=": lambda: col <= value,
        ">": lambda: col > value,
        ">=": lambda: col >= value,
        "in": lambda: in_ci(col, value) if text else col.isin(list(value)),
        "between": lambda: col.between(*value),
        "like": lambda: like_ci(col, value),
        "ilike": lambda: like_ci(col, value),
        "is null": col.isNull,
        "is not null": col.isNotNull,
    }
    if operator not in known:
        raise SyncError(f'Layer "{layer_name}" has no comparison "{operator}"; known: {", ".join(known)}')
    try:
        return known[operator]()
    except (TypeError, AttributeError, PySparkException) as error:
        raise SyncError(f'Layer "{layer_name}" cannot use {value!r} with "{operator}"') from error


def all_conditions(schema: T.StructType, conditions: Sequence[Condition], layer_name: str) -> Column:
    return reduce(and_, (condition_column(schema, c, layer_name) for c in conditions), F.lit(True))


# --- attribute sets --------------------------------------------------------------------


def parse_attribute_sets(value: str | Sequence) -> list[dict[str, str | None]]:
    """The attribute sets of a request, empty ones left out; an error names every fault at once."""
    sets = json.loads(value) if isinstance(value, str) else value
    if isinstance(sets, (str, bytes)) or not isinstance(sets, Sequence):
        raise ValueError("attributeSets is no list")
    faults = [f"entry {n} is no object" for n, s in enumerate(sets) if not isinstance(s, Mapping)]
    pairs = [(n, *item) for n, s in enumerate(sets) if isinstance(s, Mapping) for item in s.items()]
    faults += [f"entry {n} has the column name {name!r}" for n, name, _ in pairs if not isinstance(name, str)]
    faults += [f"entry {n} gives {name!r} no text" for n, name, text in pairs if not isinstance(text, (str, type(None)))]
    if faults:
        raise ValueError("attributeSets: " + "; ".join(faults))
    return [dict(s) for s in sets if s]


def check_attributes(sets: Iterable[AttributeSet], columns: Iterable[str], layer_name: str) -> None:
    known = set(columns)
    for attributes in sets:
        for name in attributes:
            if name not in known:
                raise SyncError(f'Layer "{layer_name}" has no column "{name}"')


def typed_criteria(criteria: DataFrame, schema: T.StructType) -> DataFrame:
    """Criteria in the types of the table; a text that does not fit its column fails the job."""

    def typed(name: str) -> Column:
        text, kind = F.col(f"`{name}`"), schema[name].dataType
        value = text.try_cast(kind)
        message = F.concat(F.lit(f'Column "{name}" cannot be compared with: '), text.cast("string"))
        return F.when(text.isNotNull() & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value).alias(name)

    return criteria.select(*[typed(name) for name in criteria.columns])


def flag_criteria_matches(df: DataFrame, criteria: DataFrame, flag: str = "_matched") -> DataFrame:
    """Mark the rows equal, null-safely, to a criteria row on all criteria columns.

    The criteria are made distinct first, so each row is marked at most once;
    their size decides between a broadcast and a shuffled join, and a hot row
    group is on the side the adaptive planner can split.
    """
    names = criteria.columns
    found = right_side(typed_criteria(criteria, df.schema).distinct()).withColumn(flag, F.lit(True))
    joined = df.join(found, key_condition(names), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.col(flag), F.lit(False)).alias(flag))


def flag_matches(df: DataFrame, sets: Sequence[AttributeSet], flag: str = "_matched") -> DataFrame:
    """Mark the rows that match any attribute set: one join per group of sets that name the same columns.

    The criteria are a local table whose size the planner knows, so it broadcasts
    them however many there are, up to its limit, and does not move ``df``.
    """
    by_columns: dict[tuple[str, ...], list[AttributeSet]] = defaultdict(list)
    for attributes in sets:
        if attributes:
            by_columns[tuple(sorted(attributes))].append(attributes)
    flags = []
    for position, (names, group) in enumerate(sorted(by_columns.items())):
        columns = {n: pa.array([a[n] for a in group], pa.string()) for n in names}
        flags.append(f"{flag}_{position}")
        df = flag_criteria_matches(df, df.sparkSession.createDataFrame(pa.table(columns)), flags[-1])
    return df.withColumn(flag, reduce(or_, (F.col(f) for f in flags), F.lit(False))).drop(*flags)
