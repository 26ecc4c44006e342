"""Change detection: what a staged source means for the target.

``classify`` labels every row ``same``, ``update``, ``insert`` or ``delete``
and gives it the values it should have afterwards. The staged side holds each
key once. Three plans compute the same relation:

* ``merge``  one full outer join; for a target whose key is unique. Both
  sides shuffle once, the target not at all when bucketed by its key.
* ``probe``  the staged side is small enough to broadcast: the target is
  scanned, never shuffled.
* ``split``  the target may hold many rows per key: a left join, whose hot
  partitions the adaptive planner splits (it cannot split a full outer join),
  plus an anti join against keys made distinct before their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.geometry import geometry_changed, is_geometry
from tablesync.operators.keys import (
    NTH,
    flag_not_in_blocked,
    key_condition,
    left,
    right,
    right_side,
)

OP = "_op"
SAME, UPDATE, INSERT, DELETE = "same", "update", "insert", "delete"
CHANGES = (INSERT, UPDATE, DELETE)
PLANS = ("merge", "probe", "split")

_HERE = "_staged"
_THERE = "_stored"


def values_differ(old: Column, new: Column, data_type: T.DataType) -> Column:
    """Null-safe difference; geometries by shape."""
    return geometry_changed(old, new) if is_geometry(data_type) else ~old.eqNullSafe(new)


def rows_differ(schema: T.StructType, columns: Sequence[str]) -> Column:
    """True when any of ``columns`` differs from the joined right side; false for none."""
    return reduce(or_, (values_differ(left(c), right(c), schema[c].dataType) for c in columns), F.lit(False))


def updated_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Matched target rows that differ, with the new values in place."""
    mapped = staged.columns
    joined = target.join(right_side(staged), key_condition(keys, null_safe), "inner")
    changed = joined.filter(rows_differ(target.schema, [c for c in mapped if c not in keys]))
    return changed.select(*[(right(c) if c in mapped else left(c)).alias(c) for c in target.columns])


def missing_rows(
    staged: DataFrame, target: DataFrame, keys: Sequence[str], null_safe: bool = True, unique: bool = False
) -> DataFrame:
    """Staged rows whose key the target lacks.

    Target keys that may repeat are made distinct before they are shuffled.
    Grouping and join then use one struct of the key columns, in which NULLs
    are equal, so both need the same single exchange.
    """
    if unique:
        return staged.join(right_side(target, keys), key_condition(keys, null_safe), "left_anti")
    known = target.select(F.struct(*keys).alias("_known")).distinct()
    return staged.join(known, F.struct(*[left(k) for k in keys]) == F.col("_known"), "left_anti")


def vanished_rows(target: DataFrame, staged: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Target rows whose key is no longer staged."""
    return target.join(right_side(staged, keys), key_condition(keys, null_safe), "left_anti")


def missing_rows_not_in(staged: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged rows for which ``keys NOT IN (target keys)`` holds in SQL logic."""
    flagged = flag_not_in_blocked(staged, target.select(*keys), keys)
    return flagged.filter(~F.col("_blocked")).drop("_blocked")


def vanished_rows_not_in(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return missing_rows_not_in(target, staged, keys)


def classify(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    *,
    deletion: bool = False,
    null_safe: bool = True,
    key_nulls: str = "safe",
    plan: str = "merge",
    order_by: str | None = None,
) -> DataFrame:
    """Target columns plus ``_op`` for every target and every new row.

    Updated and inserted rows carry the staged values, and keep (or get NULL
    for) columns the source does not provide. Deleted rows carry the old
    values. Without ``deletion`` vanished rows count as ``same``. A staged row
    whose ``order_by`` is lower than that of the row it would update, or missing, comes
    too late: the stored row stays. In the ``merge``
    plan a staged side that :func:`~tablesync.operators.keys.numbered` has numbered passes its numbers on.
    """
    if plan not in PLANS:
        raise ValueError(f"unknown plan {plan!r}")
    if key_nulls == "not_in" and plan == "merge":
        plan = "split"
    kind = "full_outer" if plan == "merge" else "left"
    joined = _joined(target, staged, keys, null_safe, kind)
    mapped = [c for c in staged.columns if c != NTH]
    rows = _labelled(joined, target, mapped, keys, deletion, [NTH] if NTH in staged.columns else [], order_by)
    if plan == "merge":
        return rows

    if key_nulls == "not_in":
        inserts = missing_rows_not_in(staged, target, keys)
        if deletion:
            rows = _only_not_in_deletes(rows, target, staged, keys)
    elif plan == "probe":
        inserts = missing_rows(staged, _present(target, staged, keys, null_safe), keys)
    else:
        inserts = missing_rows(staged, target, keys)
    return rows.unionByName(as_inserts(inserts, target))


def as_inserts(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Staged rows in the shape of the target, labelled ``insert``."""
    values = [
        F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ]
    return rows.select(*values, F.lit(INSERT).alias(OP))


def changes_of(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col(OP) != SAME)


def change_feed(target: DataFrame, staged: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Key, operation, and old and new values of the compared columns of changed rows."""
    joined = _joined(target, staged, keys, null_safe, "full_outer")
    compared = [c for c in staged.columns if c not in keys]
    label = _label(rows_differ(target.schema, compared), deletion=True)
    return joined.select(
        *[F.coalesce(right(k), left(k)).alias(k) for k in keys],
        label.alias("op"),
        *[left(c).alias(f"old_{c}") for c in compared],
        *[right(c).alias(f"new_{c}") for c in compared],
    ).filter(F.col("op") != SAME)


def _joined(target: DataFrame, staged: DataFrame, keys: Sequence[str], null_safe: bool, kind: str) -> DataFrame:
    stored, fresh = target.withColumn(_THERE, F.lit(True)), right_side(staged).withColumn(_HERE, F.lit(True))
    return stored.join(fresh, key_condition(keys, null_safe), kind)


def _label(differ: Column, deletion: bool) -> Column:
    return (
        F.when(F.col(_THERE).isNull(), INSERT)
        .when(F.col(_HERE).isNull(), DELETE if deletion else SAME)
        .when(differ, UPDATE)
        .otherwise(SAME)
    )


def _labelled(
    joined: DataFrame, target: DataFrame, mapped: Sequence[str], keys: Sequence[str], deletion: bool, passed: Sequence[str] = (), order_by: str | None = None
) -> DataFrame:
    """One projection turns the joined pair into the row as it should be, and ``_op``."""
    differ = rows_differ(target.schema, [c for c in mapped if c not in keys])
    if order_by:
        late = left(order_by).isNotNull() & (right(order_by).isNull() | (right(order_by) < left(order_by)))
        differ = differ & ~late
    labelled = joined.withColumn(OP, _label(differ, deletion))
    values = []
    for name in target.columns:
        value = left(name)
        if name in keys:
            value = F.coalesce(value, right(name))
        elif name in mapped:
            value = F.when(F.col(OP).isin(INSERT, UPDATE), right(name)).otherwise(value)
        values.append(value.alias(name))
    return labelled.select(*values, OP, *[right(name).alias(name) for name in passed])


def _present(target: DataFrame, staged: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """Target keys that are staged, found by broadcasting the small staged side."""
    here = target.select(*keys)
    return here.join(right_side(staged, keys), key_condition(keys, null_safe), "left_semi")


def _only_not_in_deletes(rows: DataFrame, target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep deletes that ``NOT IN`` would delete; the others stay as they are."""
    flagged = flag_not_in_blocked(rows, staged.select(*keys), keys, same_keys=target)
    label = F.when((F.col(OP) == DELETE) & F.col("_blocked"), SAME).otherwise(F.col(OP))
    return flagged.withColumn(OP, label).drop("_blocked")
