"""Which source columns go where: column plan, key resolution, geometry guards.

Everything here looks at schemas only; no job is started.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

from tablesync.functions.geometry import is_geometry
from tablesync.spec import SyncError


@dataclass(frozen=True)
class ColumnPlan:
    """``mapped`` maps target column -> source column, in target order."""

    keys: tuple[str, ...]
    mapped: dict[str, str]
    geometry: str | None
    keys_from_table: bool

    @property
    def updates(self) -> list[str]:
        return [name for name in self.mapped if name not in self.keys]


def geometry_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if is_geometry(f.dataType)]


def plan_columns(
    layer_name: str,
    source: T.StructType,
    target: T.StructType,
    primary_key: Sequence[str],
    override: Sequence[str] = (),
) -> ColumnPlan:
    """Map source to target columns by name and settle the key.

    Source columns without a counterpart are ignored; target columns without
    one keep their values. The single source geometry feeds the single target
    geometry whatever their names are.
    """
    source_geometry, target_geometry = geometry_columns(source), geometry_columns(target)
    if len(source_geometry) > 1:
        raise SyncError(
            f'The source of layer "{layer_name}" has {len(source_geometry)} geometry columns; at most one is supported'
        )
    if len(target_geometry) > 1:
        raise SyncError(
            f'The target of layer "{layer_name}" has several geometry columns; at most one is supported'
        )
    if len(set(target.names)) != len(target.names):
        raise SyncError(f'The target of layer "{layer_name}" repeats a column name')

    mapped: dict[str, str] = {}
    for name in target.names:
        if name in target_geometry:
            if source_geometry:
                mapped[name] = source_geometry[0]
        elif name in source.names and name not in source_geometry:
            mapped[name] = name

    keys = tuple(override) or tuple(primary_key)
    for name in override:
        if name not in target.names:
            raise SyncError(f'Layer "{layer_name}": configured key column "{name}" is not in the target')
    if not keys:
        raise SyncError(f'Layer "{layer_name}" has no primary key')
    missing = [name for name in keys if name not in mapped]
    if missing:
        raise SyncError(f'The source of layer "{layer_name}" lacks key columns: {", ".join(missing)}')
    return ColumnPlan(
        keys=keys,
        mapped=mapped,
        geometry=target_geometry[0] if target_geometry and target_geometry[0] in mapped else None,
        keys_from_table=not override or set(override) == set(primary_key),
    )
