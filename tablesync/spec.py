"""What to synchronise (``LayerSpec``), what came of it (``SyncResult``), and the errors.

A layer names a source dataset, a keyed target table and the rules between
them. It is a plain immutable value; nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


class SyncError(RuntimeError):
    """A pull or removal cannot go on; the target stays as it was."""


class SpecError(SyncError):
    """A layer is described wrongly."""


class UnknownLayerError(SyncError):
    """No enabled layer has the requested name."""


class ConflictError(SyncError):
    """Someone else published a newer version of the target first."""


# Accepted words of textual settings and text columns.
TRUE_WORDS = ("true", "yes", "1", "y", "t")
FALSE_WORDS = ("false", "no", "0", "n", "f")
SETTING_TRIM = "'\"\r\n\t "
BULK_DELETE_METHODS = ("delete", "truncate")

NUMBERS = {
    "source_srid": int,
    "real_scale": int,
    "max_deltas": int,
    "max_delta_share": float,
    "max_delete_fraction": float,
}
DUPLICATE_POLICIES = ("error", "latest", "any")
KEY_NULL_POLICIES = ("safe", "not_in", "reject")


@dataclass(frozen=True)
class LayerSpec:
    """One synchronisation: source -> target, with its rules.

    ``primary_key_columns`` overrides the key stored with the target table.
    Such a key need not be unique in the target.
    """

    name: str
    source: str
    source_layer: str
    target_table_schema: str
    target_table_name: str
    description: str = ""
    filter: str = ""
    filter_ignores_case: bool = True
    conditions: tuple[Mapping[str, Any], ...] = ()
    allow_feature_deletion: bool = False
    ignore_failures: bool = False
    enabled: bool = True
    primary_key_columns: tuple[str, ...] = ()
    bulk_mode: bool = False
    bulk_delete_method: str = "delete"

    source_format: str = "parquet"
    source_options: Mapping[str, str] = field(default_factory=dict)
    source_schema: str | None = None
    fid_column: str | None = None
    source_srid: int | None = None
    geometry_source: Mapping[str, str] | None = None

    on_duplicate_key: str = "error"
    order_by: str | None = None
    keep_newer: bool = False
    key_nulls: str = "safe"
    real_scale: int | None = None
    allow_bulk_filter: bool = False
    max_delete_fraction: float | None = None
    max_delta_share: float = 0.1
    max_deltas: int = 16

    def __post_init__(self) -> None:
        for setting in ("source", "source_layer", "target_table_name", "target_table_schema"):
            if not getattr(self, setting):
                raise SpecError(f'Layer "{self.name}": {setting} is empty')
        _one_of("bulk delete method", self.bulk_delete_method, BULK_DELETE_METHODS)
        _one_of("duplicate key policy", self.on_duplicate_key, DUPLICATE_POLICIES)
        _one_of("key null policy", self.key_nulls, KEY_NULL_POLICIES)
        if self.on_duplicate_key == "latest" and not self.order_by:
            raise SpecError(f'Layer "{self.name}" keeps the latest duplicate and so needs order_by')
        if self.keep_newer and not self.order_by:
            raise SpecError(f'Layer "{self.name}" keeps newer rows and so needs order_by')
        object.__setattr__(self, "primary_key_columns", tuple(self.primary_key_columns))

    @property
    def target(self) -> str:
        return f"{self.target_table_schema}.{self.target_table_name}"

    @classmethod
    def from_settings(cls, name: str, settings: Mapping[str, Any]) -> LayerSpec:
        """Build a layer from textual settings, as a configuration file holds them."""
        known = {f.name: f for f in fields(cls)}
        values: dict[str, Any] = {
            s: "" for s in ("source", "source_layer", "target_table_schema", "target_table_name")
        }
        for setting, value in settings.items():
            if setting not in known or setting == "name":
                raise SpecError(f'Layer "{name}" has no setting called "{setting}"')
            if isinstance(value, str):
                value = _setting_from_text(setting, value, known[setting].default)
            values[setting] = value
        return cls(name=name, **values)


def parse_bool(setting: str, text: str) -> bool:
    word = text.strip(SETTING_TRIM).lower()
    if word in TRUE_WORDS:
        return True
    if word in FALSE_WORDS:
        return False
    raise SpecError(f"{setting}: {text!r} is neither a yes nor a no word")


def _setting_from_text(setting: str, text: str, default: Any) -> Any:
    if isinstance(default, bool):
        return parse_bool(setting, text)
    if setting == "primary_key_columns":
        parts = (part.strip(SETTING_TRIM) for part in text.split(","))
        return tuple(part for part in parts if part)
    if setting == "bulk_delete_method":
        word = text.strip(SETTING_TRIM).lower()
        if word not in BULK_DELETE_METHODS:
            raise SpecError(f"bulk_delete_method: {text!r} is none of {', '.join(BULK_DELETE_METHODS)}")
        return word
    if setting in NUMBERS:
        try:
            return NUMBERS[setting](text.strip(SETTING_TRIM))
        except ValueError as error:
            raise SpecError(f"{setting}: {text!r} is no number of its kind") from error
    return text


def _one_of(what: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise SpecError(f'Unknown {what}: "{value}" (expected one of {", ".join(allowed)})')


@dataclass(frozen=True)
class SyncResult:
    """Outcome of one run; the same facts are appended to the run log."""

    id: str
    type: str
    layer_name: str
    status: str
    message: str = ""
    num_pulled: int = 0
    num_created: int = 0
    num_updated: int = 0
    num_deleted: int = 0
    num_ignored: int = 0
    version: int | None = None
