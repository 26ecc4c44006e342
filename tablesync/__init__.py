"""Keep keyed tables in step with external datasets, as Spark jobs."""

from tablesync.plans.sync import TableSync, parse_request
from tablesync.runlog import RunLog
from tablesync.sources.snapshot import SnapshotTable
from tablesync.spec import (
    ConflictError,
    LayerSpec,
    SpecError,
    SyncError,
    SyncResult,
    UnknownLayerError,
)

__all__ = [
    "ConflictError",
    "LayerSpec",
    "RunLog",
    "SnapshotTable",
    "SpecError",
    "SyncError",
    "SyncResult",
    "TableSync",
    "UnknownLayerError",
    "parse_request",
]
