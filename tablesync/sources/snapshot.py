"""A keyed table as a series of immutable versions on plain Parquet.

A version is a data folder, the change sets on top of it, and a small commit
file that names them. The commit file is created in one step and never
replaced, so readers see a version whole or not at all, and of two writers
that started from the same version only the first can publish.

A small change set is published as it is, so that a pull writes only what
differs; once the change sets amount to a fair share of the data, the next
version is written in full again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.operators.apply import newest_changes, overlay
from tablesync.operators.diff import DELETE, OP
from tablesync.operators.keys import any_null, duplicate_keys
from tablesync.sources import files
from tablesync.spec import ConflictError, SyncError

# A version is written in full once its change sets exceed this share of the
# data. More change sets than the second number are combined into one.
MAX_DELTA_SHARE = 0.1
MAX_DELTAS = 16


@dataclass(frozen=True)
class Version:
    """One published state.

    ``deltas`` are change sets to apply to ``data``, oldest first; ``changes``
    is the change set that led here. A ``by_op`` data folder is partitioned
    by operation.
    """

    number: int
    schema: T.StructType
    primary_key: tuple[str, ...]
    buckets: int
    data: str | None
    changes: str | None
    by_op: bool
    deltas: tuple[str, ...] = ()


class SnapshotTable:
    """Target table at ``path``; ``create`` it first, as it is never created by a pull."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        primary_key: Sequence[str] = (),
        buckets: int = 0,
        rows: DataFrame | None = None,
    ) -> SnapshotTable:
        """An empty table, or one holding ``rows``, whose primary key has to be one.

        With ``buckets`` every version is bucketed by the primary key, so that
        later pulls shuffle only the source.
        """
        if buckets and not primary_key:
            raise SyncError("A bucketed table needs a primary key")
        if rows is not None and primary_key:
            if not rows.filter(any_null(primary_key)).isEmpty() or not duplicate_keys(rows, primary_key).isEmpty():
                raise SyncError(f"The rows repeat, or lack, a value of {', '.join(primary_key)}")
        fields = [T.StructField(f.name, f.dataType, f.nullable and f.name not in primary_key, f.metadata) for f in schema]
        table = cls(spark, path)
        version = Version(-1, T.StructType(fields), tuple(primary_key), buckets, None, None, False)
        data = table.write_rows(rows, version) if rows is not None else None
        table.publish(version, data)
        return table

    # --- reading

    def exists(self) -> bool:
        return bool(self._numbers())

    def current(self) -> Version:
        numbers = self._numbers()
        if not numbers:
            raise SyncError(f"There is no table at {self.path}")
        return self.version(numbers[-1])

    def version(self, number: int) -> Version:
        commit = json.loads(files.read_text(self.spark, self._commit(number)))
        return Version(
            number=number,
            schema=T.StructType.fromJson(commit["schema"]),
            primary_key=tuple(commit["primary_key"]),
            buckets=commit["buckets"],
            data=commit["data"],
            changes=commit["changes"],
            by_op=commit["by_op"],
            deltas=tuple(commit["deltas"]),
        )

    def read(self, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        if not version.deltas:
            return self._base(version)
        settled, recent, _ = self.parts(version)
        return settled.unionByName(recent)

    def parts(self, version: Version) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows only in the data folder, rows from change sets, and the keys of the latter."""
        change_sets = [self.read_ops(path, version) for path in version.deltas]
        return overlay(self._base(version), change_sets, version.primary_key)

    def _base(self, version: Version) -> DataFrame:
        if version.data is None:
            return self.spark.createDataFrame([], _nullable(version.schema))
        if version.by_op:
            return self.read_ops(version.data, version).filter(F.col(OP) != DELETE).drop(OP)
        if version.buckets:
            return self._bucketed(version)
        return self.spark.read.schema(_nullable(version.schema)).parquet(version.data)

    def changes(self, version: Version | None = None) -> DataFrame | None:
        """Rows inserted, updated (new values) or deleted (old values) by a version."""
        version = version or self.current()
        if version.changes is None:
            return None
        return self.read_ops(version.changes, version).filter(F.col(OP).isin("insert", "update", "delete"))

    def read_ops(self, path: str, version: Version) -> DataFrame:
        """Rows written by :meth:`write_by_op`, with their operation."""
        with_op = T.StructType([*_nullable(version.schema).fields, T.StructField(OP, T.StringType())])
        return self.spark.read.schema(with_op).parquet(path)

    def _bucketed(self, version: Version) -> DataFrame:
        """Files carry their bucket number; a catalog entry tells Spark about it."""
        name = f"tablesync_{version.data.rsplit('/', 1)[-1]}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in version.schema)
            keys = ", ".join(f"`{k}`" for k in version.primary_key)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
                f" CLUSTERED BY ({keys}) INTO {version.buckets} BUCKETS LOCATION '{version.data}'"
            )
        return self.spark.table(name)

    # --- writing

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def write_rows(self, rows: DataFrame, base: Version, aligned: bool = False) -> str:
        """Write the full contents of a coming version; nothing is published yet.

        Rows for a bucketed table are brought together by key first, unless
        they are ``aligned`` already, so that a bucket is not spread over a
        file per task.
        """
        path = self.new_folder()
        if not base.buckets:
            rows.write.parquet(path)
            return path
        if not aligned:
            rows = rows.repartition(base.buckets, *base.primary_key)
        name = f"tablesync_{path.rsplit('/', 1)[-1]}"
        writer = rows.write.bucketBy(base.buckets, *base.primary_key).option("path", path)
        writer.format("parquet").saveAsTable(name)
        return path

    def write_by_op(self, classified: DataFrame, path: str | None = None) -> str:
        """Write classified rows, one folder per operation."""
        path = path or self.new_folder()
        classified.write.partitionBy(OP).parquet(path)
        return path

    def publish(
        self,
        base: Version,
        data: str | None,
        changes: str | None = None,
        by_op: bool = False,
        deltas: Sequence[str] = (),
    ) -> Version:
        """Make ``data`` with ``deltas`` the next version, unless another one came first."""
        number = base.number + 1
        commit = {
            "schema": base.schema.jsonValue(),
            "primary_key": list(base.primary_key),
            "buckets": base.buckets,
            "data": data,
            "changes": changes,
            "by_op": by_op,
            "deltas": list(deltas),
        }
        if not files.create_text(self.spark, self._commit(number), json.dumps(commit)):
            raise ConflictError(f"Version {number} of {self.path} was published by someone else")
        return self.version(number)

    def publish_changes(
        self, base: Version, changes: str, max_delta_share: float = MAX_DELTA_SHARE, max_deltas: int = MAX_DELTAS
    ) -> Version:
        """Make the result of a change set the next version.

        ``changes`` was written by :meth:`write_by_op` and compared with
        ``base``, whose primary key its rows carry.
        """
        deltas = (*base.deltas, changes)
        if base.data is None or self._size(*deltas) > max_delta_share * self._size(base.data):
            return self._publish_whole(base, deltas, changes)
        if len(deltas) > max_deltas:
            # Many small ones become one, without touching the data below.
            change_sets = [self.read_ops(path, base) for path in deltas]
            deltas = (self.write_by_op(newest_changes(change_sets, base.primary_key)),)
        return self.publish(base, base.data, changes, base.by_op, deltas)

    def _size(self, *paths: str) -> int:
        return sum(files.size(self.spark, path) for path in paths)

    def compact(self) -> Version:
        """Write the current version in full, without change sets on top."""
        base = self.current()
        return self._publish_whole(base, base.deltas, None) if base.deltas else base

    def _publish_whole(self, base: Version, deltas: Sequence[str], changes: str | None) -> Version:
        settled, recent, _ = self.parts(replace(base, deltas=tuple(deltas)))
        if base.buckets:
            recent = recent.repartition(base.buckets, *base.primary_key)
        return self.publish(base, self.write_rows(settled.unionByName(recent), base, aligned=True), changes)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data folders no longer named by the last ``keep`` versions.

        Run it when no pull is under way: a folder being written has no commit
        file yet. Commit files stay, so version numbers never repeat.
        """
        kept = [self.version(n) for n in self._numbers()[-keep:]]
        named = {path.rsplit("/", 1)[-1] for v in kept for path in (v.data, v.changes, *v.deltas) if path}
        removed = []
        for folder in files.names(self.spark, f"{self.path}/data"):
            if folder not in named:
                self.spark.sql(f"DROP TABLE IF EXISTS tablesync_{folder}")
                files.delete(self.spark, f"{self.path}/data/{folder}")
                removed.append(folder)
        return removed

    def _commit(self, number: int) -> str:
        return f"{self.path}/commits/{number:010d}.json"

    def _numbers(self) -> list[int]:
        entries = files.names(self.spark, f"{self.path}/commits")
        return sorted(int(e[: -len(".json")]) for e in entries if e.endswith(".json"))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
