"""Pulls by changed files: a layer's files are compared with a manifest, only new and changed ones are read.

The manifest of a layer lists each file's path, time of change and length, and the pull that
read it last. Next to it every pull leaves the keys it read per file, so that the keys which a
changed file holds no more, or a vanished file held, are known without reading other files.
A manifest is published after the target, in one step: a pull that fails is repeated in full
by the next one, and repeating it changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.operators.columns import plan_columns
from tablesync.operators.keys import key_condition, right_side
from tablesync.plans.sync import TableSync
from tablesync.sources import files
from tablesync.sources.readers import layer_path, read_source
from tablesync.spec import LayerSpec, SyncError, SyncResult

NEW, CHANGED, SAME, GONE = "new", "changed", "same", "gone"
_MANIFEST = "file string, path string, modified timestamp, length bigint, batch string"


class Manifest:
    """What was read of a layer's files, as numbered versions under the root of a :class:`TableSync`."""

    def __init__(self, sync: TableSync, layer_name: str):
        self.spark, self.path = sync.spark, f"{sync.root}/manifests/{layer_name}"

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/commits") if n.endswith(".json")]

    def number(self) -> int:
        return max(self._numbers(), default=-1)

    def read(self) -> DataFrame:
        number = self.number()
        if number < 0:
            return self.spark.createDataFrame([], _MANIFEST)
        folder = json.loads(files.read_text(self.spark, f"{self.path}/commits/{number:010d}.json"))["files"]
        return self.spark.read.schema(_MANIFEST).parquet(folder)

    def publish(self, number: int, listed: DataFrame) -> None:
        folder = f"{self.path}/files/{uuid.uuid4().hex}"
        listed.write.parquet(folder)
        if not files.create_text(self.spark, f"{self.path}/commits/{number:010d}.json", json.dumps({"files": folder})):
            raise SyncError(f"The files of {self.path} were pulled by someone else at the same time")

    def keys_folder(self, batch: str) -> str:
        return f"{self.path}/keys/batch={batch}"

    def keys(self, schema: str) -> DataFrame:
        """``file``, the key columns and ``batch`` of everything read so far, also what later pulls replaced."""
        return self.spark.read.schema(schema + ", batch string").parquet(f"{self.path}/keys")


def _file_name(name: Column) -> Column:
    """One spelling for names that differ in the slashes after the scheme."""
    return F.regexp_replace(name, "^file:/+", "file:/")


def compare_files(sync: TableSync, spec: LayerSpec) -> DataFrame:
    """``state`` of every file the layer has or had, with what is known about it now and before."""
    listed = sync.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(layer_path(sync.spark, spec))
    now = listed.select(
        _file_name(F.col("_metadata.file_path")).alias("file"), "path", F.col("modificationTime").alias("modified"), "length"
    )
    before = right_side(Manifest(sync, spec.name).read())
    joined = now.join(before, F.col("file") == F.col("_r_file"), "full_outer")
    same = (F.col("modified") == F.col("_r_modified")) & (F.col("length") == F.col("_r_length"))
    state = (
        F.when(F.col("_r_file").isNull(), NEW).when(F.col("file").isNull(), GONE).when(same, SAME).otherwise(CHANGED)
    )
    return joined.select(
        F.coalesce("file", "_r_file").alias("file"), "path", "modified", "length", F.col("_r_batch").alias("batch"), state.alias("state")
    )


def pull_changed_files(sync: TableSync, layer_name: str) -> SyncResult | None:
    """Upsert the rows of new and changed files; None, and nothing read, if there are none and none is gone.

    Where the layer permits deletion and has no filter, rows go whose key was read from a file that is gone or does
    not hold it any more, unless a file read now does. The files to read are named to the driver, as any reader has them.
    """
    spec, spark = sync.layer(layer_name), sync.spark
    manifest = Manifest(sync, layer_name)
    number = manifest.number() + 1
    run_folder = files.run_folder(spark, f"files-{uuid.uuid4().hex}")
    try:
        # Files may change while they are read: every step below sees the same list.
        compare_files(sync, spec).write.parquet(f"{run_folder}/compared")
        compared = spark.read.parquet(f"{run_folder}/compared")
        found = {r["state"]: r["n"] for r in compared.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not found.keys() - {SAME}:
            return None
        batch, result = uuid.uuid4().hex, None
        target = sync.target(spec).current()
        if found.keys() & {NEW, CHANGED}:
            paths = [r["path"] for r in compared.filter(F.col("state").isin(NEW, CHANGED)).select("path").collect()]
            rows = read_source(spark, spec, paths)
            plan = plan_columns(spec.name, rows.schema, target.schema, target.primary_key, spec.primary_key_columns)
            keys = [F.col(f"`{plan.mapped[k]}`").cast(target.schema[k].dataType).alias(k) for k in plan.keys]
            result = sync.pull_rows(layer_name, rows)
            rows.select(_file_name(F.input_file_name()).alias("file"), *keys).write.parquet(manifest.keys_folder(batch))
        else:
            keys_of = spec.primary_key_columns or target.primary_key
            empty = ", ".join(["file string", *[f"`{k}` {target.schema[k].dataType.simpleString()}" for k in keys_of]])
            spark.createDataFrame([], empty).write.parquet(manifest.keys_folder(batch))
        if spec.allow_feature_deletion and not spec.filter and not spec.conditions and found.keys() & {CHANGED, GONE}:
            gone = _vanished_keys(manifest, compared, batch, spec, target)
            removed = sync.remove_by_attributes(layer_name, gone)
            result = removed if result is None else _both(result, removed)
        now = F.when(F.col("state") == SAME, F.col("batch")).otherwise(F.lit(batch)).alias("batch")
        manifest.publish(number, compared.filter(F.col("state") != GONE).select("file", "path", "modified", "length", now))
        return result
    finally:
        files.delete(spark, run_folder)


def _vanished_keys(manifest: Manifest, compared: DataFrame, batch: str, spec: LayerSpec, target) -> DataFrame:
    """Keys last read from files that are changed or gone, and in no file as it is now."""
    names = list(spec.primary_key_columns or target.primary_key)
    schema = ", ".join(["file string", *[f"`{k}` {target.schema[k].dataType.simpleString()}" for k in names]])
    read = manifest.keys(schema)
    before = compared.filter(F.col("state").isin(CHANGED, GONE)).select("file", "batch")
    old = read.join(before, ["file", "batch"]).select(*names)
    kept = read.join(compared.filter(F.col("state") == SAME).select("file", "batch"), ["file", "batch"], "left_semi")
    still = kept.unionByName(read.filter(F.col("batch") == batch))
    return old.join(right_side(still, names).distinct(), key_condition(names), "left_anti").distinct()


def _both(pulled: SyncResult, removed: SyncResult) -> SyncResult:
    return replace(pulled, num_deleted=removed.num_deleted, version=removed.version)
