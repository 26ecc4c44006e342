"""Pull and remove, end to end: from a layer to a published version and a run record."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync import runlog as R
from tablesync.operators import apply as A
from tablesync.operators import casting as C
from tablesync.operators import diff as D
from tablesync.operators import keys as K
from tablesync.operators import predicates as P
from tablesync.operators.columns import ColumnPlan, plan_columns
from tablesync.sources import files
from tablesync.sources.readers import lower_names, read_source, with_geometry
from tablesync.sources.snapshot import SnapshotTable, Version
from tablesync.spec import LayerSpec, SyncError, SyncResult, UnknownLayerError

QUARANTINED = "_quarantined"

# Keys of a request document.
LAYER_KEY, FILTER_KEY, SETS_KEY = "layerName", "filter", "attributeSets"
# Key of this library: comparisons that ignore case, next to the filter text.
CONDITIONS_KEY = "conditions"

# Source formats that later steps may read again instead of a staged copy.
IN_PLACE = ("parquet", "orc")


class TableSync:
    """Layers, their target tables under ``root``, and the log of runs.

    Target ``schema.table`` lives at ``root/schema/table`` as a
    :class:`SnapshotTable`; staging goes to the shared folder of the session
    and is removed when a run ends.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        layers: Iterable[LayerSpec],
        max_age_seconds: int = R.MAX_AGE_SECONDS,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self._layers = {spec.name: spec for spec in layers if spec.enabled}
        self.log = R.RunLog(spark, f"{self.root}/runlog", max_age_seconds)

    # --- layers and monitoring

    def layers(self) -> list[dict[str, str]]:
        return [{"name": n, "description": self._layers[n].description} for n in sorted(self._layers)]

    def layer(self, name: str) -> LayerSpec:
        if name not in self._layers:
            raise UnknownLayerError(f'There is no layer "{name}"')
        return self._layers[name]

    def target(self, spec: LayerSpec) -> SnapshotTable:
        path = f"{self.root}/{spec.target_table_schema}/{spec.target_table_name}"
        return SnapshotTable(self.spark, path)

    def jobs(self) -> DataFrame:
        return self.log.list()

    def job(self, run_id: str) -> dict:
        return self.log.get(run_id)

    def status(self) -> dict[str, int]:
        return {"num_layers": len(self._layers), **self.log.status()}

    # --- requests

    def pull_request(self, document: str) -> SyncResult:
        """A pull from its JSON document."""
        request = parse_request(document)
        return self.pull(request[LAYER_KEY], request.get(FILTER_KEY), request.get(CONDITIONS_KEY, ()))

    def remove_request(self, document: str) -> SyncResult:
        request = parse_request(document)
        return self.remove_by_attributes(request[LAYER_KEY], request.get(SETS_KEY, []))

    def pull(
        self, layer_name: str, request_filter: str | None = None, conditions: Sequence[P.Condition] = ()
    ) -> SyncResult:
        """Make the target match the layer's source, or its rows that satisfy the filters.

        ``conditions`` are comparisons of a column, such as
        ``{"column": "name", "operator": "like", "value": "a%"}``; on texts they ignore case.
        """
        spec = self.layer(layer_name)
        shown = (request_filter or "").strip(P.BLANKS)
        if conditions:
            shown = P.compose_filter(shown, json.dumps(list(conditions)))
        return self._logged(
            R.PULL, spec, lambda run: self._pull(run, spec, request_filter, conditions), filter=shown
        )

    def pull_rows(self, layer_name: str, rows: DataFrame) -> SyncResult:
        """Upsert given source rows; as they may be part of the source, nothing is deleted."""
        spec = replace(self.layer(layer_name), allow_feature_deletion=False, bulk_mode=False)
        if spec.geometry_source:
            rows = with_geometry(rows, spec.geometry_source, spec.source_srid)
        source = lower_names(rows, spec.fid_column)
        condition = P.compose_filter(spec.filter, None)
        return self._logged(R.PULL, spec, lambda run: self._sync(run, spec, source, condition, spec.conditions))

    def remove_by_attributes(
        self, layer_name: str, attribute_sets: Sequence | str | DataFrame
    ) -> SyncResult:
        """Delete target rows matching any attribute set, or any row of a criteria table."""
        spec = self.layer(layer_name)
        shown = None
        if not isinstance(attribute_sets, DataFrame):
            attribute_sets = P.parse_attribute_sets(attribute_sets)
            shown = json.dumps(attribute_sets)
        return self._logged(
            R.REMOVE, spec, lambda run: self._remove(spec, attribute_sets), attribute_sets=shown
        )

    # --- runs

    def _logged(self, kind: str, spec: LayerSpec, work: Callable[[_Run], SyncResult], **request) -> SyncResult:
        """Run ``work`` and log its outcome, after publishing."""
        run_id, added = R.new_run_id(), R.utc_now()
        common = dict(id=run_id, type=kind, layer_name=spec.name, time_added=added, **request)
        self.log.append(status=R.IN_PROCESS, **common)
        run = _Run(run_id)
        try:
            result = work(run)
        except Exception as error:
            message = _message(error)
            self.log.append(
                status=R.FAILED, message=message, time_finished=R.utc_now(), num_pulled=run.pulled, **common
            )
            if isinstance(error, PySparkException):
                raise SyncError(message) from error
            raise
        finally:
            files.delete(self.spark, files.run_folder(self.spark, run_id))
        counts = {c: getattr(result, c) for c in R.COUNTERS}
        self.log.append(
            status=R.FINISHED, message=result.message, time_finished=R.utc_now(), version=result.version,
            **counts, **common,
        )
        self.log.expire()
        return replace(result, id=run_id, type=kind, layer_name=spec.name)

    def _pull(
        self, run: _Run, spec: LayerSpec, request_filter: str | None, conditions: Sequence[P.Condition]
    ) -> SyncResult:
        condition = P.compose_filter(spec.filter, request_filter)
        asked = conditions or (request_filter or "").strip(P.BLANKS)
        if spec.bulk_mode and asked and not spec.allow_bulk_filter:
            raise SyncError(f'Layer "{spec.name}" is refreshed in bulk; a filter would drop all other rows')
        source = read_source(self.spark, spec)
        conditions = (*spec.conditions, *conditions)
        in_place = spec.source_format in IN_PLACE and not condition and not conditions and not spec.geometry_source
        return self._sync(run, spec, source, condition, conditions, in_place)

    def _sync(
        self,
        run: _Run,
        spec: LayerSpec,
        source: DataFrame,
        condition: str,
        conditions: Sequence[P.Condition],
        in_place: bool = False,
    ) -> SyncResult:
        table = self.target(spec)
        base = table.current()
        source = P.apply_filter(source, condition, spec.name, spec.filter_ignores_case)
        source = source.filter(P.all_conditions(source.schema, conditions, spec.name))
        plan = plan_columns(spec.name, source.schema, base.schema, base.primary_key, spec.primary_key_columns)
        stage = self._stage(run, spec, source, base, plan, in_place)
        counts = dict(num_pulled=stage.pulled, num_ignored=stage.ignored)
        if spec.bulk_mode:
            return self._refresh(spec, table, base, stage.rows, plan, counts)
        deletion = spec.allow_feature_deletion and not condition and not conditions
        return self._merge(run, spec, table, base, stage, plan, deletion, counts)

    # --- staging

    def _stage(
        self, run: _Run, spec: LayerSpec, source: DataFrame, base: Version, plan: ColumnPlan, in_place: bool
    ) -> _Stage:
        """Cast the source; good and bad rows apart.

        The rows are written to the run folder once, so that every later step
        sees the same rows without repeating the cast. Column files whose
        values always fit are read in place instead: their list is fixed when
        the source is opened, and later steps read only the columns they need.
        """
        order_by = spec.order_by if spec.on_duplicate_key == "latest" else None
        rows = C.cast_rows(source, base.schema, plan, spec.real_scale, order_by)
        in_place = in_place and C.all_always_fit(source.schema, base.schema, plan)
        if in_place:
            staged = rows.withColumn(QUARANTINED, F.lit(False))
        else:
            if not spec.ignore_failures:
                rows = C.failing_on_errors(rows)
            path = f"{files.run_folder(self.spark, run.id)}/staged"
            watched = A.Watched(rows.withColumn(QUARANTINED, F.size(C.ERRORS) > 0), **_staging_counts(plan))
            watched.df.write.partitionBy(QUARANTINED).parquet(path)
            stored = T.StructType([*rows.schema.fields, T.StructField(QUARANTINED, T.BooleanType())])
            staged = self.spark.read.schema(stored).parquet(path)

        if in_place:
            # Nothing is written that could be counted on its way; only the key columns are read.
            sums = [F.count_if(c).alias(name) for name, c in _staging_counts(plan).items()]
            found = staged.agg(*sums).first().asDict()
        else:
            found = watched.counts
        run.pulled, ignored = found["pulled"], found["ignored"]
        if ignored:
            bad = staged.filter(QUARANTINED).drop(QUARANTINED)
            bad.write.parquet(self._quarantine_folder(spec, run.id))
        if _rejects_nulls(spec, plan) and found["keyless"]:
            raise SyncError(f'The source of layer "{spec.name}" has rows without a value for {", ".join(plan.keys)}')
        good = staged.filter(~F.col(QUARANTINED)).drop(QUARANTINED, C.ERRORS)
        size = (run.pulled - ignored) * _row_width(good)
        if spec.on_duplicate_key != "error":
            good = K.one_row_per_key(good, list(plan.keys), C.ORDER if C.ORDER in good.columns else None).drop(C.ORDER)
        elif not spec.bulk_mode and spec.key_nulls != "not_in" and self.choose_plan(size, plan) == "merge":
            # The join brings the rows of a key together anyway; they are numbered there.
            good = K.numbered(good, list(plan.keys))
        else:
            self._check_unique(run, spec, good, plan)
        return _Stage(good, run.pulled, ignored, size)

    def quarantine(self, spec: LayerSpec, run_id: str) -> DataFrame:
        """Rows a run ignored, with the columns and values that did not fit."""
        return self.spark.read.parquet(self._quarantine_folder(spec, run_id))

    def _quarantine_folder(self, spec: LayerSpec, run_id: str) -> str:
        return f"{self.root}/quarantine/{spec.name}/{run_id}"

    def _check_unique(self, run: _Run, spec: LayerSpec, staged: DataFrame, plan: ColumnPlan) -> None:
        """Fail if a key is repeated; the keys that are, are listed in the quarantine folder."""
        keys = list(plan.keys)
        repeated = K.duplicate_keys(staged, keys)
        if repeated.isEmpty():
            return
        report = f"{self._quarantine_folder(spec, run.id)}-repeated-keys"
        repeated.write.parquet(report)
        listed = self.spark.read.parquet(report)
        examples = "; ".join(f"{tuple(r[k] for k in keys)} {r['n']} times" for r in listed.limit(5).collect())
        raise SyncError(
            f'The source of layer "{spec.name}" repeats {listed.count()} keys, all listed in {report}, such as {examples}'
        )

    # --- changing the target

    def _merge(
        self,
        run: _Run,
        spec: LayerSpec,
        table: SnapshotTable,
        base: Version,
        stage: _Stage,
        plan: ColumnPlan,
        deletion: bool,
        counts: dict[str, int],
    ) -> SyncResult:
        classified = self._classified(spec, table, base, stage, plan, deletion)
        numbered = K.NTH in classified.columns
        again = A.Watched(classified, repeated=F.col(K.NTH) > 1) if numbered else None
        if again:
            classified = again.df.drop(K.NTH)
        changes = A.watched_changes(D.changes_of(classified), _broken(base.schema))
        changes_path = table.write_by_op(changes.df)
        if again and again.counts["repeated"]:
            files.delete(self.spark, changes_path)
            self._check_unique(run, spec, stage.rows.drop(K.NTH), plan)
        found = changes.counts
        broken = found["broken"]
        counts |= dict(num_created=found["insert"], num_updated=found["update"], num_deleted=found["delete"])
        if not any(found[op] for op in D.CHANGES):
            files.delete(self.spark, changes_path)
            return _finished(base, counts)
        if broken:
            raise _constraint_error(spec, broken)
        limit = spec.max_delete_fraction
        if limit is not None and found["delete"] > limit * table.read(base).count():
            raise SyncError(f'Layer "{spec.name}" would delete {found["delete"]} rows, more than its limit')
        # Rows changed by another key still carry the table's own, unless the source writes or lacks it.
        keeps_key = base.primary_key and not set(base.primary_key) & set(plan.mapped) and not found["insert"]
        if plan.keys_from_table or keeps_key:
            return _finished(table.publish_changes(base, changes_path, spec.max_delta_share, spec.max_deltas), counts)
        rows = A.result_rows(classified)
        self._check_primary_key(spec, base, plan, rows)
        return _finished(table.publish(base, table.write_rows(rows, base), changes_path), counts)

    def _check_primary_key(self, spec: LayerSpec, base: Version, plan: ColumnPlan, rows: DataFrame) -> None:
        """A pull by another key must leave the table's own key unique."""
        written = base.primary_key and not plan.keys_from_table and set(base.primary_key) & set(plan.mapped)
        if written and not K.duplicate_keys(rows, base.primary_key).isEmpty():
            raise SyncError(f'Layer "{spec.name}" would repeat the primary key of {spec.target}')

    def _classified(
        self, spec: LayerSpec, table: SnapshotTable, base: Version, stage: _Stage, plan: ColumnPlan, deletion: bool
    ) -> DataFrame:
        """Label the target's rows and the new ones.

        Where change sets lie on top of the target's data, rows they name are
        classified on their own: the two parts share no key, and the large
        one keeps its bucketing.
        """
        keys = list(plan.keys)
        rules = dict(deletion=deletion, null_safe=not plan.keys_from_table, key_nulls=spec.key_nulls)
        if spec.keep_newer:
            rules["order_by"] = _stored_order(spec, plan)
        chosen = self.choose_plan(stage.size, plan)
        if not (base.deltas and plan.keys_from_table and spec.key_nulls != "not_in"):
            return D.classify(table.read(base), stage.rows, keys, plan=chosen, **rules)
        settled, recent, touched = table.parts(base)
        named, on_key = K.right_side(touched), K.key_condition(keys, null_safe=False)
        large = D.classify(settled, stage.rows.join(named, on_key, "left_anti"), keys, plan=chosen, **rules)
        small = D.classify(recent, stage.rows.join(named, on_key, "left_semi"), keys, plan="merge", **rules)
        return large.unionByName(small)

    def choose_plan(self, staged_bytes: int, plan: ColumnPlan) -> str:
        """``probe`` when the staged side, rows times their width, is small enough to broadcast."""
        threshold = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if staged_bytes <= threshold:
            return "probe"
        return "merge" if plan.keys_from_table else "split"

    def _refresh(
        self,
        spec: LayerSpec,
        table: SnapshotTable,
        base: Version,
        staged: DataFrame,
        plan: ColumnPlan,
        counts: dict[str, int],
    ) -> SyncResult:
        """Replace everything; neither the delete permission nor a filter limits it."""
        target = table.read(base)
        deleted = A.rows_deleted_by_refresh(target, plan.keys, spec.bulk_delete_method).first()["num_deleted"]
        rows = A.refreshed_rows(target, staged)
        rule = _broken(base.schema)
        broken = 0 if rule is None else rows.filter(rule).count()
        if broken:
            raise _constraint_error(spec, broken)
        self._check_primary_key(spec, base, plan, rows)
        version = table.publish(base, table.write_rows(rows, base))
        counts |= dict(num_created=counts["num_pulled"] - counts["num_ignored"], num_deleted=deleted)
        if spec.on_duplicate_key != "error":
            counts["num_created"] = table.read(version).count()
        return _finished(version, counts)

    def _remove(self, spec: LayerSpec, criteria) -> SyncResult:
        if not spec.allow_feature_deletion:
            raise SyncError(f'Layer "{spec.name}" does not permit deleting rows')
        table = self.target(spec)
        base = table.current()
        target = table.read(base)
        if isinstance(criteria, DataFrame):
            P.check_attributes([dict.fromkeys(criteria.columns)], target.columns, spec.name)
            flagged = P.flag_criteria_matches(target, criteria)
        else:
            P.check_attributes(criteria, target.columns, spec.name)
            if not criteria:
                return _finished(base, {})
            flagged = P.flag_matches(target, criteria)
        # The matching rows are the change set.
        matched = A.watched_changes(flagged.filter("_matched").drop("_matched").withColumn(D.OP, F.lit(D.DELETE)))
        changes_path = table.write_by_op(matched.df)
        deleted = matched.counts[D.DELETE]
        if not deleted:
            files.delete(self.spark, changes_path)
            return _finished(base, {})
        if base.primary_key:
            version = table.publish_changes(base, changes_path, spec.max_delta_share, spec.max_deltas)
        else:
            kept = flagged.filter("NOT _matched").drop("_matched")
            version = table.publish(base, table.write_rows(kept, base), changes_path)
        return _finished(version, dict(num_deleted=deleted))


@dataclass
class _Run:
    """A run under way; a failed one still reports what it pulled."""

    id: str
    pulled: int = 0


@dataclass(frozen=True)
class _Stage:
    """Rows ready to be merged, how many were read and set aside, estimated bytes."""

    rows: DataFrame
    pulled: int
    ignored: int
    size: int


def parse_request(document: str) -> dict:
    """Check a request document; ``ValueError`` says what is wrong with it."""
    try:
        request = json.loads(document)
    except json.JSONDecodeError as error:
        raise ValueError("The request is no valid JSON") from error
    if not isinstance(request, dict):
        raise ValueError("The request has to be a JSON object")
    if not isinstance(request.get(LAYER_KEY), str):
        raise ValueError(f"The request needs the text {LAYER_KEY}")
    if FILTER_KEY in request:
        if not isinstance(request[FILTER_KEY], str):
            raise ValueError(f"{FILTER_KEY} has to be a text")
        request[FILTER_KEY] = request[FILTER_KEY].strip(P.BLANKS)
    if not isinstance(request.get(CONDITIONS_KEY, []), list):
        raise ValueError(f"{CONDITIONS_KEY} is no list")
    if SETS_KEY in request:
        request[SETS_KEY] = P.parse_attribute_sets(request[SETS_KEY])
    return request


def _stored_order(spec: LayerSpec, plan: ColumnPlan) -> str:
    """The target column that keeps the order of the source rows."""
    for name, source_name in plan.mapped.items():
        if source_name == spec.order_by:
            return name
    raise SyncError(f'Layer "{spec.name}" keeps newer rows; its target needs the column "{spec.order_by}"')


def _staging_counts(plan: ColumnPlan) -> dict[str, Column]:
    good = ~F.col(QUARANTINED)
    return {"pulled": F.lit(True), "ignored": ~good, "keyless": good & K.any_null(plan.keys)}


def _rejects_nulls(spec: LayerSpec, plan: ColumnPlan) -> bool:
    return spec.key_nulls == "reject" or (plan.keys_from_table and spec.key_nulls == "safe")


def _row_width(df: DataFrame) -> int:
    """Bytes that Catalyst reckons for a row of these columns."""
    return 8 + int(df._jdf.schema().defaultSize())


def _broken(schema: T.StructType) -> Column | None:
    """Constraint test for rows of a target, if it has any constraints."""
    constrained = any(not f.nullable or {"srid", "dims"} & set(f.metadata) for f in schema.fields)
    return C.breaks_constraints(schema, schema.names) if constrained else None


def _constraint_error(spec: LayerSpec, rows: int) -> SyncError:
    return SyncError(f'{rows} row(s) of layer "{spec.name}" break a NOT NULL or geometry rule of {spec.target}')


def _finished(version: Version, counts: dict) -> SyncResult:
    return SyncResult(id="", type="", layer_name="", status=R.FINISHED, version=version.number, **counts)


def _message(error: Exception) -> str:
    """The whole text of an error; of a failing row, from the reason given for it on."""
    return str(error).rpartition("[USER_RAISED_EXCEPTION] ")[2] or type(error).__name__
