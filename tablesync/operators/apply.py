"""New target contents from a change set, full refresh, counters."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablesync.operators.diff import CHANGES, DELETE, INSERT, OP, SAME, UPDATE, as_inserts
from tablesync.operators.keys import key_condition, right_side


def result_rows(classified: DataFrame) -> DataFrame:
    """The target after the sync, from fully classified rows."""
    return classified.filter(F.col(OP) != DELETE).drop(OP)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], null_safe: bool = True) -> DataFrame:
    """The target after a change set, for a target whose key is unique.

    Untouched rows pass straight through: a small change set is broadcast and
    a bucketed target keeps its layout, so the large side is not shuffled.
    """
    touched = right_side(changes.filter(F.col(OP).isin(UPDATE, DELETE)), keys)
    survivors = target.join(touched, key_condition(keys, null_safe), "left_anti")
    return survivors.unionByName(changes.filter(F.col(OP).isin(INSERT, UPDATE)).drop(OP))


def newest_changes(change_sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One change per key out of successive change sets: the last one."""
    if len(change_sets) == 1:
        return change_sets[0]
    stacked = _stacked(change_sets)
    newest = Window.partitionBy(*keys).orderBy(F.desc("_seq"))
    ranked = stacked.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") == 1).drop("_seq", "_rank")


def overlay(
    target: DataFrame, change_sets: Sequence[DataFrame], keys: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A target with later change sets on top, as parts that share no key.

    ``(settled, recent, touched)``: target rows no change set names, the newest
    state of the rows they do name, and the named keys. The target keeps its
    layout.
    """
    named = _stacked(change_sets).select(*keys)
    settled = target.join(right_side(named), key_condition(keys, null_safe=False), "left_anti")
    recent = newest_changes(change_sets, keys).filter(F.col(OP) != DELETE).drop(OP)
    return settled, recent, named.distinct()


def _stacked(change_sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (c.withColumn("_seq", F.lit(i)) for i, c in enumerate(change_sets)))


def refreshed_rows(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Full refresh: the staged rows only, columns the source lacks are NULL."""
    return as_inserts(staged, target).drop(OP)


def rows_deleted_by_refresh(target: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Rows a full refresh removes; truncation counts those whose first key is known."""
    counted = F.count(F.col(f"`{keys[0]}`")) if method == "truncate" else F.count(F.lit(1))
    return target.agg(counted.alias("num_deleted"))


def counts_per_op(classified: DataFrame) -> DataFrame:
    return classified.groupBy(OP).agg(F.count(F.lit(1)).alias("n"))


def counters(classified: DataFrame) -> dict[str, int]:
    """Rows per operation, zero for absent ones."""
    found = {row[OP]: row["n"] for row in counts_per_op(classified).collect()}
    return {op: found.get(op, 0) for op in (SAME, *CHANGES)}


class Watched:
    """Counts of rows on their way to the one place they are written to; no pass of their own.

    ``df`` has to be written once and as it is; then ``counts`` has a number for every name.
    """

    def __init__(self, df: DataFrame, **conditions: Column):
        self.names = list(conditions)
        self._observation = Observation(f"counts-{uuid.uuid4().hex}")
        # The planner drops the observation of rows it knows to be none; nothing is found then.
        self.df = df.observe(self._observation, *[F.count_if(c).alias(name) for name, c in conditions.items()])

    @property
    def counts(self) -> dict[str, int]:
        found = self._observation.get
        return {name: int(found.get(name) or 0) for name in self.names}


def watched_changes(changes: DataFrame, broken: Column | None = None) -> Watched:
    """Rows per operation, and how many new or changed rows are ``broken``."""
    fresh = F.col(OP).isin(INSERT, UPDATE)
    bad = F.lit(False) if broken is None else fresh & broken
    return Watched(changes, **{op: F.col(OP) == op for op in CHANGES}, broken=bad)


def touched_partitions(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], partition_by: Sequence[str], null_safe: bool = True
) -> DataFrame:
    """Partition values holding any changed row, before or after the change."""
    after = changes.select(*partition_by)
    moved = right_side(changes.filter(F.col(OP) == UPDATE), keys)
    before = target.join(moved, key_condition(keys, null_safe), "left_semi").select(*partition_by)
    return after.unionByName(before).distinct()


def partition_rows(
    target: DataFrame,
    changes: DataFrame,
    touched: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    null_safe: bool = True,
) -> DataFrame:
    """New contents of the touched partitions only."""
    affected = target.join(right_side(touched), key_condition(partition_by), "left_semi")
    return apply_changes(affected, changes, keys, null_safe)
