"""The log of runs: an append-only table and queries over it."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesync.functions.text import utc_instant_text
from tablesync.sources import files

QUEUED, IN_PROCESS, FINISHED, FAILED = "queued", "in_process", "finished", "failed"
PULL, REMOVE = "pull", "remove-by-attributes"

# Fixed value: seconds a finished or failed run stays listed.
MAX_AGE_SECONDS = 600

# Name of the folder of a day.
DAY = "%Y%m%d"

COUNTERS = ("num_created", "num_updated", "num_deleted", "num_pulled", "num_ignored")
SCHEMA = (
    "id string, type string, time_added timestamp_ntz, time_finished timestamp_ntz, status string,"
    " layer_name string, filter string, attribute_sets string, message string,"
    " num_created bigint, num_updated bigint, num_deleted bigint, num_pulled bigint, num_ignored bigint,"
    " version bigint, recorded timestamp_ntz"
)


def new_run_id() -> str:
    return uuid.uuid4().hex


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _literal(value) -> Column:
    """A literal; times go as text, so that no session time zone is applied to them."""
    return F.lit(str(value) if isinstance(value, dt.datetime) else value)


# --- queries over any DataFrame of runs -------------------------------------------------


def is_done() -> Column:
    return F.col("status").isin(FINISHED, FAILED)


def list_runs(runs: DataFrame) -> DataFrame:
    """Newest first."""
    return runs.orderBy(F.desc("time_added"), "id")


def find_run(runs: DataFrame, run_id) -> DataFrame:
    return runs.filter(F.col("id") == F.lit(run_id))


def status_counts(runs: DataFrame) -> DataFrame:
    """One row with the number of runs per status, zero included."""
    names = {
        "num_queued_jobs": QUEUED,
        "num_in_process_jobs": IN_PROCESS,
        "num_finished_jobs": FINISHED,
        "num_failed_jobs": FAILED,
    }
    return runs.agg(*[F.count_if(F.col("status") == status).alias(name) for name, status in names.items()])


def unexpired(runs: DataFrame, now: Column | dt.datetime, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """Drop finished and failed runs that ended before ``now - max_age_seconds``."""
    oldest = (now if isinstance(now, Column) else _literal(now).cast("timestamp_ntz")) - F.make_dt_interval(secs=F.lit(max_age_seconds))
    expired = is_done() & (F.col("time_finished") < oldest)
    return runs.filter(~F.coalesce(expired, F.lit(False)))


def run_json(runs: DataFrame) -> DataFrame:
    """``id, json``: the run as the monitoring interface shows it.

    Finish time and counters appear only when the run is done; ``filter``
    belongs to pulls, ``attributeSets`` to removals.
    """
    done = is_done()
    shown = [
        F.col("id"),
        utc_instant_text(F.col("time_added")).alias("timeAdded"),
        F.when(done, utc_instant_text(F.col("time_finished"))).alias("timeFinished"),
        F.col("type"),
        F.col("status"),
        F.col("layer_name").alias("layerName"),
        F.when(F.col("type") == PULL, F.coalesce("filter", F.lit(""))).alias("filter"),
        F.when(
            F.col("type") == REMOVE,
            F.from_json("attribute_sets", "array<map<string,string>>"),
        ).alias("attributeSets"),
        F.coalesce("message", F.lit("")).alias("message"),
        *[
            F.when(done, F.coalesce(F.col(c), F.lit(0))).alias("num" + c.removeprefix("num_").capitalize())
            for c in COUNTERS
        ],
    ]
    return runs.select("id", F.to_json(F.struct(*shown)).alias("json"))


# --- the stored log ----------------------------------------------------------------------


class RunLog:
    """Records under ``path``; the newest record of a run is its state."""

    def __init__(self, spark: SparkSession, path: str, max_age_seconds: int = MAX_AGE_SECONDS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.max_age_seconds = max_age_seconds

    def append(self, **record) -> None:
        """Add a record to the folder of the day its run was added."""
        record.setdefault("recorded", utc_now())
        fields = dict(part.split() for part in SCHEMA.split(","))
        unknown = set(record) - set(fields)
        if unknown:
            raise ValueError(f"unknown run fields: {sorted(unknown)}")
        values = [_literal(record.get(name)).cast(kind).alias(name) for name, kind in fields.items()]
        day = (record.get("time_added") or record["recorded"]).strftime(DAY)
        self.spark.range(0, 1, 1, 1).select(*values).write.mode("append").parquet(f"{self.path}/{day}")

    def runs(self) -> DataFrame:
        """Current state of every run that has not expired."""
        return unexpired(self._latest(), utc_now(), self.max_age_seconds)

    def list(self) -> DataFrame:
        return list_runs(self.runs())

    def get(self, run_id: str) -> dict:
        row = run_json(find_run(self.runs(), run_id)).first()
        if row is None:
            raise KeyError(f"There is no run {run_id}")
        return json.loads(row["json"])

    def status(self) -> dict[str, int]:
        return status_counts(self.runs()).first().asDict()

    def expire(self) -> None:
        """Drop days that are over and hold no run that is still listed; nothing is rewritten.

        New runs go to today's folder and an open run keeps its day, so no record is lost to a writer.
        """
        today = utc_now().strftime(DAY)
        for day in self._days():
            if day < today and unexpired(self._latest([day]), utc_now(), self.max_age_seconds).isEmpty():
                files.delete(self.spark, f"{self.path}/{day}")

    def _latest(self, days: list[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{day}" for day in (self._days() if days is None else days)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        records = self.spark.read.schema(SCHEMA).parquet(*folders)
        newest = Window.partitionBy("id").orderBy(F.desc("recorded"), F.desc(is_done()))
        return records.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")

    def _days(self) -> list[str]:
        return [name for name in files.names(self.spark, self.path) if name.isdigit()]
