"""Incremental pulls: new source files are upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.plans.sync import TableSync


def source_stream(sync: TableSync, layer_name: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Stream of the files appearing in the layer's source folder."""
    spec = sync.layer(layer_name)
    reader = sync.spark.readStream.format(spec.source_format).options(**spec.source_options).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(f"{spec.source.rstrip('/')}/{spec.source_layer}")


def incremental_pull(
    sync: TableSync,
    layer_name: str,
    rows: DataFrame,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch of ``rows``; never delete, as a batch is partial.

    Without ``interval`` the query takes what is there and stops. Repeating a
    batch after a failure changes nothing, as its rows already match. Files may
    arrive in any order if the layer has ``keep_newer``: the target then keeps the
    ``order_by`` column, and a row that is older than the stored one changes nothing.
    """

    def upsert(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            sync.pull_rows(layer_name, batch)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        rows.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
