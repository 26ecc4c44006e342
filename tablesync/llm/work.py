"""Work tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablesync.sources import files

_made: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    The table survives lost executors. It goes with :func:`clean`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{files.shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Delete the work tables this driver has written."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:
            files.delete(spark, path)


atexit.register(clean)
