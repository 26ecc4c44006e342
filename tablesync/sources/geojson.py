"""The features of GeoJSON documents, cut out by the tasks that read their byte ranges.

A document is read as text in records that end at a closing brace, which any file system can
split. What a record means depends on what lies ahead of it: whether it begins inside a
quoted text, and how deep. Every range of bytes is therefore summed up first, for both cases
of the quotes: how many it has, and how far it goes down on each side of them. One row per range,
in order, then tells every range how it begins, and features are cut out in a second reading.
Features that lie across ranges come in pieces, at most one at each end of a range, which
are put together; so a document of any size, also one in a single line, is read by many tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The batch functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Depth of what a document's own lists hold: inside the document and the list.
MEMBER = 2
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_MARK = re.compile(r'["{}\[\]]')
_SUMMARY = "file string, block bigint, quotes bigint, even bigint, odd bigint"
_PIECES = "file string, block bigint, kind string, text string"
WHOLE, HEAD, MIDDLE, TAIL = "whole", "head", "middle", "tail"


def _slope(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _by_quotes(record: str) -> tuple[int, int, int]:
    """Quotes of a record, and how far it goes down in the stretches with an even and with an odd number of them ahead."""
    if "\\" in record:
        record = _ESCAPED.sub("", record)
    parts = record.split('"')
    if len(parts) == 1:
        return 0, _slope(record), 0
    return len(parts) - 1, sum(map(_slope, parts[::2])), sum(map(_slope, parts[1::2]))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, total = None, [0, 0, 0]
    done: list[tuple] = []
    for batch in batches:
        for file, block, value in _rows(batch):
            if (file, block) != place:
                if place:
                    done.append((*place, *total))
                place, total = (file, block), [0, 0, 0]
            quotes, even, odd = _by_quotes(value + "}")
            if total[0] % 2:
                even, odd = odd, even
            total = [total[0] + quotes, total[1] + even, total[2] + odd]
    if place:
        done.append((*place, *total))
    columns = list(zip(*done)) if done else [[]] * 5
    types = [pa.string(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "block", "quotes", "even", "odd"])


def _member_start(record: str, quoted: bool, depth: int) -> int:
    """Where an object begins that a list of the document holds; -1 if none does."""
    if "\\" in record:
        # Two characters stay two, so that places hold.
        record = _ESCAPED.sub("  ", record)
    for mark in _MARK.finditer(record):
        if mark[0] == '"':
            quoted = not quoted
        elif not quoted:
            if mark[0] == "{" and depth == MEMBER:
                return mark.start()
            depth += 1 if mark[0] in "{[" else -1
    return -1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features that begin and end in one range, and the pieces of others."""
    place, quoted, depth = None, False, 0
    held: list[str] | None = None
    begun = False
    done: list[tuple] = []

    def leave() -> None:
        if held is not None:
            done.append((*place, HEAD if begun else MIDDLE, "".join(held)))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * 4
        types = [pa.string(), pa.int64(), pa.string(), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "block", "kind", "text"])
        done.clear()
        return out

    for batch in batches:
        for file, block, value, starts_quoted, starts_at in _rows(batch):
            if (file, block) != place:
                if place:
                    leave()
                place, quoted, depth = (file, block), starts_quoted, starts_at
                # A range that starts inside a feature has its tail first.
                held, begun = ([], False) if depth > MEMBER else (None, False)
            record = value + "}"
            if held is None:
                start = _member_start(record, quoted, depth)
                if start >= 0:
                    held, begun = [record[start:]], True
            else:
                held.append(record)
            quotes, even, odd = _by_quotes(record)
            depth += odd if quoted else even
            quoted ^= bool(quotes % 2)
            if held is not None and depth <= MEMBER and not quoted:
                done.append((*place, WHOLE if begun else TAIL, "".join(held)))
                held = None
        yield flush()
    if place:
        leave()
    yield flush()


def feature_texts(spark: SparkSession, path: str | list[str], options: Mapping[str, str]) -> DataFrame:
    """``line``: the text of every feature of the documents at ``path``."""
    records = spark.read.options(**options).option("lineSep", "}").text(path)
    records = records.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = records.mapInArrow(_sums, _SUMMARY)
    ranges = ranges.withColumn("quoted", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted"), F.col("odd")).otherwise(F.col("even"))).over(ahead), F.lit(0)))
    # One short row for each range of bytes that a task reads, 128 MB by default: 1 MB of rows for a terabyte.
    starts = F.broadcast(ranges.select("file", "block", "quoted", "depth"))
    placed = records.join(starts, ["file", "block"]).select("file", "block", "value", "quoted", "depth")
    pieces = placed.mapInArrow(_pieces, _PIECES)
    whole = pieces.filter(F.col("kind") == WHOLE).select(F.col("text").alias("line"))
    # At most two pieces of a range; a tail stands ahead of the head of its range.
    cut = pieces.filter(F.col("kind") != WHOLE).withColumn("later", F.col("kind") == HEAD)
    so_far = Window.partitionBy("file").orderBy("block", "later").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("nth", F.sum(F.col("later").cast("int")).over(so_far))
    parts = F.array_sort(F.collect_list(F.struct("block", "later", "text")))
    joined = cut.groupBy("file", "nth").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("line"))
    return whole.unionByName(joined.select("line"))
