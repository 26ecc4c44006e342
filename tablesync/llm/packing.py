"""Training sequences from pieces of binary length: no sequence crosses documents, none is padded.

A document's ids, with an end id, are cut into pieces of ``longest`` ids while they last, and the
rest into the powers of two of its binary form, longest first. Each piece is a sequence of its own;
sequences of one length share a bucket, and a batch is taken from one bucket.

* NULL and empty texts have the end id only: one piece of length 1.
* Repeated rows are packed as often as they occur; an empty table gives an empty result.
* Columns other than id and text are not read; none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.bpe_stream import TEXTS, PackedWords, kept, tokenizer_spec
from tablesync.llm.textblocks import parts

ships(__name__)

LONGEST = 2048
END_ID = 1


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of ``n`` ids; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def sequences(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (unsigned, little-endian, 32 bits),
    ``doc_tokens``, ``bucket`` (binary logarithm of the length), ``sequence_id``, ``offset``."""
    spec = tokenizer_spec(docs.sparkSession, tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("packed", spec.value, PackedWords)
        for batch in parts(batches, TEXTS):
            row, start, length, tokens, ids = [], [], [], [], []
            for place, found in enumerate(words.of(batch.column(1))):
                raw = found + end
                n, at = len(raw) // 4, 0
                for size in lengths(n, longest):
                    row.append(place)
                    start.append(at)
                    length.append(size)
                    tokens.append(n)
                    ids.append(raw[4 * at : 4 * (at + size)])
                    at += size
            size = np.array(length, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(size),
                    pa.array(ids, pa.binary()),
                    pa.array(tokens, pa.int64()),
                    pa.array(np.log2(np.maximum(size, 1)).astype(np.int32)),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"],
            )

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    pieces = own.mapInArrow(pack, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, bucket int")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of sequences per length."""
    packed.write.partitionBy("bucket").parquet(path)
