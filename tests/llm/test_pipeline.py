"""The whole pipeline against its stages put together plainly."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tablesync.llm import packing, phrase_dedup, pii_votes, quality_rules
from tests.llm.cases import ODD, WORD, linked, roots, without_repeats

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark, folder):
    """All rows of the small tables and the odd ones: which documents stay, their words, their pieces and ids."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = table.unionByName(odd, allowMissingColumns=True).withColumn("held", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    judged = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.judge(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    rows = [row for row in rows if judged[row[0], len(WORD.findall(row[1]))]]
    root, first = roots(len(rows), linked(rows)), {}
    for r, (doc_id, text) in sorted(zip(root, rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        first.setdefault(r, (doc_id, text))
    rows = list(first.values())
    assert 0 < len(rows) < docs.count() and len({doc_id for doc_id, _ in rows}) == len(rows)

    cut = phrase_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string"))
    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in cut.collect()}
    assert words == without_repeats(rows) and any(len(words[d]) < len(WORD.findall(t)) for d, t in rows)

    library, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in pii_votes.redact(cut).collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for size in packing.lengths(len(ids)):
            expected.append((r["doc_id"], at, size, ids[at : at + size].tobytes(), len(ids)))
            at += size
    found = corpus_pipeline.run(spark, folder).collect()
    pieces = [(r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in found]
    assert sorted(pieces, key=repr) == sorted(expected, key=repr)
    assert len({r["sequence_id"] for r in found}) == len(found) and {r["offset"] for r in found} == {0}
