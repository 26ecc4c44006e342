"""Document quality without labels: heuristic labelers, their estimated accuracies, a hashed linear scorer.

1. Each labeler says good, bad or nothing about a document; they overlap and disagree.
2. Documents are counted per vote pattern. Expectation-maximisation over these counts estimates how
   often each labeler is right about good and about bad documents, and how likely each pattern means good.
3. The probabilities, as whole parts of :data:`PARTS` so that sums do not depend on their order, weigh
   each document's hashed features in one pass over all documents. The log ratios of the two weighted
   multinomials are the weights of a linear scorer; scale and offset are fitted to the probabilities
   from a histogram of its raw scores. It also judges documents about which no labeler says anything.

All three passes read every document; what comes to the driver is bounded by the numbers of
patterns, buckets and bins.

* NULL, empty and blank texts have no features: all labelers but the one for length are silent, and
  the score is that of the offset alone. They count like any other document.
* Repeated rows each count and get their result; an empty table gives an empty result.
* Columns other than id and text are not read; none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.quality_rules import base_counts, gram_buckets
from tablesync.llm.textblocks import Block, blocks

ships(__name__)

BUCKETS = 1 << 14
PARTS = 1000
#: Bins of the raw scores, and their width.
BINS, BIN_WIDTH = 400, 0.02
#: Probability of good from which a document is called good.
THRESHOLD = 0.5

LABELERS = ("length", "symbols", "capitals", "repetition", "lines", "sentences", "prose")

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>!=~^_{}[]")] = True


def votes(block: Block) -> np.ndarray:
    """1 good, -1 bad, 0 nothing: one row per document, one column per labeler.

    Labelers of defects are silent where they see none: lacking one defect says little.
    """
    counts = base_counts(block)
    words = np.maximum(counts["n_words"], 1)
    chars = np.maximum(counts["word_chars"], 1)
    marks, capitals = block.per_doc(_MARK[block.data]), block.per_doc(_CAPITAL[block.data])
    letters, ends = np.maximum(block.per_doc(_LETTER[block.data]), 1), block.per_doc(_END[block.data])
    lines = block.per_doc(block.data == 10) + 1
    some = counts["n_words"] > 0

    def says(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0)) * some

    plain = (marks < 0.01 * chars) & (capitals < 0.1 * letters) & (chars > 3.5 * words) & (chars < 9 * words)
    return np.column_stack(
        [
            np.where(counts["n_words"] < 20, -1, 0),
            says(marks > 0.05 * chars),
            says(capitals > 0.3 * letters),
            says(counts["n_repeat_words"] > 0.3 * words),
            says(counts["n_dup_lines"] > 0.3 * lines),
            says((ends < words / 60) | (ends > words / 2), (ends > words / 30) & (ends < words / 3)),
            says(np.zeros(block.n, bool), plain & (counts["n_words"] >= 20)),
        ]
    ).astype(np.int8)


def _codes(found: np.ndarray) -> np.ndarray:
    return (found.astype(np.int64) + 1) @ 3 ** np.arange(found.shape[1])


def _decoded(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 - 1 for i in range(len(LABELERS)))


def expectation_maximisation(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good documents, ``rates[labeler, class, vote]`` (good, bad; bad, nothing, good) and the
    probability of each pattern.

    A labeler's silence counts as an answer: one that only sees defects is often silent about good documents.
    No labeler turns round: it says bad about bad documents at least as often as about good ones.
    """
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    vote = np.array([_decoded(c) for c in codes], int).reshape(len(codes), len(LABELERS))
    first = np.array([[0.05, 0.65, 0.30], [0.30, 0.65, 0.05]])
    share, rates = 0.8, np.repeat(first[None], len(LABELERS), 0)
    p = np.full(len(codes), share)
    for _ in range(rounds):
        odds = np.full(len(codes), math.log(share / (1 - share)))
        for k in range(len(LABELERS)):
            odds += np.log(rates[k, 0] / rates[k, 1])[vote[:, k] + 1]
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        share = min(0.98, max(0.02, float(((p * n).sum() + 1) / (n.sum() + 2))))
        for k in range(len(LABELERS)):
            for side, weight in enumerate((p * n, (1 - p) * n)):
                seen = np.array([weight[vote[:, k] == v].sum() for v in (-1, 0, 1)]) + 10 * first[side]
                rates[k, side] = seen / seen.sum()
            for v, low in ((0, 0), (2, 1)):
                if rates[k, low, v] > rates[k, 1 - low, v]:
                    rates[k, :, v] = rates[k, :, v].mean()
    return share, rates, dict(zip(codes, p.tolist()))


def _vote_counts(texts: DataFrame) -> dict[int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                code, n = np.unique(_codes(votes(block)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    found = texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {row["code"]: row["n"] for row in found.collect()}


def _summed(texts: DataFrame, size: int, add) -> np.ndarray:
    """Two vectors of whole numbers that ``add(block, totals)`` sums up over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, size), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                add(block, totals)
        at = np.flatnonzero(totals.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[0, at]), pa.array(totals[1, at])], ["at", "good", "bad"])

    found = texts.mapInArrow(count, "at long, good long, bad long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    out = np.zeros((2, size))
    for row in found.collect():
        out[:, row["at"]] = row["good"], row["bad"]
    return out


def _parts(block: Block, known: np.ndarray) -> np.ndarray:
    """Each document's probability of good in whole parts."""
    return known[_codes(votes(block))]


def raw_scores(block: Block, weights: np.ndarray) -> np.ndarray:
    bucket, doc = gram_buckets(block, len(weights))
    n = np.bincount(doc, minlength=block.n)
    return np.bincount(doc, weights[bucket], minlength=block.n) / np.maximum(n, 1)


def _line(histogram: np.ndarray) -> tuple[float, float]:
    """Scale and offset that make a logistic of the raw score fit the weighted histogram."""
    x = (np.arange(BINS) - BINS / 2 + 0.5) * BIN_WIDTH
    good, bad = histogram / PARTS
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        gap, curve = good - (good + bad) * p, (good + bad) * p * (1 - p)
        gradient = np.array([gap @ x - 1e-3 * a, gap.sum() - 1e-3 * b])
        hessian = np.array([[curve @ (x * x) + 1e-3, curve @ x], [curve @ x, curve.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``weak_label`` (probability from the votes), ``score`` (of the trained scorer), ``good``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = own.select("text")
    _, _, probability = expectation_maximisation(_vote_counts(texts))
    known = np.zeros(3 ** len(LABELERS), np.int64)
    for code, p in probability.items():
        known[code] = round(p * PARTS)

    def features(block: Block, totals: np.ndarray) -> None:
        good = _parts(block, known)
        bucket, doc = gram_buckets(block, buckets)
        totals[0] += np.bincount(bucket, good[doc], minlength=buckets).astype(np.int64)
        totals[1] += np.bincount(bucket, PARTS - good[doc], minlength=buckets).astype(np.int64)

    good, bad = _summed(texts, buckets, features)
    both = (good + bad + PARTS) / (good + bad + PARTS).sum()
    prior = PARTS * 1000
    weights = np.log((good + prior * both) / (good.sum() + prior)) - np.log((bad + prior * both) / (bad.sum() + prior))

    def bins(block: Block, totals: np.ndarray) -> None:
        parts = _parts(block, known)
        at = np.clip(np.floor(raw_scores(block, weights) / BIN_WIDTH) + BINS // 2, 0, BINS - 1).astype(int)
        totals[0] += np.bincount(at, parts, minlength=BINS).astype(np.int64)
        totals[1] += np.bincount(at, PARTS - parts, minlength=BINS).astype(np.int64)

    scale, offset = _line(_summed(texts, BINS, bins))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                p = 1 / (1 + np.exp(-np.clip(scale * raw_scores(block, weights) + offset, -30, 30)))
                weak = _parts(block, known) / PARTS
                ids = batch.column(0).slice(block.rows.start, block.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(weak), pa.array(p)], ["doc_id", "weak_label", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    scored = own.mapInArrow(apply, f"doc_id {kind}, weak_label double, score double")
    return scored.withColumn("good", F.col("score") >= THRESHOLD)
