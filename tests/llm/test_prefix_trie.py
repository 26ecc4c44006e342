"""The prefix trie against a plain tree and its SQL counterpart."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesync.llm import prefix_trie, queries
from tests.compare import connect, spark_rows, sql_rows
from tests.llm.cases import WORD

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, fork=True):
    """Every node from its definition; rows of one turn do not differ here unless they are equal."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if fork else 0
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = own.get(base, [])[:h] + turns[h:] if fork else turns
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(key[-1][1])) if key else 0
        saved[key] = saved.get(key, 0) + (len(members[key]) - 1) * words
        leaves[key] = leaves.get(key, 0) or 1
        if key:
            up = key[:-1]
            children[up] = children.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[key]
            leaves[up] = leaves.get(up, 0) + leaves[key]
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(key), parent, len(convs), children.get(key, 0), leaves[key], saved[key], digest))
    return sorted(out, key=repr)


def found(spark, rows, fork=True):
    turns = spark.createDataFrame(rows, SCHEMA)
    kwargs = {}
    if fork:
        kwargs = {"base": F.col("conv") - F.col("conv") % 20, "taken": F.crc32(F.col("conv").cast("string").cast("binary")) % 4}
    return sorted((tuple(r) for r in prefix_trie.trie(turns, **kwargs).drop("node").collect()), key=repr)


def awkward(seed, n=40, longest=7):
    """Conversations that share turns, repeat rows, skip turns, lack roles and texts, and fork from missing ones."""
    rng, rows = random.Random(seed), []
    ids = rng.sample([*range(-25, 130), *range(10**12, 10**12 + 60)], n)
    for c in ids:
        for turn in rng.sample([None, *range(longest + 3)], rng.randrange(1, longest)):
            text = rng.choice([None, "", " ", "one", "two words", "three\twords here", "é 漢"])
            rows += [(c, turn, rng.choice(["user", "user", None, "assistant"]), text)] * rng.choice([1, 1, 1, 2])
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_awkward_conversations(spark, seed):
    rows = awkward(seed)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, fork=False) == plain(rows, fork=False)


@pytest.mark.parametrize(("segment", "shard"), [(1, 1), (2, 5), (3, 16)])
def test_cuts_inside_conversations_change_nothing(spark, monkeypatch, segment, shard):
    """Long conversations that share long beginnings, cut into segments, shards and range partitions."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = awkward(5, 12, 4)
    for c, size in ((3, 90), (7, 90), (9, 60), (11, 90), (44, 50), (60, 2)):
        rows += [(c, t, "user", f"turn {t}" if t < 55 else f"{c % 2} {t}") for t in range(size)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, fork=False) == plain(rows, fork=False)


def test_one_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 50)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(1, t, "user", "same words") for t in range(400)] + [(c, 0, "user", "same words") for c in range(2, 300)]
    assert found(spark, rows, fork=False) == plain(rows, fork=False)
    copies = [(1, 1, "user", "again")] * 200
    assert found(spark, copies, fork=False) == plain(copies, fork=False)


def test_equals_sql(spark):
    names, rows = spark_rows(queries.op12_prefix_trie(spark, SMALL))
    assert (names, rows) == sql_rows(connect(SMALL), queries.ORACLE["op12_prefix_trie"])
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    order = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert sorted((tuple(r[names.index(n)] for n in order) for r in rows), key=repr) == plain([tuple(r) for r in turns])


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(empty).collect() == [] and prefix_trie.trie(empty.union(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).collect() == []
    names = "node conv part idx shard slot depth low ends words nth x1 owner base taken kind".split()
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (2, 0, "user", "a b")], "id long, t long, who string, said string")
    turns = turns.select("*", *[F.lit(1).alias(n) for n in names])
    rows = prefix_trie.trie(turns, "id", "t", "who", "said").orderBy("depth").collect()
    assert [(r["conv_id"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in rows] == [(1, 2, 1, 2), (1, 2, 1, 2)]


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(4)
    hi, lo = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    hi[:100] = hi[0]
    twice = np.r_[hi, hi], np.r_[lo, lo]
    slots = prefix_trie.Slots(*twice)
    assert slots.n == 5000 and sorted(slots.of(hi, lo).tolist()) == list(range(5000))
    with pytest.raises(ValueError, match="slot"):
        slots.of(hi[:1] + np.uint64(1), lo[:1])
    assert prefix_trie.Slots(hi[:0], lo[:0]).n == 0
