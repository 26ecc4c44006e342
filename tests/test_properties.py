"""Random source and target pairs against the rules spelled out in plain Python."""

import random

import pytest

from tablesync.operators import apply as A
from tablesync.operators import diff as D
from tablesync.operators import keys as K

SCHEMA_T = "a int, b string, v int, note string"
SCHEMA_S = "a int, b string, v int"
KEYS = ["a", "b"]


def random_pair(seed, unique, nulls):
    rng = random.Random(seed)
    key = lambda: (
        None if nulls and rng.random() < 0.1 else rng.randrange(8),
        None if nulls and rng.random() < 0.1 else rng.choice("xyz"),
    )
    value = lambda: rng.choice([None, 1, 2])
    target = [(*key(), value(), f"n{i}") for i in range(rng.randrange(0, 40))]
    if unique:
        target = list({row[:2]: row for row in target}.values())
    staged = list({k: (*k, value()) for k in (key() for _ in range(rng.randrange(0, 25)))}.values())
    return target, staged


def maybe_equal(k, other):
    return all(x is None or y is None or x == y for x, y in zip(k, other))


def expected(target, staged, deletion, not_in):
    fresh = {row[:2]: row for row in staged}
    stored_keys = [row[:2] for row in target]
    out = []
    for a, b, v, note in target:
        new = fresh.get((a, b))
        if new is not None:
            out.append((a, b, new[2], note, "same" if new[2] == v else "update"))
        else:
            gone = deletion and not (not_in and any(maybe_equal((a, b), k) for k in fresh))
            out.append((a, b, v, note, "delete" if gone else "same"))
    for a, b, v in staged:
        known = any(maybe_equal((a, b), k) for k in stored_keys) if not_in else (a, b) in stored_keys
        if not known:
            out.append((a, b, v, None, "insert"))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("plan, unique, not_in", [("merge", True, False), ("probe", False, False), ("split", False, False), ("split", True, True), ("probe", False, True)])
def test_classification(spark, seed, plan, unique, not_in):
    target, staged = random_pair(seed * 31 + len(plan), unique, nulls=True)
    deletion = seed % 2 == 0
    t, s = spark.createDataFrame(target, SCHEMA_T), spark.createDataFrame(staged, SCHEMA_S)
    found = D.classify(t, s, KEYS, deletion=deletion, plan=plan, key_nulls="not_in" if not_in else "safe")
    assert rows(found) == expected(target, staged, deletion, not_in)


@pytest.mark.parametrize("seed", range(4))
def test_convergence_and_idempotence(spark, seed):
    target, staged = random_pair(seed, unique=True, nulls=True)
    t, s = spark.createDataFrame(target, SCHEMA_T), spark.createDataFrame(staged, SCHEMA_S)
    classified = D.classify(t, s, KEYS, deletion=True)
    result = A.result_rows(classified)
    # Mapped columns equal the source, and a second pull finds nothing to do.
    assert rows(result.select("a", "b", "v")) == sorted(staged, key=repr)
    counts = A.counters(D.classify(result, s, KEYS, deletion=True))
    assert (counts["insert"], counts["update"], counts["delete"]) == (0, 0, 0)
    # The change set leads to the same table, and untouched columns keep their values.
    assert rows(A.apply_changes(t, D.changes_of(classified), KEYS)) == rows(result)
    notes = {row[:2]: row[3] for row in target}
    assert all(r["note"] == notes.get((r["a"], r["b"])) for r in result.collect())
    # Every staged row is created, updated or unchanged.
    kinds = A.counters(classified)
    assert kinds["insert"] + kinds["update"] + kinds["same"] == len(staged)


@pytest.mark.parametrize("seed", range(3))
def test_partial_pull_never_deletes(spark, seed):
    target, staged = random_pair(seed + 90, unique=True, nulls=False)
    t, s = spark.createDataFrame(target, SCHEMA_T), spark.createDataFrame(staged[::2], SCHEMA_S)
    result = A.result_rows(D.classify(t, s, KEYS))
    assert {row[:2] for row in target} <= {(r["a"], r["b"]) for r in result.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_single_steps_agree_with_classification(spark, seed):
    target, staged = random_pair(seed + 7, unique=True, nulls=True)
    t, s = spark.createDataFrame(target, SCHEMA_T), spark.createDataFrame(staged, SCHEMA_S)
    by_op = {}
    for *row, op in expected(target, staged, True, False):
        by_op.setdefault(op, []).append(tuple(row))
    assert rows(D.updated_rows(t, s, KEYS)) == by_op.get("update", [])
    assert rows(D.as_inserts(D.missing_rows(s, t, KEYS), t).drop(D.OP)) == by_op.get("insert", [])
    assert rows(D.missing_rows(s, t, KEYS)) == rows(D.missing_rows(s, t, KEYS, unique=True))
    assert rows(D.vanished_rows(t, s, KEYS)) == by_op.get("delete", [])


def test_not_in_with_an_empty_other_side(spark):
    s = spark.createDataFrame([(None, "x", 1), (1, "y", 2)], SCHEMA_S)
    t = spark.createDataFrame([], SCHEMA_T)
    assert D.missing_rows_not_in(s, t, KEYS).count() == 2
    assert D.vanished_rows_not_in(s, t, ["a"]).count() == 2
    assert D.missing_rows_not_in(s.limit(0), s, KEYS).count() == 0


def test_one_row_per_key_is_independent_of_row_order(spark):
    rng = random.Random(5)
    data = [(rng.randrange(5), rng.choice([None, 1, 2]), rng.choice("ab")) for _ in range(60)]
    best = {}
    rank = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for row in data:
        if row[0] not in best or rank(row) > rank(best[row[0]]):
            best[row[0]] = row
    for _ in range(3):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "k int, seq int, x string").repartition(7)
        assert rows(K.one_row_per_key(df, ["k"], "seq")) == sorted(best.values(), key=repr)
