"""The near-copy join and the components behind it against plain versions."""

from collections import Counter

import pytest

from tablesync.llm import components, jaccard_forest
from tests.llm.cases import documents, linked, nothing, roots, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SMALL)


def expected(rows):
    pairs = linked(rows)
    links, root = Counter(i for p in pairs for i in p), roots(len(rows), pairs)
    ids = {}
    for r, (doc_id, _) in zip(root, rows):
        ids.setdefault(r, []).append(doc_id)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return sorted(((d, least[r], links[i]) for i, ((d, _), r) in enumerate(zip(rows, root))), key=repr)


def test_classes_and_links_equal_all_pairs(docs):
    found = sorted((tuple(r) for r in jaccard_forest.join(docs).collect()), key=repr)
    assert found == expected(rows_of(docs))


@pytest.mark.parametrize(("block", "partitions"), [(2, 3), (3, 16), (7, 8), (7, 1)])
def test_blocks_of_one_prefix_lose_nothing(spark, monkeypatch, block, partitions):
    """A prefix shared by many nodes is spread over cells; a block that got no node adds nothing."""
    base = [f"w{i}" for i in range(60)]
    rows = [(n, " ".join([*base, f"end{n}"])) for n in range(40)]
    monkeypatch.setattr(jaccard_forest, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = jaccard_forest.join(docs).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 39)}
    assert len(found) == 40


def test_one_row_of_each_class_stays(docs):
    kept = jaccard_forest.distinct_documents(docs)
    assert kept.columns == docs.columns
    rows = rows_of(docs)
    assert kept.count() == len(set(roots(len(rows), linked(rows))))
    assert [r["doc_id"] for r in kept.filter("text = 'one two'").collect()] == [900_004]


def test_empty_table(spark, docs):
    assert jaccard_forest.join(nothing(spark, docs)).collect() == []


def test_prefix_is_shortened_until_the_recall_is_met():
    depth = jaccard_forest.prefix_depth(0.8)
    miss = lambda d: (1 - 0.8**d) ** jaccard_forest.TREES
    assert miss(depth) <= 1 - jaccard_forest.RECALL < miss(depth + 1)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, n) for n in range(101, 160)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in found}
    assert all(root[n] == 1 for n in range(2, 31)) and all(root[n] == 100 for n in range(101, 160))
