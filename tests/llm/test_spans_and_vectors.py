"""Personal data, host trust and vector search against plain versions; the pipeline on small tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablesync.llm import cover_tree, host_trust, pii_votes
from tablesync.llm.queries import ORACLE, QUERIES, RULES
from tests.compare import connect, spark_rows, sql_rows
from tests.llm.cases import documents, nothing, rows_of

SMALL = "/root/testdata/sf0.001"
PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


CHECKS = [
    lambda m: True,
    lambda m: all(int(p) <= 255 for p in m.split(".")),
    luhn,
    lambda m: 8 <= sum(c.isdigit() for c in m) <= 15,
]


def plain_spans(text):
    return [[m.span() for m in p.finditer(text) if ok(m[0])] for p, ok in zip(PATTERNS, CHECKS)]


def test_strict_spans_equal_the_plain_rules(spark):
    docs = documents(spark, SMALL)
    more = [(1, "x a@b.c " * 700), (2, "1" * 60_000), (3, "1 2" * 20_000), (4, "@@a@b..c.d@e.f"), (5, "😀 a@b.c 1.2.3.4.5.6.7.8")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(910_000 + i, t) for i, t in more], "doc_id long, text string"))
    expected = sorted(
        (
            (d, *[len(s) for s in found], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, s in zip(pii_votes.KINDS, found) for a, b in s).encode()).hexdigest())
            for d, text in rows_of(docs)
            for found in [plain_spans(text)]
        ),
        key=repr,
    )
    rows = pii_votes.find(docs).collect()
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows), key=repr) == expected
    for r in rows:
        starts = [(pii_votes.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in r["spans"].split(",") if s)]
        assert starts == sorted(starts) and len(starts) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


def test_redaction_takes_effect_and_leaves_the_rest(spark):
    docs = documents(spark, SMALL)
    redacted = pii_votes.redact(docs)
    assert redacted.columns == docs.columns
    old = dict(rows_of(docs))
    for r in redacted.filter("doc_id is not null").collect():
        assert not any(plain_spans(r["text"] or "")[:2])
        if not any(c.isdigit() or c == "@" for c in old[r["doc_id"]]):
            assert (r["text"] or "") == old[r["doc_id"]]
    marked = redacted.filter("doc_id = 900010").first()["text"]
    assert marked.startswith("mail [EMAIL][EMAIL] or [PHONE], [CARD]")
    assert pii_votes.find(nothing(spark, docs)).collect() == [] and pii_votes.redact(nothing(spark, docs)).collect() == []


def test_em_trusts_the_better_labeler():
    counts = {(0, 1, 1, 0): 500, (0, 1, -1, 0): 60, (0, -1, 1, 0): 5, (0, -1, -1, 0): 300}
    _, right, p = pii_votes.expectation_maximisation(counts)
    assert right[0] > right[1] and p[0, 1, 1, 0] > 0.95 and p[0, -1, -1, 0] < 0.05


PAGES = [
    (1, "http://good.com/x", '<a href="https://b.org/y">'),
    (2, "http://b.org/z", "<a href=//c.org>"),
    (3, "http://c.org/", None),
    (4, "http://bad.net/es/", ""),
    (5, "http://link.org/", "<A HREF = 'HTTP://BAD.NET/q?x'>"),
    (6, None, None),
    (7, "nothing", "<a href=/own>"),
    (8, "HTTP://WWW.EXAMPLE.COM/en/a?b#c", ""),
    (9, "http://example.com/en/", ""),
    (10, "http://notexample.com?x", ""),
    (10, "http://notexample.com?x", ""),
]


def test_verdicts_follow_rules_then_links(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_trust.judge(pages, RULES).collect()}
    assert found == {
        1: ("good.com", "/x", "com/", "allow"),
        2: ("b.org", "/z", None, "allow"),
        3: ("c.org", "/", None, "allow"),
        4: ("bad.net", "/es/", "net/es/", "block"),
        5: ("link.org", "/", None, "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        9: ("example.com", "/en/", "example.com/en/", "block"),
        10: ("notexample.com", "", None, "allow"),
    }
    assert host_trust.judge(nothing(spark, pages), RULES).collect() == []


def test_propagation_equals_power_iteration(spark, monkeypatch):
    monkeypatch.setattr(host_trust, "SETTLED", 1e-2)
    rng = np.random.default_rng(8)
    weight = np.where(rng.random((12, 12)) < 0.25, rng.integers(1, 5, (12, 12)), 0) * (1 - np.eye(12, dtype=int))
    allowed, blocked = np.zeros(12), np.zeros(12)
    allowed[:3], blocked[9:] = 1, 0.5
    edges = [(f"h{i}", f"h{j}", int(weight[i, j])) for i in range(12) for j in range(12) if weight[i, j]]
    seeds = [(f"h{i}", float(allowed[i]), float(blocked[i])) for i in range(12)]
    found = host_trust.propagate(
        spark.createDataFrame(seeds, "host string, allowed double, blocked double"), spark.createDataFrame(edges, "src string, dst string, weight long")
    ).collect()

    def step(start, links, score):
        moved = host_trust.DAMPING * score @ (links / np.maximum(links.sum(1, keepdims=True), 1))
        return moved + (1 - moved.sum()) * start

    starts = [allowed / allowed.sum(), blocked / blocked.sum()]
    scores, change = starts, 1
    while change >= host_trust.SETTLED:
        new = [step(start, links, score) for start, links, score in zip(starts, (weight, weight.T), scores)]
        change, scores = sum(np.abs(a - b).sum() for a, b in zip(new, scores)), new
    trust, distrust = scores
    for r in found:
        i = int(r["host"][1:])
        assert math.isclose(r["trust"], trust[i], abs_tol=1e-9) and math.isclose(r["distrust"], distrust[i], abs_tol=1e-9)


def test_distrust_reaches_far_hosts_in_large_graphs(spark, monkeypatch):
    """A chain of hosts that ends at a blocked one, next to very many seeds, which make all scores small."""
    monkeypatch.setattr(host_trust, "SETTLED", 0.05)
    length = 24
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 1) for i in range(length)], "src string, dst string, weight long")
    others = spark.range(200_000).select(F.concat(F.lit("o"), "id").alias("host"), F.lit(1.0).alias("allowed"), F.lit(1.0).alias("blocked"))
    seeds = others.union(spark.createDataFrame([(f"c{length}", 0.0, 1.0)], others.schema))
    found = {r["host"]: r for r in host_trust.propagate(seeds, edges).filter("host like 'c%'").collect()}
    assert len(found) == length + 1 and all(r["distrust"] > r["trust"] == 0 for r in found.values())


def test_search_equals_all_products(spark, monkeypatch):
    """Several blocks, ties, copies, unusable vectors, two lengths, values beyond exact doubles."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]
    rows += [(500, None), (550, [math.nan] * 6), (600, [math.inf] * 6), (None, rows[1][1]), (650, [1.0, None]), (700, [0.5, 0.5]), (750, [1.0, 2.0]), (800, [])]
    rows += [(850, [3e6, -2e6, 1e6]), (851, [1e6, 1.0, 2.0]), (852, [3e6, 5.5, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    found = sorted(tuple(r) for r in cover_tree.search(table, F.col("vec_id") % 50 == 0).collect())
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert found == sorted(expected)
    assert cover_tree.search(nothing(spark, table), F.col("vec_id") % 50 == 0).collect() == []


def test_tree_covers_its_points():
    points = np.random.default_rng(10).normal(size=(500, 3))
    tree = cover_tree.CoverTree(points, 8)
    leaves = [r for r, c in zip(tree.rows, tree.children) if not c]
    assert sorted(np.concatenate(leaves)) == list(range(500))
    for centre, radius, rows in zip(tree.centre, tree.radius, tree.rows):
        assert np.sqrt(((points[rows] - points[centre]) ** 2).sum(1)).max() <= radius + 1e-9


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == sql_rows(connect(SMALL), ORACLE[name])


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "substring_dedup", "pii", "packing"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] > 0
    assert docs.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[4]
