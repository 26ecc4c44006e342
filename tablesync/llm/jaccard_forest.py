"""Near-copies by a MinHash LSH forest over word shingles, verified exactly.

Every text is the set of its runs of :data:`SHINGLE` words; a text of fewer words is
one run, a text without words links to nothing. Two documents are linked if the
Jaccard similarity of their sets is at least the threshold.

1. Equal sets collapse into one node with a number of copies.
2. Each of ``TREES`` tries holds the nodes by a label of MinHash values. The matched
   prefix starts at :data:`LONGEST` values and is shortened until a pair at the
   threshold shares a prefix in some trie with the probability :data:`RECALL`.
   A trie is kept sorted, so that the nodes below one prefix lie together.
3. Nodes below one prefix are compared in cells of two blocks of :data:`BLOCK` nodes at
   most, so a prefix that many nodes share is spread over tasks. A pair counts in
   the first trie that joins it only; nodes without such a pair are dropped before any text moves.
4. The texts of the remaining nodes meet in their cells. Each cell counts the exact links
   of its nodes and reports one spanning forest; classes are the components of these.

Results: ``doc_id``, ``class_id`` (smallest id of the class), ``n_links`` (other documents
with a similarity of at least the threshold, copies included).

* NULL, empty and blank texts: a class of their own, no links; ``class_id`` is the ``doc_id``.
* Repeated rows are copies of each other; each comes back with its own row.
* NULL ids are allowed; a class of such rows only has a NULL ``class_id``.
* An empty table gives an empty result. Other columns are not read; none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.components import components
from tablesync.llm.textblocks import Block, blocks, grams, mix, parts
from tablesync.llm.work import stored

ships(__name__)

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
LONGEST = 8
RECALL = 0.9999
#: Nodes of a block; a cell compares two blocks.
BLOCK = 256
#: Rows that are worked on at one time.
ROWS = 1000
#: Columns of a dense membership matrix built at once.
SLICE = 4096

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, TREES * LONGEST, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, TREES * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix that still joins pairs at the threshold with the wanted probability."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(block: Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and where each document's start."""
    at = np.flatnonzero(block.full(k))
    doc, value = [block.doc_of_word[at]], [block.grams(k)[at]]
    for short in range(1, k):
        docs = np.flatnonzero(block.counts == short)
        doc.append(docs)
        value.append(grams(block.word_hashes, short)[block.first[docs]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(block.n + 1))


def _signatures(depth: int, k: int):
    """Per row: a 128-bit key of its set, a prefix key for each trie, its text compressed."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in parts(batches, ROWS):
            for block in blocks(batch.column(1)):
                value, start = shingle_sets(block, k)
                used = np.flatnonzero(np.diff(start))
                first = start[used]
                set_key = np.zeros((2, block.n), np.uint64)
                keys = np.zeros((block.n, TREES), np.uint64)
                if len(used):
                    set_key[0, used] = mix(np.add.reduceat(mix(value ^ _XOR[0]), first))
                    set_key[1, used] = mix(np.add.reduceat(mix(value ^ _XOR[1]), first))
                    for tree in range(TREES):
                        label = np.full(len(used), tree + 1, np.uint64)
                        for i in range(tree * LONGEST, tree * LONGEST + depth):
                            label = mix(label) + np.minimum.reduceat((value ^ _XOR[i]) * _ODD[i], first)
                        keys[used, tree] = mix(label)
                texts = [pack.compress(bytes(block.data[a:b])) for a, b in zip(block.offsets, block.offsets[1:])]
                has_words = np.zeros(block.n, bool)
                has_words[used] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.rows.start, block.n),
                        batch.column(2).slice(block.rows.start, block.n),
                        pa.array(set_key[0].view(np.int64)),
                        pa.array(set_key[1].view(np.int64)),
                        pa.array(has_words),
                        pa.array([row.tobytes() for row in keys], pa.binary()),
                        pa.array(texts, pa.binary()),
                    ],
                    ["row", "doc_id", "k1", "k2", "has_words", "keys", "ztext"],
                )

    return sign


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, ROWS):
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        node = np.repeat(batch.column(0).to_numpy(), TREES)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys)], ["node", "prefix"])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a partition sorted by cell, cut so that no cell is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((cell[0][1:] != cell[0][:-1]) | (cell[1][1:] != cell[1][:-1])) + 1
        if held and (held[-1].column(0)[-1] != batch.column(0)[0] or held[-1].column(1)[-1] != batch.column(1)[0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])])
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    prefix, cell = table.column("prefix").to_numpy(), table.column("cell").to_numpy()
    edge = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (cell[1:] != cell[:-1])])
    return edge, np.r_[edge[1:], len(prefix)]


def _new_pairs(keys: np.ndarray, side: np.ndarray, within: bool, prefix: np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that no earlier trie joins; within its only block, or across its two, one of which may have no nodes."""
    tree = int(np.flatnonzero(keys[0] == prefix)[0])
    left, right = (np.arange(len(keys)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    met = np.zeros((len(left), len(right)), bool)
    for earlier in range(tree):
        met |= keys[left, earlier][:, None] == keys[right, earlier][None, :]
    i, j = np.nonzero(~met)
    i, j = left[i], right[j]
    return (i[i < j], j[i < j]) if within else (i, j)


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes that have a pair to verify in their cell."""
    for table in _by_cell(batches):
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, TREES)
        side, prefix, within = (table.column(c).to_numpy() for c in ("side", "prefix", "within"))
        wanted = np.zeros(len(keys), bool)
        for a, b in zip(*_cells(table)):
            if b - a > 1:
                i, j = _new_pairs(keys[a:b], side[a:b], bool(within[a]), prefix[a])
                wanted[a + i] = wanted[a + j] = True
        yield from table.filter(pa.array(wanted)).to_batches()


def _shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs."""
    if len(i) < 32:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = times > 1
    rank = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(several.sum()), SLICE):
        a, b = np.searchsorted(column, [low, low + SLICE])
        dense = np.zeros((len(sets), SLICE), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        total += dense @ dense.T
    return total[i, j].astype(np.int64)


def _verify(threshold: float, k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell: for each node how many documents it links to there, and its tree edge."""
        unpack = zstandard.ZstdDecompressor()
        for table in _by_cell(batches):
            keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, TREES)
            side, prefix, within = (table.column(c).to_numpy() for c in ("side", "prefix", "within"))
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            packed = table.column("ztext").to_pylist()
            links, root = np.zeros(len(node), np.int64), node.copy()
            for a, b in zip(*_cells(table)):
                if b - a < 2:
                    continue
                sets: list[np.ndarray] = []
                for block in blocks(pa.array([unpack.decompress(z).decode() for z in packed[a:b]], pa.large_string())):
                    value, start = shingle_sets(block, k)
                    sets += [value[x:y] for x, y in zip(start, start[1:])]
                i, j = _new_pairs(keys[a:b], side[a:b], bool(within[a]), prefix[a])
                shared = _shared_counts(sets, i, j)
                sizes = np.array([len(s) for s in sets])
                linked = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
                i, j = i[linked], j[linked]
                np.add.at(links, a + i, copies[a + j])
                np.add.at(links, a + j, copies[a + i])
                root[a:b] = _roots(node[a:b], i, j)
            found = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[found]), pa.array(root[found]), pa.array(links[found])], ["node", "root", "links"]
            )

    return verify


def _roots(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component among the pairs of one cell."""
    label = node.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def classes(rows: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """For rows of a unique long ``row``, an id ``doc_id`` and a ``text``: ``row``, ``doc_id``,
    ``class_id``, ``n_links``, ``stays`` (one row of each class, with its smallest id)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, k1 long, k2 long, has_words boolean, keys binary, ztext binary"
    signed = rows.select("row", "text", "doc_id").mapInArrow(_signatures(prefix_depth(threshold), k), schema)
    # The joins below are hinted: small inputs then take the plan that large ones take.
    signed = stored(signed, "signed")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    # Rows without words stay alone: their row number sets them apart.
    alone = F.when(F.col("has_words"), F.lit(-1)).otherwise(F.col("row"))
    keyed = signed.select("row", "doc_id", "k1", "k2", alone.alias("alone"))
    nodes = keyed.groupBy("k1", "k2", "alone").agg(first, F.count("*").alias("copies"))
    nodes = nodes.select("k1", "k2", "alone", F.col("first.row").alias("node"), F.col("first.doc_id").alias("id"), "copies")
    nodes = stored(nodes, "nodes")

    able = nodes.filter("alone = -1").select("node", "copies")
    labels = able.join(signed.select(F.col("row").alias("node"), "keys").hint("merge"), "node").select("node", "copies", "keys")
    labels = stored(labels, "labels")
    members = labels.select("node", "keys").mapInArrow(_explode_keys, "node long, prefix long")
    full = stored(members.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1"), "prefixes")
    spread = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node"), F.col("spread")).cast("int")
    cells = members.join(full.hint("merge"), "prefix").withColumn("spread", spread).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), (F.col("spread") - 1).cast("int"))).alias("other")
    cells = cells.select("prefix", "node", "spread", "own", other)
    place = F.least("own", "other") * F.col("spread") + F.greatest("own", "other")
    side = (F.col("own") > F.col("other")).cast("int")
    within = (F.col("own") == F.col("other")).alias("within")
    cells = cells.select("prefix", place.alias("cell"), "node", side.alias("side"), within)
    cells = cells.join(labels.hint("merge"), "node").select("prefix", "cell", "node", "side", "within", "copies", "keys")
    sorted_cells = cells.repartition("prefix", "cell").sortWithinPartitions("prefix", "cell", "node")
    needed = stored(sorted_cells.mapInArrow(_needed, cells.schema), "needed")

    texts = signed.select(F.col("row").alias("node"), "ztext").join(needed.select("node").distinct().hint("merge"), "node")
    pairs = needed.join(stored(texts, "texts").hint("merge"), "node").select("prefix", "cell", "node", "side", "within", "copies", "keys", "ztext")
    pairs = pairs.repartition("prefix", "cell").sortWithinPartitions("prefix", "cell", "node")
    found = stored(pairs.mapInArrow(_verify(threshold, k), "node long, root long, links long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.join(grouped.hint("merge"), "node", "left").join(links.hint("merge"), "node", "left")
    placed = stored(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best")
    heads = stored(placed.groupBy("root").agg(best), "heads")
    placed = placed.join(heads.hint("merge"), "root").select(
        "k1", "k2", "alone", F.col("best.id").alias("class_id"), F.col("best.node").alias("head"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    done = keyed.join(stored(placed, "classes").hint("merge"), ["k1", "k2", "alone"])
    return done.select("row", "doc_id", "class_id", "n_links", (F.col("row") == F.col("head")).alias("stays"))


def numbered(docs: DataFrame, columns: list) -> DataFrame:
    """The columns and a ``row`` number, written once so that the number holds in every later read."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "numbered")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``class_id`` and ``n_links`` for every row of ``docs``."""
    rows = numbered(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")])
    return classes(rows, threshold).select("doc_id", "class_id", "n_links")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, the one with the smallest id, with all columns of ``docs``."""
    held = numbered(docs, [F.struct(*docs.columns).alias("held")])
    rows = held.select("row", F.col("held")[doc_id].alias("doc_id"), F.col("held")[text].alias("text"))
    stay = classes(rows).filter("stays").select("row")
    return held.join(stay, "row").select("held.*")
