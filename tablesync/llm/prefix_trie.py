"""The prefix trie of conversations, in node tables with minimal perfect hashing.

A node is a distinct sequence of first turns (role and text) of some conversation; the root is
the empty one. For every node: its members, children, the leaves below it and the tokens that
storing each prefix once saves.

1. Turns are sorted by conversation and place over range partitions, so that a conversation of any
   length spreads over tasks, and packed into segments. A prefix has a 127-bit polynomial digest;
   it composes, so a segment needs no more than the digest of what lies ahead of it.
2. Segments lie in shards of about :data:`SHARD` rows, in order. A shard enumerates the distinct
   digests of its prefixes and gives each its slot by a minimal perfect hash: in each of its
   levels the digests that are alone at their place stay, the others go to the next level, the
   slot is the rank of the place. Slots keep their digests, and every row is verified against its
   own. Counts are scattered into flat arrays over the slots, one of which holds the parent's slot.
3. Counts of one digest in several shards are added up; a node belongs to its smallest member.
4. What a node adds to its ancestors counts where its owner is: once. It is accumulated through
   the parent slots of that shard, deepest first, and the shards' sums are added up per node.
   A shard that begins inside a conversation holds it alone, below a slot for the prefix ahead; what it
   accumulates is handed to the shards of that conversation before it.
5. Members that end at a node come in ascending lists of :data:`IDS`, hashed one after the other.

A hot conversation, first turn or whole text of a conversation thus never meets in one task, except
for the 8 bytes per id of the conversations that end at one node: a single hash needs them in order.
They are streamed.

* Rows without a conversation id belong to none and are left out. NULL roles and texts are empty.
* NULL turns come first; rows of one turn come in the order of a hash of role and text. Repeated rows are further turns.
* A conversation without turns of its own after a fork may be empty: a member of the root only.
* An empty table has no conversations and no nodes, not even a root.
* Other columns are not read; none can clash. Very long texts are hashed and counted where they are read
  and never moved; a task holds one of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.textblocks import mix
from tablesync.llm.work import stored

ships(__name__)

#: Turns of a segment, and rows of a shard, at most (a shard may exceed it by one segment).
SEGMENT = 1 << 9
SHARD = 1 << 17
#: First turns of a conversation that another one can start with.
LENT = 8
#: Ids in a list of members that end at one node.
IDS = 1 << 11

_PRIME = (1 << 127) - 1
_BASE = 0x3C6EF372FE94F82BA54FF53A5F1D36F1 % _PRIME
_WORD = r"[^\x20\x09-\x0D]+"
_TURN = np.dtype([("x1", "<u8"), ("x2", "<u8"), ("words", "<i8")])


def _values(turns: np.ndarray) -> list[int]:
    """A number for role and text of each turn."""
    return [(a << 64 | b) % _PRIME for a, b in zip(turns["x1"].tolist(), turns["x2"].tolist())]


def _digest(values: list[int], start: int) -> int:
    for v in values:
        start = (start * _BASE + v) % _PRIME
    return start


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, part, x1, x2, words) as segments of one conversation each."""
    open_conv, held, size, idx, part = None, [], 0, 0, 0
    out: list[tuple] = []

    def close():
        nonlocal held, size, idx
        if size:
            turns = np.concatenate(held) if len(held) > 1 else held[0]
            total = _digest(_values(turns), 0).to_bytes(16, "little")
            out.append((open_conv, part, idx, size, total, turns[:LENT].tobytes(), turns.tobytes()))
        held, size, idx = [], 0, idx + 1

    def flush():
        columns = list(zip(*out)) if out else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["conv", "part", "idx", "n", "total", "first", "turns"]
        out_batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        out.clear()
        return out_batch

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, parts, x1, x2, words = (batch.column(i).to_numpy() for i in range(5))
        turns = np.empty(len(conv), _TURN)
        turns["x1"], turns["x2"], turns["words"] = x1.view(np.uint64), x2.view(np.uint64), words
        part = int(parts[0])
        edge = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(conv)]):
            if conv[a] != open_conv:
                close()
                open_conv, idx = int(conv[a]), 0
            while a < b:
                take = min(b - a, SEGMENT - size)
                held.append(turns[a : a + take])
                size += take
                a += take
                if size == SEGMENT:
                    close()
        yield flush()
    close()
    yield flush()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments without their turns, in order: adds the place of the first turn, the digest of the
    turns ahead, the conversation's first turns, and whether a segment is the last of its conversation."""
    open_conv, before, ahead, first, waiting = None, 0, 0, b"", None
    for batch in batches:
        out: list[tuple] = []
        for conv, part, idx, n, total, own in zip(*(c.to_pylist() for c in batch.columns)):
            if waiting:
                out.append((*waiting, conv != open_conv))
            if conv != open_conv:
                open_conv, before, ahead, first = conv, 0, 0, b""
            missing = LENT * _TURN.itemsize - len(first)
            first += own[:missing]
            waiting = conv, part, idx, before, ahead.to_bytes(16, "little"), first
            ahead = (ahead * pow(_BASE, n, _PRIME) + int.from_bytes(total, "little")) % _PRIME
            before += n
        yield _place_rows(out)
    yield _place_rows([(*waiting, True)] if waiting else [])


def _place_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
    names = ["conv", "part", "idx", "before", "ahead", "first", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class Slots:
    """A minimal perfect hash of distinct 128-bit digests."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        hi, lo = hi[new], lo[new]
        self.n = len(hi)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, base = np.arange(self.n), 0
        while len(rest):
            size = 2 * len(rest) + 1
            place = self._place(hi[rest], lo[rest], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            stay = alone[place]
            base += int(stay.sum())
            rest = rest[~stay]
        # The digests that the slots stand for, to verify look-ups by.
        self.hi, self.lo = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        slot = self._find(hi, lo)
        self.hi[slot], self.lo[slot] = hi, lo

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(lo ^ mix(hi + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot, rest = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(hi[rest], lo[rest], level, len(alone))
            here = alone[place]
            slot[rest[here]] = rank[place[here]]
            rest = rest[~here]
            if not len(rest):
                break
        return slot

    def of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        slot = self._find(hi, lo)
        if len(slot) and (slot.min() < 0 or (self.hi[slot] != hi).any() or (self.lo[slot] != lo).any()):
            raise ValueError("a digest without a slot of its own")
        return slot


class _Shard:
    """Rows of prefixes, in order; each follows its parent unless it starts a segment anew."""

    def __init__(self, number: int):
        self.number = number
        self.digest = bytearray()
        self.depth: list[int] = []
        self.conv: list[int] = []
        self.words: list[int] = []
        self.member: list[bool] = []
        self.starts: list[bool] = []
        self.ends: list[int] = []
        self.alone: int | None = None

    def add(self, digests: list[int], depth: int, conv: int, words: list[int], member: bool, starts: bool) -> None:
        self.digest += b"".join([d.to_bytes(16, "little") for d in digests])
        n = len(digests)
        self.depth += range(depth, depth + n)
        self.conv += [conv] * n
        self.words += words
        self.member += [member] * n
        self.starts += [starts, *[False] * (n - 1)][:n]

    def table(self) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        keys = np.frombuffer(bytes(self.digest), "<u8").reshape(-1, 2)
        lo, hi = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        slots = Slots(hi, lo)
        slot = slots.of(hi, lo)
        conv, member, starts = np.array(self.conv), np.array(self.member), np.array(self.starts)
        members = np.bincount(slot[member], minlength=slots.n)
        # Conversations come in ascending order, so that the first one to write last is the smallest.
        low, depth, words = np.full(slots.n, -1), np.zeros(slots.n, np.int64), np.zeros(slots.n, np.int64)
        low[slot[member][::-1]] = conv[member][::-1]
        depth[slot], words[slot] = self.depth, self.words
        parent = np.full(slots.n, -1)
        below = np.flatnonzero(~starts)
        parent[slot[below]] = slot[below - 1]
        last = np.array(self.ends, np.int64)
        order = np.argsort(slot[last], kind="stable")
        at, whose = slot[last][order], conv[last][order]
        count = np.bincount(at, minlength=slots.n)
        tail = np.zeros(slots.n, bool)
        tail[slot[-1]] = True
        none = members == 0
        digests = np.stack([slots.lo, slots.hi], 1).astype("<u8")
        alone = pa.nulls(slots.n, pa.int64()) if self.alone is None else pa.array(np.full(slots.n, self.alone))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(slots.n, self.number)),
                pa.array(np.arange(slots.n)),
                pa.array(parent),
                pa.array([d.tobytes() for d in digests], pa.binary()),
                pa.array(depth),
                pa.array(low, mask=none),
                pa.array(members),
                pa.array(count),
                pa.array(words),
                pa.nulls(slots.n, pa.binary()),
                alone,
                pa.array(np.where(tail, self.conv[-1], 0), mask=~tail),
            ],
            _names(_LOCAL),
        ), self._lists(digests, at, whose, count)

    def _lists(self, digests: np.ndarray, at: np.ndarray, whose: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        """The members that end at each node, ascending, in rows without a slot."""
        rows, ends = [], np.cumsum(count).tolist()
        for slot in np.unique(at).tolist():
            for a in range(ends[slot] - int(count[slot]), ends[slot], IDS):
                ids = whose[a : min(a + IDS, ends[slot])]
                rows.append((digests[slot].tobytes(), int(ids[0]), ids.astype("<i8").tobytes()))
        none = pa.nulls(len(rows), pa.int64())
        node, low, lists = zip(*rows) if rows else [[]] * 3
        own = {
            "shard": pa.array(np.full(len(rows), self.number)),
            "node": pa.array(node, pa.binary()),
            "low": pa.array(low, pa.int64()),
            "ends": pa.array(lists, pa.binary()),
        }
        return pa.RecordBatch.from_arrays([own.get(name, none) for name in _names(_LOCAL)], _names(_LOCAL))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


_LOCAL = (
    "shard long, slot long, parent long, node binary, depth long, low long, members long, n_ends long,"
    " words long, ends binary, alone long, tail long"
)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node tables of the shards of each part; every segment is preceded by the row that places it."""
    shard, part, count, place = None, None, 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["turns"] is None:
                place = row
                continue
            conv, before, taken = place["conv"], place["before"], place["taken"]
            inside = shard is not None and len(shard.conv) and shard.conv[-1] == conv and row["part"] == part
            full = shard is not None and len(shard.conv) >= SHARD
            if shard is None or row["part"] != part or full or (shard.alone is not None and not inside):
                if shard is not None:
                    yield from shard.table()
                count = count + 1 if row["part"] == part else 0
                part, inside = row["part"], False
                shard = _Shard(part << 24 | count)
            lent = np.frombuffer(place["lent"] or b"", _TURN)[:taken]
            head = _values(lent)
            own = np.frombuffer(row["turns"], _TURN)[max(0, taken - before) :]
            start = _digest(head, 1)
            if before == 0:
                shard.add(list(accumulate([1, *head], _step)), 0, conv, [0, *lent["words"].tolist()], True, True)
            elif before > taken:
                skipped = _digest(_values(np.frombuffer(place["first"], _TURN)[:taken]), 0)
                factor = pow(_BASE, before - taken, _PRIME)
                start = (start * factor + int.from_bytes(place["ahead"], "little") - skipped * factor) % _PRIME
            depth = len(head) + max(0, before - taken)
            if before and not inside:
                shard.alone = conv
                shard.add([start], depth, conv, [0], False, True)
            digests = list(accumulate([start, *_values(own)], _step))[1:]
            shard.add(digests, depth + 1, conv, own["words"].tolist(), True, False)
            if place["last"]:
                shard.ends.append(len(shard.conv) - 1)
    if shard is not None:
        yield from shard.table()


def _step(digest: int, value: int) -> int:
    return (digest * _BASE + value) % _PRIME


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows, cut so that each table holds all rows of some values of ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_SUMS = (
    "node binary, shard long, depth long, owner long, n_convs long, parent_conv long, children long,"
    " leaves long, saved long"
)


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard and slot what the owners in this shard add to the node, children by children."""
    for table in _by(batches, "shard"):
        keys = table.column("shard").to_numpy()
        edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edge, edge[1:]):
            yield _accumulate(table.slice(a, b - a))


def _accumulate(table: pa.Table) -> pa.RecordBatch:
    get = lambda name: table.column(name).to_numpy()
    handed = get("slot") < 0
    more_leaves, more_saved = int(get("leaves")[handed].sum()), int(get("saved")[handed].sum())
    table = table.filter(pa.array(~handed))
    parent, depth, members, words = get("parent"), get("depth"), get("members"), get("words")
    owner, n_convs = get("owner"), get("n_convs")
    low = table.column("low").fill_null(-1).to_numpy()
    owned = (members > 0) & (low == owner)
    saved = np.where(owned, (n_convs - 1) * words, 0)
    leaves = (owned & (get("all_ends") == n_convs)).astype(np.int64)
    tail = table.column("tail").is_valid().to_numpy()
    saved[tail] += more_saved
    leaves[tail] += more_leaves
    below = parent >= 0
    children = np.bincount(parent[below & owned], minlength=len(parent))
    order = np.argsort(-depth, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(depth[order]) != 0, True])
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        rows = order[a:b]
        rows = rows[below[rows]]
        np.add.at(saved, parent[rows], saved[rows])
        np.add.at(leaves, parent[rows], leaves[rows])
    # The prefix ahead of the shard gets its sums from the shard that holds it.
    ghost = members == 0
    saved[ghost] = leaves[ghost] = 0
    return pa.RecordBatch.from_arrays(
        [
            *(table.column(n).combine_chunks() for n in ("node", "shard", "depth", "owner", "n_convs")),
            pa.array(owner[parent], mask=~(below & owned)),
            pa.array(children),
            pa.array(leaves),
            pa.array(saved),
        ],
        _names(_SUMS),
    )


_NODES = (
    "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string"
)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a node, by shard, added up; the hash takes in the members that end there list by list."""
    node, row, digest, some = None, None, None, False

    def done():
        return (*row, digest.hexdigest())

    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for key, _, depth, owner, n_convs, parent, children, leaves, saved, low, ends in zip(*columns):
            if key != node:
                if row:
                    out.append(done())
                node, row, digest, some = key, [key, None, None, None, None, 0, 0, 0], hashlib.sha256(), False
            if ends is not None:
                digest.update(("," * some + ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))).encode())
                some = True
                continue
            row[1], row[2], row[4] = owner, depth, n_convs
            if parent is not None:
                row[3] = parent
            row[5] += children
            row[6] += leaves
            row[7] += saved
        yield _node_rows(out)
    yield _node_rows([done()] if row else [])


def _node_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 9
    types = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _names(_NODES))


def trie(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    base: Column | None = None,
    taken: Column | None = None,
) -> DataFrame:
    """One row per node: ``node`` (digest), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (of the parent node), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``
    (of the members without further turns: decimal ids, ascending, joined by commas).

    ``base`` and ``taken`` are columns over ``conv``, a conversation's id: it is a fork that has the first
    ``taken`` turns of ``base`` (all if fewer, none if there is no such conversation) instead of its own
    first ``taken``; at most :data:`LENT`. Without them a conversation has its own turns.
    """
    own = turns.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv is not null")
    words = F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words")
    x1, x2 = F.xxhash64("role", "text").alias("x1"), F.xxhash64("text", F.lit(1), "role").alias("x2")
    # The last column deals repeated rows over tasks, too.
    order = ["conv", "turn", "x1", "x2", "nth"]
    own = own.select("conv", "turn", x1, x2, words, F.monotonically_increasing_id().alias("nth"))
    own = own.repartitionByRange(*order).sortWithinPartitions(*order)
    own = own.select("conv", F.spark_partition_id().cast("long").alias("part"), "x1", "x2", "words")
    segments = stored(
        own.mapInArrow(_packed, "conv long, part long, idx long, n long, total binary, first binary, turns binary"), "segments"
    )

    meta = segments.select("conv", "part", "idx", "n", "total", "first").repartition("conv")
    meta = meta.sortWithinPartitions("conv", "part", "idx")
    meta = meta.mapInArrow(_placed, "conv long, part long, idx long, before long, ahead binary, first binary, last boolean")
    meta = stored(meta, "places")
    taken = F.lit(0) if taken is None else F.least(taken, F.lit(LENT))
    base = F.col("conv") if base is None else base
    # A conversation's first turns are whole in its last row.
    lent = meta.filter("last").select(F.col("conv").alias("base"), F.col("first").alias("lent"))
    places = meta.select("*", base.alias("base"), taken.cast("long").alias("taken")).join(lent, "base", "left")

    columns = "conv part idx before ahead first last taken lent turns".split()
    both = places.withColumn("turns", F.lit(None).cast("binary")).select(columns).unionByName(
        segments.select("conv", "part", "idx", "turns"), allowMissingColumns=True
    )
    both = both.withColumn("kind", F.col("turns").isNotNull())
    both = both.repartition("part").sortWithinPartitions("part", "conv", "idx", "kind")
    local = stored(both.select(columns).mapInArrow(_shards, _LOCAL), "shards")

    lists = local.filter("slot is null").select("node", "shard", "low", "ends")
    local = local.filter("slot is not null").drop("ends")
    nodes = local.groupBy("node").agg(
        F.sum("members").alias("n_convs"), F.sum("n_ends").alias("all_ends"), F.min("low").alias("owner")
    )
    nodes = stored(nodes, "nodes")
    rows = local.join(nodes.hint("merge"), "node").withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
    rows = rows.unionByName(_handed_back(local, nodes), allowMissingColumns=True)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "slot")
    sums = rows.mapInArrow(_accumulated, _SUMS)
    # The lists of a node follow each other by their first id; no conversation ends twice.
    sums = sums.unionByName(lists, allowMissingColumns=True)
    return sums.repartition("node").sortWithinPartitions("node", "low").mapInArrow(_finished, _NODES)


def _handed_back(local: DataFrame, nodes: DataFrame) -> DataFrame:
    """For shards whose last conversation goes on: what the later shards of that conversation accumulate."""
    mine = local.filter("alone is not null and low = alone").select("node", "shard", "low", "words")
    mine = mine.join(nodes.hint("merge"), "node").filter("owner = low")
    saved = F.sum(F.expr("(n_convs - 1) * words")).alias("saved")
    leaves = F.sum((F.col("all_ends") == F.col("n_convs")).cast("long")).alias("leaves")
    sums = mine.groupBy("shard").agg(saved, leaves)
    later = Window.partitionBy("tail").orderBy("shard").rowsBetween(1, Window.unboundedFollowing)
    tails = local.filter("tail is not null").select("shard", "tail").join(sums, "shard", "left")
    tails = tails.select("shard", F.sum("saved").over(later).alias("saved"), F.sum("leaves").over(later).alias("leaves"))
    return tails.filter("saved is not null").withColumn("slot", F.lit(-1).cast("long"))
