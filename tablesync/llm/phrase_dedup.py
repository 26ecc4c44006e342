"""Removes passages that occurred earlier: recurring windows of words, located by Aho-Corasick automata.

A window is :data:`WINDOW` consecutive words of one document. A word goes if some
window covers it whose word sequence also starts earlier: in a document with a
smaller id, or in the same one further ahead.

1. Seeds: in each window the smallest hash of its runs of :data:`SEED` words is a seed.
   Equal windows have equal seeds, so a window can only recur if its seed does. Seeds
   are counted with map-side combining; one in seven words starts one.
2. Triage: each document meets those of its seeds that recur. Its windows with such
   seeds are cut out as short pieces of text; all other documents are finished.
3. Automata: pieces are dealt by seed, seeds with many occurrences over several tasks.
   A task confirms the windows that recur, compiles automata of them, a bounded number of
   pieces each, and streams its pieces through them; every match that
   is not the first is removed. A window has one seed, so all its occurrences meet. For
   a seed over several tasks, the first occurrences that the tasks report are compared once more.
4. The spans of each document meet its text.

* NULL and blank texts have no words and come back unchanged, with the digest of nothing.
* Ids are whole numbers. A NULL id counts as smaller than all others. Rows with equal ids are
  ordered by a hash of their text; rows equal in both are one document and get the same result.
* An empty table gives an empty result. Other columns pass through :func:`cut` unread; none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.textblocks import Block, blocks, grams, parts
from tablesync.llm.work import stored

ships(__name__)

WINDOW = 20
SEED = 8
#: Windows of a piece at most.
PIECE = 32
#: Occurrences of a seed that one task takes; more are dealt over several.
SHARE = 1000
#: Documents that are Python objects at one time.
ROWS = 500
#: Pieces that one automaton is compiled from; bounds its memory.
AUTOMATON_PIECES = 8_000

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWEST = -(1 << 63)


def _shifted(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(x), fill, x.dtype)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def window_seeds(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word's run of SEED words, smallest such hash in the window from each word on,
    and which words have a window."""
    runs = np.where(block.full(SEED), block.grams(SEED), _LAST)
    least, width, span = runs, 1, WINDOW - SEED + 1
    while width * 2 <= span:
        least = np.minimum(least, _shifted(least, width, _LAST))
        width *= 2
    least = np.minimum(least, _shifted(least, span - width, _LAST))
    return runs, least, block.full(WINDOW)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word at which some window has its seed."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            runs, least, whole = window_seeds(block)
            chosen = np.zeros(len(runs), bool)
            for back in range(WINDOW - SEED + 1):
                end = len(runs) - back
                chosen[back:] |= whole[:end] & (least[:end] == runs[back:])
            at = np.flatnonzero(chosen)
            places = batch.column(0).to_numpy()[block.rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[at].view(np.int64)), pa.array(places[block.doc_of_word[at]])], ["seed", "place"]
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in parts(batches, ROWS):
        texts = [pack.compress((text or "").encode()) for text in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(texts, pa.binary())], ["doc_id", "key", "hash", "ztext"]
        )


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _triage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finishes the documents without recurring seeds; the others keep text and seeds."""
    unpack = zstandard.ZstdDecompressor()
    for batch in parts(batches, ROWS):
        seeds = batch.column("seeds").to_pylist()
        n_words, sha, ztext = [], [], []
        for packed, found in zip(batch.column("ztext").to_pylist(), seeds):
            words = _WORD.findall(unpack.decompress(packed))
            n_words.append(len(words))
            sha.append(None if found else _digest(words))
            ztext.append(packed if found else None)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in ("doc_id", "key", "hash")),
                pa.array(n_words, pa.int64()),
                pa.array(sha, pa.string()),
                pa.array(ztext, pa.binary()),
                batch.column("seeds"),
            ],
            ["doc_id", "key", "hash", "n_words", "sha", "ztext", "seeds"],
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents around windows with recurring seeds: words joined by one space."""
    unpack = zstandard.ZstdDecompressor()
    for batch in parts(batches, ROWS):
        texts = [unpack.decompress(z) for z in batch.column("ztext").to_pylist()]
        keys, hashes = batch.column("key").to_pylist(), batch.column("hash").to_pylist()
        recurring = batch.column("seeds").to_pylist()
        at = 0
        for block in blocks(pa.array([t.decode() for t in texts], pa.large_string())):
            _, least, whole = window_seeds(block)
            out: dict[str, list] = {"seed": [], "n": [], "key": [], "hash": [], "start": [], "text": []}
            for doc in range(block.n):
                first, last = block.first[doc], block.first[doc + 1]
                known = np.array([s["seed"] for s in recurring[at]], np.int64)
                times = np.array([s["n"] for s in recurring[at]], np.int64)
                order = np.argsort(known)
                known, times = known[order], times[order]
                seed = least[first:last][whole[first:last]].view(np.int64)
                place = np.minimum(np.searchsorted(known, seed), len(known) - 1)
                hit = known[place] == seed
                change = np.ones(len(seed), bool)
                change[1:] = seed[1:] != seed[:-1]
                starts = np.flatnonzero(change)
                words = _WORD.findall(texts[at])
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(seed)]):
                    if hit[a]:
                        for x in range(a, b, PIECE):
                            out["seed"].append(int(seed[a]))
                            out["n"].append(int(times[place[a]]))
                            out["key"].append(keys[at])
                            out["hash"].append(hashes[at])
                            out["start"].append(x)
                            out["text"].append(b" ".join(words[x : min(x + PIECE, b) + WINDOW - 1]))
                at += 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(out[c], pa.int64()) for c in ("seed", "n", "key", "hash", "start")), pa.array(out["text"], pa.binary())],
                list(out),
            )


def _by_seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in tables of whole seeds, about AUTOMATON_PIECES rows each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        seed = batch.column(0).to_numpy()
        if held and rows >= AUTOMATON_PIECES:
            own = int(np.searchsorted(seed != held[-1].column(0)[-1].as_py(), True))
            if own < len(seed):
                yield pa.Table.from_batches([*held, batch.slice(0, own)])
                held, rows, batch, seed = [], 0, batch.slice(own), seed[own:]
        while len(seed) > AUTOMATON_PIECES:
            cut = int(np.searchsorted(seed, seed[AUTOMATON_PIECES], "left"))
            if not cut:
                break
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch, seed = [], 0, batch.slice(cut), seed[cut:]
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def locate(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece and offset of every window of the pieces, the window that holds its first
    occurrence here, and its words as one character each."""
    texts = table.column("text").to_pylist()
    vocabulary: dict[bytes, int] = {}
    ids: list[int] = []
    lengths = []
    for text in texts:
        words = text.split(b" ")
        lengths.append(len(words))
        ids += [vocabulary.setdefault(word, len(vocabulary)) for word in words]
    word = np.array(ids, np.uint32)
    # One character per word, so that an automaton over strings is one over words.
    letters = word + 1
    letters[letters >= 0xD800] += 0x800
    string = letters.astype("<u4").tobytes().decode("utf-32-le")
    lengths = np.array(lengths)
    begin = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(texts)), lengths - WINDOW + 1)
    n = np.cumsum(lengths - WINDOW + 1) - (lengths - WINDOW + 1)
    offset = np.arange(len(piece)) - n[piece]
    code = grams(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), WINDOW)[begin[piece] + offset]

    key, text_hash, start = (table.column(c).to_numpy() for c in ("key", "hash", "start"))
    order = np.lexsort((start[piece] + offset, text_hash[piece], key[piece], code))
    same = code[order][1:] == code[order][:-1]
    head = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[head, len(order)])
    first = np.arange(len(piece))
    automaton = ahocorasick.Automaton()
    for index in order[head[size > 1]].tolist():
        at = begin[piece[index]] + offset[index]
        automaton.add_word(string[at : at + WINDOW], index)
    if len(automaton):
        automaton.make_automaton()
        busy = np.zeros(len(texts), bool)
        busy[piece[np.isin(code, code[order[head[size > 1]]])]] = True
        for p in np.flatnonzero(busy).tolist():
            base = n[p] - WINDOW + 1
            for end, index in automaton.iter(string[begin[p] : begin[p] + lengths[p]]):
                first[base + end] = index
    return piece, offset, first, code


def _collapsed(table: pa.Table) -> tuple[pa.Table, pa.RecordBatch]:
    """The first of equal pieces, for the automata, and the spans of the others: all their windows came earlier."""
    key, text_hash, start = (table.column(c).to_numpy() for c in ("key", "hash", "start"))
    texts = table.column("text").to_pylist()
    place: dict[bytes, int] = {}
    order = np.lexsort((start, text_hash, key)).tolist()
    head = np.empty(len(texts), np.int64)
    for index in order:
        head[index] = place.setdefault(texts[index], index)
    first = head == np.arange(len(texts))
    late = ~first & ((key != key[head]) | (text_hash != text_hash[head]) | (start != start[head]))
    size = np.array([texts[i].count(b" ") + 1 for i in np.flatnonzero(late).tolist()], np.int64)
    spans = [pa.array(x) for x in (key[late], text_hash[late], start[late], start[late] + size)]
    repeats = pa.RecordBatch.from_arrays([*spans, pa.nulls(len(size), pa.binary())], ["key", "hash", "start", "end", "window"])
    return table.filter(pa.array(first)), repeats


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that are not the first of their kind; of seeds dealt over several tasks
    also every window that is the first here, with a hash of its words."""
    for whole in _by_seed(batches):
        table, repeats = _collapsed(whole)
        yield repeats
        piece, offset, first, _ = locate(table)
        key, text_hash, start, n = (table.column(c).to_numpy() for c in ("key", "hash", "start", "n"))
        own = np.arange(len(piece))
        equal_place = (
            (key[piece[first]] == key[piece]) & (text_hash[piece[first]] == text_hash[piece])
            & (start[piece[first]] + offset[first] == start[piece] + offset)
        )
        again = (first != own) & ~equal_place
        new = again & ~np.r_[False, again[:-1] & (piece[1:] == piece[:-1])]
        last = again & ~np.r_[again[1:] & (piece[1:] == piece[:-1]), False]
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        open_ = np.flatnonzero((first == own) & (n[piece] > SHARE))
        texts = table.column("text").to_pylist()
        words = {p: texts[p].split(b" ") for p in np.unique(piece[open_]).tolist()}
        digest = [
            hashlib.blake2b(b" ".join(words[p][o : o + WINDOW]), digest_size=16).digest()
            for p, o in zip(piece[open_].tolist(), offset[open_].tolist())
        ]
        rows = np.r_[a, open_]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[piece[rows]]),
                pa.array(text_hash[piece[rows]]),
                pa.array(start[piece[rows]] + offset[rows]),
                pa.array(np.r_[start[piece[b]] + offset[b], start[piece[open_]] + offset[open_]] + WINDOW),
                pa.array([None] * len(a) + digest, pa.binary()),
            ],
            ["key", "hash", "start", "end", "window"],
        )


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LOWEST))


def _triaged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), _key(F.col(doc_id)).alias("key"), F.col(text).alias("text"))
    # One list per id and text: rows with a NULL or a repeated id do not share one. Should two
    # places have one hash, their lists are joined, which is harmless: pieces are cut by a text's own seeds.
    place = F.xxhash64("key", F.xxhash64("text")).alias("place")
    seeds = own.select(place, "text").mapInArrow(_seeds, "seed long, place long")
    recurring = stored(seeds.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"), "seeds")
    lists = seeds.join(recurring, "seed").groupBy("place").agg(F.collect_set(F.struct("seed", "n")).alias("seeds"))
    kind = own.schema["doc_id"].dataType.simpleString()
    packed = own.select("doc_id", "key", F.xxhash64("text").alias("hash"), "text")
    packed = packed.mapInArrow(_packed, f"doc_id {kind}, key long, hash long, ztext binary")
    packed = packed.withColumn("place", F.xxhash64("key", "hash"))
    met = packed.join(stored(lists, "lists"), "place", "left").select("doc_id", "key", "hash", "ztext", "seeds")
    schema = (
        f"doc_id {kind}, key long, hash long, n_words long, sha string, ztext binary,"
        " seeds array<struct<seed: long, n: long>>"
    )
    return stored(met.mapInArrow(_triage, schema), "triaged")


def _spans(triaged: DataFrame) -> DataFrame:
    """``key``, ``hash``, ``spans``: the word ranges to remove from each document that loses any."""
    schema = "seed long, n long, key long, hash long, start long, text binary"
    pieces = triaged.filter("sha is null").select("key", "hash", "ztext", "seeds").mapInArrow(_pieces, schema)
    share = F.pmod(F.xxhash64("key", "hash", "start"), F.ceil(F.col("n") / SHARE)).alias("share")
    dealt = pieces.select("*", share).repartition("seed", "share").drop("share").sortWithinPartitions("seed")
    found = dealt.mapInArrow(_matches, "key long, hash long, start long, end long, window binary")
    found = stored(found, "matches")
    place = F.struct("key", "hash", "start")
    heads = found.filter("window is not null")
    firsts = heads.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = heads.join(stored(firsts, "firsts"), "window").filter(place != F.col("first"))
    gone = found.filter("window is null").unionByName(late.select(found.columns))
    gathered = gone.groupBy("key", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return stored(gathered, "spans")


def _removed(n_words: int, spans: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for span in spans or ():
        edge[span["start"]] += 1
        edge[span["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in parts(batches, ROWS):
        n_words, gone, sha = [], [], []
        for packed, spans in zip(batch.column("ztext").to_pylist(), batch.column("spans").to_pylist()):
            words = _WORD.findall(unpack.decompress(packed))
            removed = _removed(len(words), spans)
            n_words.append(len(words))
            gone.append(int(removed.sum()))
            sha.append(_digest([w for w, r in zip(words, removed) if not r]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the digest of the kept words for every row."""
    triaged = _triaged(docs, doc_id, text)
    spans = _spans(triaged)
    clean = triaged.filter("sha is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    touched = triaged.filter("sha is null").select("doc_id", "key", "hash", "ztext")
    touched = touched.join(spans, ["key", "hash"], "left").select("doc_id", "ztext", "spans")
    kind = triaged.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    return clean.union(touched.mapInArrow(_finish, schema))


def without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans and the space after each."""
    raw = text.encode()
    words = list(_WORD.finditer(raw))
    removed = _removed(len(words), spans)
    out, at = [], 0
    for index, word in enumerate(words):
        if removed[index]:
            if not index or not removed[index - 1]:
                out.append(raw[at : word.start()])
        elif index and removed[index - 1]:
            at = word.start()
    if not (len(words) and removed[-1]):
        out.append(raw[at:])
    return b"".join(out).decode()


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of their texts; rows and columns stay."""
    spans = _spans(_triaged(docs, doc_id, text))
    held = docs.select(
        F.struct(*docs.columns).alias("held"), _key(F.col(doc_id)).alias("key"), F.xxhash64(text).alias("hash")
    )
    met = held.join(spans, ["key", "hash"], "left").select("held.*", F.col("spans").alias("cut spans"))
    position = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, ROWS):
            texts = batch.column(position).to_pylist()
            spans = batch.column(batch.num_columns - 1).to_pylist()
            new = pa.array([without(t, s) if s else t for t, s in zip(texts, spans)], batch.schema.types[position])
            columns = batch.columns[:-1]
            columns[position] = new
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return met.mapInArrow(apply, docs.schema)
