"""Toxicity from a learned lexicon, matched with misspellings, weighed by what stands around it.

1. *Lexicon.* Words, and stems that many words continue, whose documents are labelled toxic far
   more often than others; learned on one half of a bounded sample of labelled rows.
2. *Matching.* The lexicon is a trie; its product with a Levenshtein automaton is made deterministic
   state by state as texts need them, so a word costs one lookup per character until no term
   can be reached. Terms of 4 letters may differ by one edit, of 9 by two, shorter ones by none; stems of 5 letters by one.
   Misspelled stems and terms of 4 letters weigh half a misspelling. Stems do not replace learned words.
3. *Context.* In a window of :data:`WINDOW` words around a hit, quotation marks and reporting words
   speak for quoting, words of address for abuse. Each hit is exact, misspelled or a stem, and open or quoted.
4. *Score.* A logistic model of these features, fitted on the other half of the sample.

Scores read nothing but the text. Labels of held-out rows are not read.

* NULL and empty texts have no hits and get the model's base score.
* Repeated rows each get their result. Rows with a NULL id are not held out and have no label;
  of several labels for one id the highest counts.
* Without labels, or with one class only, no term is learned, and all scores are 0 or the class's share.
* An empty table gives an empty result. Columns other than id and text are not read; none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm import ships
from tablesync.llm.work import stored

ships(__name__)

#: Labelled rows used at most, those with the smallest hashes: bounds the broadcast and what is fitted on the driver.
SAMPLE_ROWS = 30_000
#: Times that a term has to be likelier in toxic documents, and their least share and number that have it.
ODDS = 20.0
MIN_SHARE, MIN_DOCS = 0.003, 5
#: Lengths of stems, and the mostly toxic words that have to continue one.
STEMS = range(4, 9)
STEM_WORDS = 8
#: Share of a stem's toxic counts with which a longer stem takes its place.
SHARPER = 0.9
#: Misspellings that a misspelled stem or term of 4 letters counts as.
WEAK = 0.5
WINDOW = 8
THRESHOLD = 0.3

# Marks and words that speak for quoting, words of address.
QUOTES = "\"“”„«»‹›‘’'`"
REPORTING = frozenset(
    "said says say wrote writes called calls word words term terms quote quoted quotes dit écrit mot mots sagte schrieb wort dijo escribió palabra".split()
)
ADDRESS = frozenset("you your youre yours u ur yourself tu te toi vous votre du dich dir ihr euch usted ustedes tú".split())

_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def stem_edits(stem: str) -> int:
    return 0 if len(stem) < 5 else 1


class FuzzyLexicon:
    """The trie of the terms, intersected with a Levenshtein automaton, made deterministic on demand.

    A state is a set of ``(trie node, edits so far)``; state 0 is dead. What begins with a stem
    stays at :data:`STEM`, or at :data:`NEAR_STEM` if the stem is misspelled.
    """

    STEM, NEAR_STEM = (-1, 0), (-2, 0)

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.short: set[int] = set()
        self.stem_at: dict[int, int] = {}
        self.budget = [0]
        for stem in stems:
            self.stem_at[self._add(stem, stem_edits(stem))] = stem_edits(stem)
        for word in words:
            node = self._add(word, edits_allowed(word))
            self.word_at[node] = edits_allowed(word)
            if len(word) < 5:
                self.short.add(node)
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.next: list[dict[str, int]] = [{}]
        self.kind: list[int] = [0]
        self.start = self._state(self._closure({(0, 0)}))

    def _add(self, term: str, budget: int) -> int:
        node = 0
        self.budget[0] = max(self.budget[0], budget)
        for c in term:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.budget.append(0)
            node = self.child[node][c]
            self.budget[node] = max(self.budget[node], budget)
        return node

    def _closure(self, states: set) -> frozenset:
        """With the letters of a term that the text leaves out, and the stems that are reached."""
        found, todo = set(states), list(states)
        while todo:
            node, edits = todo.pop()
            if node < 0:
                continue
            if edits <= self.stem_at.get(node, -1):
                found.add(self.NEAR_STEM if edits else self.STEM)
            for child in self.child[node].values():
                new = (child, edits + 1)
                if edits < self.budget[child] and new not in found:
                    found.add(new)
                    todo.append(new)
        if self.STEM in found:
            found.discard(self.NEAR_STEM)
        return frozenset(found)

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.next.append({})
            ends = {(node, edits) for node, edits in states if edits <= self.word_at.get(node, -1)}
            # 1: a term, 2: a misspelled one, 3: a stem and more, 4: a misspelled stem or short term.
            self.kind.append(
                1 if any(not edits for _, edits in ends)
                else 3 if self.STEM in states
                else 2 if any(node not in self.short for node, _ in ends)
                else 4 if ends or self.NEAR_STEM in states
                else 0
            )
        return self.ids[states]

    def _step(self, state: int, c: str) -> int:
        new = set()
        for node, edits in self.sets[state]:
            if node < 0:
                new.add((node, edits))
                continue
            hit = self.child[node].get(c)
            if hit is not None:
                new.add((hit, edits))
            if edits < self.budget[node]:
                new.add((node, edits + 1))
            for letter, child in self.child[node].items():
                if letter != c and edits < self.budget[child]:
                    new.add((child, edits + 1))
        found = self.next[state][c] = self._state(self._closure(new))
        return found

    def kind_of(self, word: str) -> int:
        """0: nothing, 1: a term, 2: a misspelled term, 3: a word from a stem, 4: from a misspelled stem, or a misspelled short term."""
        state, step = self.start, self.next
        for c in word:
            follow = step[state].get(c)
            state = follow if follow is not None else self._step(state, c)
            if not state:
                break
        return self.kind[state]

    def match(self, word: str) -> int:
        """0: nothing, 1: a term, 2: misspelled, 3: a word from a stem."""
        kind = self.kind_of(word)
        return 2 if kind == 4 else kind


#: Kinds of hits, the surest last.
_SURENESS = (0, 4, 2, 3, 1)

FEATURES = ["exact", "fuzzy", "stem", "exact quoted", "fuzzy quoted", "stem quoted", "address", "reporting", "exact share", "fuzzy share", "stem share"]


def _lowered(text: str | None) -> str:
    return (text or "").lower()


def features(texts: list[str | None], lexicon: FuzzyLexicon) -> np.ndarray:
    """One row of features per text. Distinct words are matched once per call."""
    split = [_lowered(text).split() for text in texts]
    hits = {}
    for token in set().union(*split):
        kind = max((lexicon.kind_of(w) for w in _WORD.findall(token)), key=_SURENESS.index, default=0)
        if kind:
            hits[token] = kind
    out = np.zeros((len(texts), len(FEATURES)))
    for row, tokens in enumerate(split):
        if hits.keys().isdisjoint(tokens):
            continue
        counts = out[row]
        for at, token in enumerate(tokens):
            kind = hits.get(token)
            if not kind:
                continue
            near = tokens[max(0, at - WINDOW) : at + WINDOW + 1]
            bare = [t.strip(".,;:!?" + QUOTES) for t in near]
            quoted = _quoted(tokens, at)
            counts[(1 if kind == 4 else kind - 1) + 3 * quoted] += WEAK if kind == 4 else 1
            counts[6] += any(w in ADDRESS for w in bare)
            counts[7] += any(w in REPORTING for w in bare)
        counts[8:11] = counts[0:3] * 100 / len(tokens)
        counts[:8] = np.log1p(counts[:8])
        counts[8:] = np.log1p(counts[8:])
    return out


def _quoted(tokens: list[str], at: int) -> int:
    """1 if an opening mark stands ahead of the hit and a closing one behind it, both within the window."""
    opens = any(t[0] in QUOTES for t in tokens[max(0, at - WINDOW) : at + 1])
    closes = any(t.rstrip(".,;:!?")[-1:] in QUOTES and len(t) > 1 for t in tokens[at : at + WINDOW + 1])
    return int(opens and closes)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("labelled"), "labelled").limit(SAMPLE_ROWS)
    # SAMPLE_ROWS pairs at most.
    met = docs.join(F.broadcast(known), docs["doc_id"] == F.col("labelled"))
    # Of a repeated id one row is a sample; the rank is cut down ahead of the shuffle, too.
    one = F.row_number().over(Window.partitionBy("labelled").orderBy(F.xxhash64("text"), "text"))
    met = met.withColumn("nth", one).filter("nth = 1")
    half = (F.xxhash64("labelled", F.lit("half")) % 2 == 0).alias("first_half")
    return stored(met.select("text", "toxic", half), "toxic_sample")


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems, of any length. Each is in MIN_SHARE of the toxic rows of the sample at least, so that no
    more come to the driver than 1 / MIN_SHARE times the different words that a row has on average."""
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    if not toxic or not clean:
        return [], []
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("term")
    words = sample.filter("text is not null").select(word, "toxic").groupBy("term")
    words = words.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).filter("term <> ''")
    words = stored(words, "toxic_words")
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("toxic") + 0.5) / (clean + 1))
    strong = (F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * toxic)) & (odds >= ODDS)

    def chosen(terms: DataFrame) -> list[str]:
        return [r["term"] for r in terms.filter(strong).orderBy(F.desc("toxic"), "term").collect()]

    size = F.explode(F.array(*[F.lit(n) for n in STEMS])).alias("size")
    stems = words.select("term", "toxic", "n", size).filter(F.length("term") > F.col("size"))
    stems = stems.groupBy(F.substring("term", F.lit(1), F.col("size")).alias("term"))
    stems = stems.agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.count_if(F.col("toxic") * 2 > F.col("n")).alias("words"),
        F.max(F.struct("toxic", "n")).alias("strongest"),
    ).filter(F.col("words") >= STEM_WORDS)
    # Toxic without its strongest word too: one toxic word makes no stem of what else begins like it.
    rest = {name: F.col(name) - F.col(f"strongest.{name}") for name in ("toxic", "n")}
    named = stems.withColumns(rest).filter(strong).select("term")
    sums = {r["term"]: r["toxic"] for r in stems.join(named, "term", "left_semi").filter(strong).collect()}
    found: list[str] = []
    for stem in sorted(sums, key=lambda s: (len(s), s)):
        if not any(stem.startswith(s) or s.startswith(stem) for s in found):
            longer = [s for s in sums if s.startswith(stem) and sums[s] >= SHARPER * sums[stem]]
            found.append(max(longer, key=lambda s: (len(s), sums[s], s)))
    return chosen(words), found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic model, the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = _sample(own, labels)
    words, stems = learn_lexicon(sample.filter("first_half"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(words, stems)
        for batch in batches:
            found = features(batch.column(0).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    # SAMPLE_ROWS short rows at most.
    rows = sample.filter("not first_half").select("text", "toxic").mapInArrow(extract, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    weights = logistic(x, np.array([float(r["toxic"]) for r in rows])) if rows else np.r_[np.zeros(len(FEATURES)), -30.0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(words, stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = features(part.column(1).to_pylist(), lexicon)
                p = 1 / (1 + np.exp(-np.clip(found @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p)], ["doc_id", "held_out", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    scored = own.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = scored.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
