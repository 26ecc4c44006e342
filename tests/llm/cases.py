"""Small tables with awkward rows, and plain versions of the operators."""

import itertools
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"passage{n}" for n in range(60))
ODD = [
    (900_001, None),
    (900_002, ""),
    (900_003, " \t\n "),
    (900_004, "one two"),
    (900_005, "one two"),
    (900_005, "one two"),
    (900_006, "a start of its own " + PASSAGE),
    (900_007, PASSAGE + " then another end"),
    (900_008, "the the the " * 400),
    (900_009, "é漢字 <|endoftext|> x\x1cy " + "q" * 9000),
    (900_010, "mail a@b.cd_e@f.gh or +1 (017) 555-7713, 4111 1111 1111 1111, 256.1.1.1 and 007.8.0.1"),
    (None, "no id but " + PASSAGE),
    (None, None),
]


def documents(spark, sf_dir, limit=None):
    """Documents of the test tables, the odd rows, and columns whose names the operators use inside."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if limit is not None:
        docs = docs.filter(F.col("doc_id") < limit)
    docs = docs.union(spark.createDataFrame(ODD, "doc_id long, text string"))
    clashing = "row held seed spans key hash bucket start trusted_id keys node n labelled base".split()
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(clashing)])


def nothing(spark, like):
    return spark.createDataFrame([], like.schema)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def shingles(text, k=5):
    words = WORD.findall(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def linked(rows, threshold=0.8):
    """Pairs of row numbers whose shingle sets are similar enough."""
    sets = [shingles(text) for _, text in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    return {
        (i, j) for i, j in pairs if (k := len(sets[i] & sets[j])) >= threshold * (len(sets[i]) + len(sets[j]) - k) - 1e-9
    }


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def without_repeats(rows):
    """``{doc_id: kept words}`` for rows with different ids; windows of 20 words."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out[doc_id] = [w for w, g in zip(words, gone) if not g]
    return out
