"""Personal data by weak supervision, in column expressions only.

Candidates are spans that look like an e-mail address, an IP address, a card number or a
phone number, by wide patterns. Three labelers vote yes, no or nothing on each: *form*
(the strict rule, with checksum and ranges), *gazetteer* (known top-level domains, address
ranges, issuers and country codes), *context* (cue words just ahead). Expectation-maximisation
over the counts of vote patterns (27 per kind at most) estimates how reliable each labeler is and
how likely each pattern means personal data. These probabilities, summed over all candidates
per feature, train a linear span classifier, which decides about the candidates
that the strict rule does not name. Spans that it names always stay.

Offsets count code points; ends are exclusive. Matches are the leftmost ones that do not overlap.
The gaps between matches and the matches themselves are measured to find the offsets; what stands
around a match is read from its block of the text, so the time grows with n^1.5 at most, in
practice with n: a megabyte of addresses takes seconds.

* NULL is an empty text; without candidates all counts are 0 and the lists are empty.
* Repeated rows each get their result; an empty table gives an empty result (the model then
  knows its prior only).
* Columns other than id and text are not read by :func:`find`; :func:`redact` passes them
  through. Its own columns go in one struct, so no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.work import stored

KINDS = ("email", "ip", "card", "phone")

# The strict rules. Possessive quantifiers keep them linear; nothing they
# give up could have matched. A search starts where a run starts, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_RANGE = rf"^{_PART}(?:\.{_PART}){{3}}$"

# Wider forms, word lists of the labelers.
HIDDEN_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
DOMAINS = r"(?i)[.) ](?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|us|ca|au|jp)$"
ADDRESSES = r"^(?!0|10\.|127\.)(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = (
    r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    r"(?i)\b(?:ip|host|server|address|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|pay)\b",
    r"(?i)\b(?:call|tel|phone|telephone|fax|mobile|cell)\b",
)
FALSE_CUES = r"(?i)\b(?:order|invoice|version|isbn|serial|ticket|item|ref|reference|build)\b"
LABELERS = ("form", "gazetteer", "context")

#: Code points ahead of a span in which cue words count.
CONTEXT = 40
#: Probability that the classifier has to give a span that the strict rule does not name.
SURE = 0.9
#: Code points of the blocks that a text is cut into, so that a few of them are found without walking all of it.
BLOCK = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The array of ``op`` over the first one, two, ... integers from 0 on, in runs of the square root of their number."""
    none = F.array().cast("array<int>")

    def scan(part: Column, begin: Column, ahead: bool) -> Column:
        def step(state: Column, v: Column) -> Column:
            now = op(state["at"], v)
            return F.struct(now.alias("at"), F.concat(state["seen"], F.array(state["at"] if ahead else now)).alias("seen"))

        return F.aggregate(part, F.struct(begin.alias("at"), none.alias("seen")), step, lambda state: state["seen"])

    def run_lengths(all_values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        places = F.sequence(F.lit(0), F.ceil(F.size(all_values) / size).cast("int") - 1)
        return _let(F.transform(places, lambda i: F.slice(all_values, i * size + 1, size)), in_runs)

    def in_runs(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), op))
        return F.flatten(F.zip_with(runs, scan(totals, F.lit(0), True), lambda r, begin: scan(r, begin, False)))

    return _let(values, lambda v: F.when(F.size(v) > 0, run_lengths(v)).otherwise(none))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, end, value>>``; the time is linear in the text."""
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda s: s["value"].isNotNull())

    def measured(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda s: s["gap"] + F.length(s["value"])), lambda a, b: a + b)
        return F.zip_with(
            steps,
            ends,
            lambda s, end: F.struct((end - F.length(s["value"])).alias("start"), end.alias("end"), s["value"].alias("value")),
        )

    return _let(zipped, measured)


def cut_up(text: Column) -> Column:
    """The text in blocks of :data:`BLOCK` code points; the last may be shorter."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.octet_length(text) <= BLOCK, F.array(text)).otherwise(blocks)


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` on and ahead of ``end``, reading only the blocks they lie in."""
    low = F.floor(start / BLOCK).cast("int")
    count = F.floor((end - 1) / BLOCK).cast("int") - low + 1
    # A slice visits the whole array, so short stretches take their blocks one by one.
    near = F.concat(F.get(blocks, low), F.when(count > 1, F.get(blocks, low + 1)).otherwise(""))
    part = F.when(count <= 2, near).otherwise(F.array_join(F.slice(blocks, low + 1, F.greatest(count, F.lit(0))), ""))
    return F.when(end > start, F.substr(part, start - low * BLOCK + 1, end - start)).otherwise("")


def luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        def one(i: Column) -> Column:
            digit = F.substr(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return F.when(digit > 9, digit - 9).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda n, i: n + one(i))

    return _let(digits, total) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(blocks: Column, size: Column, kind: int, base: Callable, gazetteer: Callable, failing: int) -> Callable[[Column], Column]:
    """What the labelers and the classifier look at, for a match of one kind."""

    def of(m: Column) -> Column:
        ahead = between(blocks, F.greatest(m["start"] - CONTEXT, F.lit(0)), m["start"])
        cue, false_cue = ahead.rlike(CUES[kind]), ahead.rlike(FALSE_CUES)
        before = F.right(ahead, F.lit(1))
        after = between(blocks, m["end"], F.least(m["end"] + 1, size))
        strict = base(m["value"])
        return F.struct(
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            strict.alias("base"),
            F.when(strict, 1).otherwise(failing).alias("form"),
            gazetteer(m["value"]).alias("gazetteer"),
            _vote(cue & ~false_cue, false_cue & ~cue).alias("context"),
            F.when(before == "", "edge").when(before.rlike(r"\s"), "space").when(before.rlike(r"[\w]"), "word").otherwise("mark").alias("before"),
            F.when(after == "", "edge").when(after.rlike(r"\s"), "space").when(after.rlike(r"[\w]"), "word").otherwise("mark").alias("after"),
            F.least(F.length(m["value"]) / 4, F.lit(8)).cast("int").alias("size"),
        )

    return of


def candidates(text: Column) -> Column:
    """All candidates of a text, strict ones and others, in the order of kinds and starts."""
    return _let(F.struct(cut_up(text).alias("blocks"), F.length(text).alias("size")), lambda t: _candidates(text, t["blocks"], t["size"]))


def _candidates(text: Column, blocks: Column, size: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    never = lambda v: F.lit(False)

    def found(there: Column, pattern: str, *rest) -> Column:
        return F.transform(F.when(there, matches(text, pattern)).otherwise(none), _candidate(blocks, size, *rest))

    def is_card(v: Column) -> Column:
        digits = F.regexp_replace(v, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)

    def digits(v: Column) -> Column:
        return F.length(F.regexp_replace(v, "[^0-9]", ""))

    domain = lambda v: _vote(v.rlike(DOMAINS), ~v.rlike(DOMAINS))
    country = lambda v: _vote(v.rlike(COUNTRIES), v.startswith("+") & ~v.rlike(COUNTRIES))
    parts = [
        found(text.contains("@"), EMAIL, 0, lambda v: F.lit(True), domain, 0),
        found(text.rlike(r"\[at\]|\(at\)"), HIDDEN_EMAIL, 0, never, domain, 0),
        found(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), IP, 1, lambda v: v.rlike(IP_RANGE), lambda v: _vote(v.rlike(ADDRESSES), ~v.rlike(ADDRESSES)), -1),
        F.filter(
            found(text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), CARD, 2, is_card, lambda v: _vote(v.rlike(ISSUERS), ~v.rlike(ISSUERS)), -1),
            lambda c: c["base"] | ((c["end"] - c["start"]).between(13, 38)),
        ),
        found(text.contains("+"), PHONE, 3, lambda v: digits(v).between(8, 15), country, -1),
        found(text.rlike(r"[0-9][) .-][0-9 ]{0,4}"), LOCAL_PHONE, 3, never, country, 0),
    ]

    def apart(every: Column) -> Column:
        """Strict spans, and others that touch none of them: of the strict spans that start ahead of
        another's end, the furthest end lies no further than the other's start."""
        # Spans by where they start, others by where they end and ahead of strict ones there.
        placed = F.transform(
            every, lambda c: F.struct(F.when(c["base"], c["start"]).otherwise(c["end"]).alias("at"), c["base"].alias("strict"), c.alias("c"))
        )

        def free(sorted_: Column) -> Column:
            reach = running(F.transform(sorted_, lambda s: F.when(s["strict"], s["c"]["end"]).otherwise(0)), _larger)
            pairs = F.zip_with(sorted_, reach, lambda s, r: F.struct(s["c"].alias("c"), (s["strict"] | (r <= s["c"]["start"])).alias("stays")))
            return F.array_sort(F.transform(F.filter(pairs, lambda p: p["stays"]), lambda p: p["c"]))

        whole = F.exists(every, lambda c: c["base"]) & F.exists(every, lambda c: ~c["base"])
        return F.when(whole, _let(F.array_sort(placed), free)).otherwise(F.array_sort(every))

    return _let(F.concat(*parts), apart)


@dataclass
class Model:
    """Reliability of the labelers, probability of each vote pattern, weights of the span classifier."""

    reliability: dict[str, float]
    prior: list[float]
    posterior: dict[str, float]
    weights: dict[str, float]

    def sure(self, c: Column, threshold: float = SURE) -> Column:
        """Whether the classifier takes a candidate for personal data."""
        known = F.create_map(*[F.lit(x) for item in sorted(self.weights.items()) for x in item]).cast("map<string,double>")
        total = sum((F.coalesce(F.element_at(known, f), F.lit(0.0)) for f in _features(c)), F.lit(0.0))
        return c["base"] | (total >= math.log(threshold / (1 - threshold)))


def _pattern(c: Column) -> Column:
    return F.concat_ws("|", c["kind"], *[c[name] for name in LABELERS])


def _features(c: Column) -> list[Column]:
    names = [*LABELERS, "before", "after", "size"]
    return [F.concat(c["kind"], F.lit(":prior")), *[F.concat(c["kind"], F.lit(f":{n}="), c[n].cast("string")) for n in names]]


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[list[float], list[float], dict]:
    """Priors of the kinds, reliabilities and pattern probabilities from ``(kind, votes...) -> count``.

    A labeler that votes is right with one probability, whatever the kind, kept between 0.55 and
    0.99 so that its vote keeps its direction.
    """
    prior, right = [0.5] * len(KINDS), [0.9, 0.65, 0.7]
    probability: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for key in counts:
            odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
            odds += sum(v * math.log(r / (1 - r)) for v, r in zip(key[1:], right))
            probability[key] = 1 / (1 + math.exp(-odds))
        for kind in range(len(KINDS)):
            own = [(p, counts[key]) for key, p in probability.items() if key[0] == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for i in range(len(right)):
            voted = [(p if key[1 + i] > 0 else 1 - p, counts[key]) for key, p in probability.items() if key[1 + i]]
            share = (sum(p * n for p, n in voted) + 8) / (sum(n for _, n in voted) + 10)
            right[i] = min(0.99, max(0.55, share))
    return prior, right, probability


def fit(spans: DataFrame) -> Model:
    """The model from rows with a ``candidates`` column; what comes to the driver is bounded by the labelers and features."""
    each = spans.select(F.explode("candidates").alias("c"))
    votes = each.groupBy("c.kind", *[f"c.{name}" for name in LABELERS]).count().collect()
    prior, right, probability = expectation_maximisation({tuple(row)[:-1]: row["count"] for row in votes})
    posterior = {"|".join(map(str, key)): p for key, p in probability.items()}
    if not posterior:
        return Model(dict(zip(LABELERS, right)), prior, {}, {"0:prior": 0.0})
    known = F.create_map(*[F.lit(x) for item in sorted(posterior.items()) for x in item])
    c = F.col("c")
    rows = each.select(
        F.round(F.element_at(known, _pattern(c)) * 10_000).cast("long").alias("yes"), F.explode(F.array(*_features(c))).alias("feature")
    )
    sums = rows.groupBy("feature").agg(F.sum("yes").alias("yes"), F.count("*").alias("n")).collect()
    total = {row["feature"]: (row["yes"] / 10_000, row["n"] - row["yes"] / 10_000) for row in sums}
    weights = {}
    for feature, (yes, no) in total.items():
        if feature.endswith(":prior"):
            weights[feature] = math.log((yes + 1) / (no + 1))
        else:
            all_yes, all_no = total[feature.split(":")[0] + ":prior"]
            weights[feature] = math.log((yes + 1) / (all_yes + 8)) - math.log((no + 1) / (all_no + 8))
    return Model(dict(zip(LABELERS, right)), prior, posterior, weights)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ","
    )


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the strict spans, and all ``spans``, for every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = stored(own.select("doc_id", candidates(F.col("text")).alias("candidates")), "candidates")
    model = fit(spans)
    split = spans.select(
        "doc_id",
        F.filter("candidates", lambda c: c["base"]).alias("base"),
        F.filter("candidates", lambda c: model.sure(c)).alias("all"),
    )
    kinds = F.transform("base", lambda c: c["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return split.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a mark such as ``[EMAIL]`` in place of each span; a text without any stays as it is."""
    own = F.coalesce(F.col(text), F.lit(""))
    model = fit(stored(docs.select(candidates(own).alias("candidates")), "candidates"))
    held = docs.select(F.struct(*docs.columns).alias("held"))
    body = F.coalesce(F.col("held")[text], F.lit(""))
    spans = F.filter(candidates(body), lambda c: model.sure(c))
    found = held.select("held", spans.alias("spans"))
    new = F.when(F.size("spans") > 0, _marked(F.coalesce(F.col("held")[text], F.lit("")), F.col("spans"))).otherwise(F.col("held")[text])
    return found.select(*[(new if c == text else F.col("held")[c]).alias(c) for c in docs.columns])


def _marked(text: Column, spans: Column) -> Column:
    """The text with marks in place of the spans that no earlier one overlaps; linear in the text."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    placed = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"], c["end"], c["kind"])))

    def joined(t: Column) -> Column:
        sorted_, blocks = t["spans"], t["blocks"]
        reach = running(F.transform(sorted_, lambda s: s["end"]), _larger)
        begins = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))

        def part(s: Column, begin: Column) -> Column:
            whole = s["start"] >= begin
            return F.when(whole, F.concat(between(blocks, begin, s["start"]), F.element_at(marks, s["kind"] + 1))).otherwise("")

        rest = between(blocks, F.element_at(reach, -1), F.length(text))
        return F.concat(F.array_join(F.zip_with(sorted_, begins, part), ""), rest)

    return _let(F.struct(placed.alias("spans"), cut_up(text).alias("blocks")), joined)
