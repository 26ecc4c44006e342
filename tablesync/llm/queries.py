"""The operators over the whole test tables, with their SQL counterparts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import bpe_stream, cover_tree, host_trust, jaccard_forest, packing, periodic_runs, phrase_dedup, pii_votes, prefix_trie, quality_rules, token_counts, toxic_terms, weak_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.score(_table(spark, sf_dir, "documents"))


def op2_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.find(_table(spark, sf_dir, "documents"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


RULES = [
    host_trust.Rule("allow", "com", "/"),
    host_trust.Rule("block", "example.com", "/en/"),
    host_trust.Rule("allow", "www.example.com", "/en/"),
    host_trust.Rule("block", "net", "/es/"),
    host_trust.Rule("block", "net", "/fr/"),
]


def op4_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge(_table(spark, sf_dir, "pages"), RULES)


def op5_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.drop("llr")


def op7_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.join(_table(spark, sf_dir, "documents"))


def op8_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(_table(spark, sf_dir, "documents"))


def op10_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_terms.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """In one of ten documents, by the crc32 of its id, the words from some place on repeat with a period."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", code.alias("code"), F.floor(code / 10).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("code") % 10 == 0, words))
    docs = docs.withColumn("n", F.nullif(F.size("words"), F.lit(0)))
    docs = docs.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    times = F.expr("cast((n - a) div p + 1 as int)")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), F.lit(1), F.col("n")), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_with_planted_runs(_table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Of each twenty conversations the first lends the others up to three turns.
    base, taken = F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"), base=base, taken=taken).drop("node")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_weak_quality": op1_weak_quality,
    "op2_pii_votes": op2_pii_votes,
    "op3_cover_tree": op3_cover_tree,
    "op4_host_trust": op4_host_trust,
    "op5_bpe_stream": op5_bpe_stream,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_forest": op7_jaccard_forest,
    "op8_binary_packing": op8_binary_packing,
    "op9_phrase_dedup": op9_phrase_dedup,
    "op10_toxic_terms": op10_toxic_terms,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}

ORACLE: dict[str, str] = {
    "op3_cover_tree": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_dot_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
""",
    "op12_prefix_trie": r"""
with ids as (
  select distinct conv_id as c,
         list_reduce(
           list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint)),
           lambda crc, byte: list_reduce(range(8), lambda s, i:
             case when s % 2 = 1 then xor(s // 2, 3988292384) else s // 2 end, xor(crc, byte)),
           cast(4294967295 as bigint)) as crc
  from conversations where conv_id is not null),
heads as (select c, c - c % 20 as base, xor(crc, 4294967295) % 4 as h from ids),
own as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null),
turns as (
  select heads.c, 0 as part, pos, role, text from heads join own on own.c = base and pos <= h
  union all
  select heads.c, 1, pos, role, text from heads join own on own.c = heads.c and pos > h),
placed as (
  select c, row_number() over (partition by c order by part, pos) as depth, role, text,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
  from turns),
rows as (
  select c, depth, words,
         list(sha256(role || chr(0) || text)) over (partition by c order by depth) as path
  from placed
  union all
  select c, 0, 0, [] from heads),
keyed as (
  select c, depth, words, sha256(array_to_string(path, ',')) as key,
         sha256(array_to_string(path[:-2], ',')) as parent, max(depth) over (partition by c) as deepest
  from rows),
nodes as (
  select key, depth, min(c) as conv_id, any_value(parent) as parent, count(*) as n_convs, any_value(words) as words,
         sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (depth = deepest), '')) as ends_sha256
  from keyed group by key, depth),
children as (select parent, count(*) as n from nodes where depth > 0 group by parent),
below as (
  select k.key, sum((n.n_convs - 1) * n.words) as saved, count(*) filter (ch.n is null) as leaves
  from nodes n join keyed k on k.c = n.conv_id and k.depth <= n.depth left join children ch on ch.parent = n.key
  group by k.key)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs,
       coalesce(ch.n, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, n.ends_sha256
from nodes n left join nodes p on n.depth > 0 and p.key = n.parent
left join children ch on ch.parent = n.key join below b on b.key = n.key
""",
    "op9_phrase_dedup": r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (
  select doc_id, unnest(range(1, len(w) - 18)) as p,
         unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) as body
  from docs where len(w) >= 20),
windows as (
  select doc_id, p, row_number() over (partition by body order by doc_id, p) as nth from starts),
gone as (
  select distinct doc_id, unnest(range(p, p + 20)) as p from windows where nth > 1),
words as (
  select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from docs),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as body, count(*) as n
  from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(body, '')) as kept_sha256
from docs left join kept using (doc_id)
""",
}
