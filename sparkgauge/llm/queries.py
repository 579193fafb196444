"""Queries of the operators, with production parameters on whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkgauge.llm import dac_tokens, decontamination, duckdb_bpe, feistel_sharding, fuzzy_lines, language_id, license_scan, ngram_join, nra_topk, prefix_trie, sanitise, suffix_dedup, token_alignment
from sparkgauge.plans.registry import ORACLES, query, table


@query("op1_suffix_bucket_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False)


@query("op2_feistel_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel_sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_cgk_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items"))


@query("op4_mixture_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op5_dac_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return dac_tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op6_disclosure_sanitisation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.sanitise(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in sanitise.KINDS],
        F.sha2(sanitise.listed(sanitise.KINDS), 256).alias("base_sha256"), sanitise.listed([*sanitise.KINDS, "term", "gone"]).alias("spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


@query("op7_fuzzy_lines")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=None, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op8_duckdb_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return duckdb_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op10_nra_topk", """
with v as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::bigint as score from v q, v
  where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_topk.topk(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


@query("op11_license_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), spans=False)


@query("op12_prefix_trie", """
with told as (
  select conv_id as c, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as said, length(coalesce(text, ''))::bigint as size,
    row_number() over (partition by conv_id order by turn nulls first) as k
  from conversations where conv_id is not null
), ids as (
  select c, c - c % 100 as kin, xor(4294967295, list_reduce(
    flatten(list_transform(range(1, length(c::varchar) + 1), lambda i: [ascii(substr(c::varchar, i::int, 1))::bigint, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295)) % 6 as h
  from (select distinct c from told)
), path as (
  select i.c, t.k, t.said, t.size from ids i join told t on t.c = i.kin and t.k <= i.h
  union all
  select i.c, t.k - i.h + (select count(*) from told b where b.c = i.kin and b.k <= i.h), t.said, t.size from ids i join told t on t.c = i.c and t.k > i.h
), prefixes as (
  select c, 0::bigint as d, '' as key, 0::bigint as size from ids
  union all
  select c, k, string_agg(said, ',') over (partition by c order by k), size from path
), nodes as (
  select d, key, min(c) as least, count(*) as n, any_value(size) as size from prefixes group by d, key
), final as (select c, max(d) as d from prefixes group by c),
ends as (
  select p.d, p.key, string_agg(p.c::varchar, ',' order by p.c) as ids from prefixes p join final f on f.c = p.c and f.d = p.d group by p.d, p.key
), kin as (
  select n.d, n.key, count(m.key) as children, min(u.least) as parent
  from nodes n left join nodes m on m.d = n.d + 1 and (n.d = 0 or starts_with(m.key, n.key || ',') )
  left join nodes u on u.d = n.d - 1 and (u.d = 0 or starts_with(n.key, u.key || ','))
  group by n.d, n.key
), below as (
  select a.d, a.key, sum((n.n - 1) * n.size) as saved, count(*) filter (k.children = 0) as leaves
  from nodes n join kin k on k.d = n.d and k.key = n.key join prefixes a on a.c = n.least and a.d <= n.d group by a.d, a.key
)
select n.least as conv_id, n.d as depth, k.parent as parent_conv_id, n.n as n_convs, k.children as n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join kin k on k.d = n.d and k.key = n.key join below b on b.d = n.d and b.key = n.key left join ends e on e.d = n.d and e.key = n.key
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
