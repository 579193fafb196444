"""Queries for duplicates, groups, leakage-free splits, samples and audits on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgauge.functions.hashing import hash52, hash52_sql
from sparkgauge.operators import grouping as g
from sparkgauge.plans.registry import query, table
from sparkgauge.session import stored

SEED = 42


def catalogue(spark, d):
    """Documents with content hash, group (source and block of 100 ids) and stratum of the group."""
    block = F.call_function("div", F.col("doc_id"), F.lit(100)).cast("string")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("content"), F.concat_ws("-", "source", block).alias("grp"))
    strata = docs.groupBy("grp").agg(F.min("lang").alias("stratum"))
    return docs.join(strata, "grp")


CAT = """docs as (select doc_id, source, lang, n_chars, md5(text) as content, source || '-' || (doc_id // 100) as grp from documents),
cat as (select *, min(lang) over (partition by grp) as stratum from docs)"""


def _split_sql(name, source, key, stratum="stratum"):
    u = hash52_sql(SEED, key)
    return f"""{name}_g as (select {key}, min({stratum}) as stratum from {source} group by 1),
{name}_r as (select *, row_number() over (partition by stratum order by {u}, {key}) as rk, count(*) over (partition by stratum) as n from {name}_g),
{name}_q as (select *, case when n >= 3 then least(greatest(1, round_even(n * 0.15::double, 0)::bigint), n - 2) when n = 2 then 1 else 0 end as nt from {name}_r),
{name}_v as (select *, case when n >= 3 then least(greatest(1, round_even(n * 0.15::double, 0)::bigint), n - 1 - nt) else 0 end as nv from {name}_q),
{name} as (select {key}, stratum, case when rk <= nt then 'test' when rk <= nt + nv then 'val' else 'train' end as part from {name}_v)"""


def partitioned(df, key):
    groups = df.groupBy(key).agg(F.min("stratum").alias("stratum"))
    return g.split_groups(groups, key, "stratum", SEED)


FUSED = """edges as (select distinct a.grp as a, b.grp as b from cat a join cat b on a.content = b.content),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b),
fuse as (select a as grp, min(b) as fused from reach group by 1)"""


@query("g1_exact_clusters", "select md5(text) as content, count(*) as n, min(doc_id) as first_id, count(distinct source)::bigint as sources from documents group by 1 having count(*) > 1")
def g1(spark, d):
    docs = catalogue(spark, d)
    return docs.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).where("n > 1")


@query("g2_identity_collisions", "select p_name, count(*) as n, count(distinct md5(p_brand || '|' || p_type || '|' || p_size))::bigint as contents, count(distinct p_size)::bigint as sizes, case when count(distinct md5(p_brand || '|' || p_type || '|' || p_size)) = 1 then 'identical' when count(distinct p_size) > 1 then 'distinct_size' else 'distinct' end as verdict from part group by 1 having count(*) > 1")
def g2(spark, d):
    content = F.md5(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).cast("binary"))
    per = table(spark, d, "part").withColumn("content", content).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("contents"), F.count_distinct("p_size").alias("sizes"))
    verdict = F.when(F.col("contents") == 1, "identical").when(F.col("sizes") > 1, "distinct_size").otherwise("distinct")
    return per.where("n > 1").withColumn("verdict", verdict)


@query("g3_fused_groups", f"with recursive {CAT}, {FUSED} select grp, fused from fuse")
def g3(spark, d):
    return g.fused_keys(catalogue(spark, d), "grp", "content")


REP = f"with {CAT}, r as (select doc_id, content, n_chars, row_number() over (partition by content order by n_chars desc, doc_id) as rk, count(*) over (partition by content) as cluster_size, first_value(doc_id) over (partition by content order by n_chars desc, doc_id) as kept_id from cat)"


@query("g4_representatives", REP + " select doc_id, cluster_size, kept_id, rk = 1 as keep, case when cluster_size = 1 then 'single' when rk = 1 then 'representative' else 'duplicate' end as reason, case when rk > 1 then kept_id end as dup_of from r")
def g4(spark, d):
    return g.representatives(catalogue(spark, d), "content", [F.col("n_chars")], "doc_id").select("doc_id", "cluster_size", "kept_id", "keep", "reason", "dup_of")


@query("g5_removed_duplicates", REP + " select a.doc_id as removed_id, a.kept_id, a.n_chars as removed_chars, b.n_chars as kept_chars from r a join documents b on b.doc_id = a.kept_id where a.rk > 1")
def g5(spark, d):
    docs = catalogue(spark, d)
    gone = g.representatives(docs, "content", [F.col("n_chars")], "doc_id").where(~F.col("keep"))
    kept = docs.select(F.col("doc_id").alias("kept_id"), F.col("n_chars").alias("kept_chars"))
    return gone.select(F.col("doc_id").alias("removed_id"), "kept_id", F.col("n_chars").alias("removed_chars")).join(kept, "kept_id")


@query("g6_leakage_by_hash", f"with {CAT}, {_split_sql('s', 'cat', 'grp')} select content, count(distinct part)::bigint as parts, min(part) as first_part, max(part) as last_part, count(*) as rows from cat join s using (grp) group by 1 having count(distinct part) > 1")
def g6(spark, d):
    docs = catalogue(spark, d)
    return g.crossing(docs.join(partitioned(docs, "grp").select("grp", "partition"), "grp"), "content", "partition")


def _audit_sql(stage, source):
    one = "select '{s}' as stage, '{k}' as key_name, count({k})::bigint as n_values, count(*) filter ({k} is not null and p > 1)::bigint as overlapping, coalesce(sum(n) filter ({k} is null), 0)::bigint as missing, case when count(*) filter ({k} is not null and p > 1) = 0 and coalesce(sum(n) filter ({k} is null), 0) = 0 then 'ok' else 'leak' end as verdict from (select {k}, count(distinct part) as p, count(*) as n from {src} group by 1)"
    return " union all ".join(one.format(s=stage, k=k, src=source) for k in ("content", "grp"))


@query("split_audit", f"with recursive {CAT}, {FUSED}, catf as (select cat.*, fused from cat join fuse using (grp)), {_split_sql('s', 'cat', 'grp')}, {_split_sql('t', 'catf', 'fused')}, before_ as (select cat.*, part from cat join s using (grp)), after_ as (select catf.*, part from catf join t using (fused)) {_audit_sql('before', 'before_')} union all {_audit_sql('after', 'after_')}")
def split_audit(spark, d):
    """Split by group, audit, fuse the groups that share content, split again, audit again."""
    docs = stored(catalogue(spark, d))
    before = docs.join(partitioned(docs, "grp").select("grp", "partition"), "grp")
    fused = docs.join(g.fused_keys(docs, "grp", "content"), "grp")
    after = fused.join(partitioned(fused, "fused").select("fused", "partition"), "fused")
    return g.audit(before, ["content", "grp"], "partition").select(F.lit("before").alias("stage"), "*").unionByName(g.audit(after, ["content", "grp"], "partition").select(F.lit("after").alias("stage"), "*"))


@query("g8_super_key", """with b as (select distinct source, lang from documents where source in ('src1', 'src2')), shared as (select lang from b group by 1 having count(*) = 2)
select doc_id, case when source in ('src1', 'src2') and lang in (select lang from shared) then 'super-' || lang else source || '-' || lang end as super_key from documents""")
def g8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    pair = docs.where(F.col("source").isin("src1", "src2"))
    both = pair.groupBy("lang").agg(F.count_distinct("source").alias("k")).where("k = 2").select("lang", F.lit(True).alias("both"))
    fused = F.col("source").isin("src1", "src2") & F.coalesce("both", F.lit(False))
    return docs.join(both, "lang", "left").select("doc_id", F.when(fused, F.concat(F.lit("super-"), "lang")).otherwise(F.concat_ws("-", "source", "lang")).alias("super_key"))


@query("g9_resolve_ambiguous", """with m as (select md5(text) as content, count(distinct source) as k, count(distinct case when source in ('src1', 'src2', 'src3') then 'fused' else source end) as f, min(case when source in ('src1', 'src2', 'src3') then 'fused' else source end) as one from documents group by 1)
select content, case when k = 1 then 'ok' when f = 1 then 'resolved_by_fusion' else 'excluded' end as outcome, case when f = 1 then one end as batch from m""")
def g9(spark, d):
    canon = F.when(F.col("source").isin("src1", "src2", "src3"), "fused").otherwise(F.col("source"))
    m = catalogue(spark, d).withColumn("canon", canon).groupBy("content").agg(F.count_distinct("source").alias("k"), F.count_distinct("canon").alias("f"), F.min("canon").alias("one"))
    return m.select("content", F.when(F.col("k") == 1, "ok").when(F.col("f") == 1, "resolved_by_fusion").otherwise("excluded").alias("outcome"), F.when(F.col("f") == 1, F.col("one")).alias("batch"))


def _measure_sql(name, key):
    return f"select '{name}' as key_name, count(*) as groups, min(n) as smallest, quantile_cont(n, 0.5)::double as median, max(n) as largest, round(avg(n), 6) as mean, count(*) filter (n = 1) as singletons, (select count(*) from (select content from docs group by 1 having count(distinct {key}) > 1)) as split_units from (select {key} as k, count(*) as n from docs group by 1)"


@query("g10_measured_keys", f"with {CAT} {_measure_sql('source', 'source')} union all {_measure_sql('grp', 'grp')}")
def g10(spark, d):
    docs = catalogue(spark, d)
    return g.measured_key(docs, "source", ["source"], "content").unionByName(g.measured_key(docs, "grp", ["grp"], "content"))


@query("g11_id_crossing", "select user_id, count(distinct event_type)::bigint as parts, min(event_type) as first_part, max(event_type) as last_part, count(*) as rows from events group by 1 having count(distinct event_type) > 1")
def g11(spark, d):
    return g.crossing(table(spark, d, "events"), "user_id", "event_type")


@query("g12_field_ids", "select doc_id, case when doc_id % 7 = 0 then 'named' else (doc_id - min(doc_id) over (partition by source, doc_id // 100) + 1)::varchar end as field_id from documents")
def g12(spark, d):
    docs = catalogue(spark, d)
    low = docs.groupBy("grp").agg(F.min("doc_id").alias("low"))
    return docs.join(low, "grp").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "named").otherwise((F.col("doc_id") - F.col("low") + 1).cast("string")).alias("field_id"))


@query("g13_stratified_split", f"with {CAT}, {_split_sql('s', 'cat', 'grp')} select grp, stratum, part as partition from s")
def g13(spark, d):
    return partitioned(catalogue(spark, d), "grp").select("grp", "stratum", "partition")


SEEDS = 400
TARGETS = {"test": 0.15, "val": 0.15, "train": 0.7}
KEY = "'=' || grp"


@query("g15_best_split", f"""with {CAT}, sizes as (select {KEY} as k, count(*) as n from docs group by 1), seeds as (select unnest(range(0, {SEEDS}))::bigint as seed),
u as (select seed, k, n, case when u < 0.15 then 'test' when u < 0.3 then 'val' else 'train' end as part from (select seed, k, n, {hash52_sql('(seed)', 'k')} / 4503599627370496.0 as u from sizes, seeds)),
e as (select seed, abs(coalesce(sum(n) filter (part = 'test'), 0) / sum(n)::double - 0.15) + abs(coalesce(sum(n) filter (part = 'val'), 0) / sum(n)::double - 0.15) + abs(coalesce(sum(n) filter (part = 'train'), 0) / sum(n)::double - 0.7) as error from u group by 1),
f as (select distinct {KEY} as k, facet, value from (select grp, 'lang' as facet, lang as value from docs union all select grp, 'source', source from docs union all select grp, 'size', (n_chars // 1000)::varchar from docs)),
m as (select seed, 3 * (select count(*) from (select distinct facet, value from f)) - count(*) as missing from (select distinct seed, part, facet, value from u join f using (k)) group by 1)
select seed, (missing > 0)::int as incomplete, missing, round(error, 6) as error from e join m using (seed) order by missing > 0, round(error, 9), seed limit 1""")
def g15(spark, d):
    """The seed whose parts hold every language, source and size band, or else come closest to their shares."""
    docs = catalogue(spark, d).withColumn("size", F.call_function("div", F.col("n_chars"), F.lit(1000)))
    t = g.seed_search(docs, "grp", ["lang", "source", "size"], SEEDS, TARGETS)
    best = t.agg(F.min(F.struct("incomplete", F.round("error", 9).alias("e"), "seed", "missing", "error")).alias("b"))
    return best.select("b.seed", "b.incomplete", "b.missing", F.round("b.error", 6).alias("error"))


@query("g16_coverage", f"with {CAT}, {_split_sql('s', 'cat', 'grp')}, f as (select lang, part from cat join s using (grp)) select l.lang, p.part as partition, count(f.lang) as n, count(f.lang) = 0 as absent from (select distinct lang from docs) l cross join (select unnest(['train', 'val', 'test']) as part) p left join f on f.lang = l.lang and f.part = p.part group by 1, 2")
def g16(spark, d):
    docs = catalogue(spark, d)
    full = docs.join(partitioned(docs, "grp").select("grp", "partition"), "grp").groupBy("lang", "partition").agg(F.count(F.lit(1)).alias("n"))
    grid = docs.select("lang").distinct().withColumn("partition", F.explode(F.array(*map(F.lit, ("train", "val", "test")))))
    return grid.join(full, ["lang", "partition"], "left").select("lang", "partition", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("absent"))


@query("g17_blind_sample", f"select doc_id from documents order by {hash52_sql(SEED, 'doc_id')}, doc_id limit 25")
def g17(spark, d):
    return table(spark, d, "documents").select("doc_id", hash52(SEED, "doc_id").alias("u")).orderBy("u", "doc_id").limit(25).select("doc_id")


QUOTA = """c as (select lang, count(*) as n from documents group by 1), e as (select *, n * 40 / sum(n) over ()::double as exact from c), q as (select *, least(greatest(1, round_even(exact, 0)::bigint), n) as q from e),
g as (select *, 40 - sum(q) over () as gap from q), o as (select *, row_number() over (order by case when gap > 0 then q - exact else exact - q end, lang) as far from g),
quota as (select lang, (q + case when gap > 0 then least((far <= gap)::int, n - q) else -((far <= -gap and q > 1)::int) end)::bigint as quota from o)"""


@query("g18_quota_sample", f"with {QUOTA}, r as (select doc_id, lang, row_number() over (partition by lang order by {hash52_sql(SEED, 'doc_id')}, doc_id) as draw from documents) select doc_id, lang, draw from r join quota using (lang) where draw <= quota")
def g18(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return g.stratified_sample(docs, "lang", g.quotas(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", 40), SEED, "doc_id")


@query("g19_worklist", "select doc_id, source, row_number() over (partition by source order by doc_id) as ordinal, doc_id = min(doc_id) over (partition by source) as is_baseline from documents join labels using (doc_id) where quality = 0")
def g19(spark, d):
    from sparkgauge.operators.ordering import rank_rows

    todo = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 0"), "doc_id").select("doc_id", "source")
    ranked = rank_rows(todo, ["source"], "doc_id", [], "ordinal")
    return ranked.withColumn("is_baseline", F.col("ordinal") == 1)


@query("g20_completeness", "with w as (select user_id, event_type, list(distinct date_diff('day', timestamp '2024-01-01', ts) // 7) as have from events group by 1, 2) select user_id, event_type, len(list_filter([0, 1, 2, 3, 4], lambda x: not list_contains(have, x)))::bigint as missing, len(list_filter([0, 1, 2, 3, 4], lambda x: not list_contains(have, x))) = 0 as complete from w")
def g20(spark, d):
    week = F.call_function("div", F.datediff(F.to_date("ts"), F.lit("2024-01-01")), F.lit(7))
    have = table(spark, d, "events").groupBy("user_id", "event_type").agg(*[F.max(week == k).alias(f"w{k}") for k in range(5)])
    missing = sum((F.when(F.col(f"w{k}"), 0).otherwise(1) for k in range(1, 5)), F.when(F.col("w0"), 0).otherwise(1))
    return have.select("user_id", "event_type", missing.cast("bigint").alias("missing"), (missing == 0).alias("complete"))


@query("g21_conservation", """with t as (select (select count(*) from documents) as total, (select count(*) from documents where doc_id in (select doc_id from labels)) as labelled, (select count(*) from documents where doc_id is null or doc_id not in (select doc_id from labels where doc_id is not null)) as excluded,
  (select count(*) from labels) as labels, (select count(*) from labels where doc_id is null or doc_id not in (select doc_id from documents where doc_id is not null)) as orphan_labels, (select count(distinct doc_id) from labels) as label_ids)
select *, total = labelled + excluded and orphan_labels = 0 and labels = label_ids as conserved from t""")
def g21(spark, d):
    """Documents in = labelled + excluded, each counted by itself; and no label is without its document or double."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return g.conservation(docs, labels, "doc_id")


@query("g22_diverse_topk", """with b as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rk from documents), f as (select doc_id, source, n_chars from b where rk = 1 order by n_chars desc, doc_id limit 4)
select *, 1 as step from f union all (select doc_id, source, n_chars, 2 as step from documents where doc_id not in (select doc_id from f) order by n_chars desc, doc_id limit 6)""")
def g22(spark, d):
    return g.diverse_topk(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", "source", "doc_id", 4, 10)
