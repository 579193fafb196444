"""Queries for ranking metrics on ``embeddings`` (score: integer product with a class's vector sum) and resampling on ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgauge.functions.hashing import hash52_sql
from sparkgauge.functions.numbers import rounded
from sparkgauge.operators import ranking as r, resample
from sparkgauge.plans.registry import query, table
from sparkgauge.session import stored

R6 = rounded
B = resample.REPLICATES
GROUP = 8  # neighbouring vectors are one group
THRESHOLDS = [0, 2000, 4000, 8000, 16000]


def scored(spark, d):
    """vec_id, grp, label, config, seed, cls, score: every vector against the sum of every class.

    The first and the second half of the components are two configurations, their odd and even components two runs of each.
    """
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("x"))
    # the components of a run: position and number; a place in the first half may lie in the second one of a shorter vector
    both = F.transform("x", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    runs = [(config, seed) for config in ("first", "second") for seed in (0, 1)]
    half = F.call_function("div", F.size("x"), F.lit(2))

    def part(config, seed):
        inside = (lambda t: t["i"] < half) if config == "first" else (lambda t: t["i"] >= half)
        return F.filter(both, lambda t: inside(t) & ((t["i"] + 1) % 2 == seed))

    own = e.select("vec_id", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(s).alias("seed"), part(c, s).alias("v")) for c, s in runs])).alias("r"))
    own = own.select("vec_id", "label", "r.*").where(F.size("v") > 0)
    by = ["config", "seed", "cls"]
    of_label = own.where("label is not null").select("config", "seed", F.col("label").alias("cls"), F.explode("v").alias("t")).groupBy(*by, "t.i").agg(F.sum("t.x").alias("c"))
    # sums by position, 0 between
    sums = of_label.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"), F.max("i").alias("last"))
    sums = sums.select(*by, F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("c"))
    score = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, t: s + t["x"] * F.coalesce(F.get("c", t["i"]), F.lit(0)))
    return own.join(F.broadcast(sums), ["config", "seed"]).select("vec_id", F.call_function("div", F.col("vec_id"), F.lit(GROUP)).alias("grp"), "label", *by, score.alias("score"))  # a row a run and class


def detections(spark, d):
    """config, cls, score, tp: every vector half against every class, stored once for all that is read from it."""
    half = scored(spark, d).groupBy("vec_id", "label", "config", "cls").agg(F.sum("score").alias("score"))
    return stored(half.select("config", "cls", "score", F.when(F.col("label") == F.col("cls"), 1).otherwise(0).alias("tp")))


def best_class(spark, d):
    """vec_id, grp, config, seed, score, tp: the class of the highest score of each vector and run, the smaller of equals."""
    best = scored(spark, d).groupBy("vec_id", "grp", "label", "config", "seed").agg(F.max(F.struct("score", (-F.col("cls")).alias("o"))).alias("b"))
    return stored(best.select("vec_id", "grp", "config", "seed", F.col("b.score").alias("score"), F.when(F.col("label") == -F.col("b.o"), 1).otherwise(0).alias("tp")))


def truths(dets):
    return dets.groupBy("config", "cls").agg(F.sum("tp").alias("n_gt"))


SCORED = f"""e as (select vec_id, vec_id // {GROUP} as grp, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e from embeddings),
u as (select vec_id, grp, label, case when i <= len(e) // 2 then 'first' else 'second' end as config, i % 2 as seed, i, x from (select *, unnest(e) as x, unnest(range(1, len(e) + 1)) as i from e)),
sm as (select config, seed, label as cls, i, sum(x)::bigint as c from u where label is not null group by all),
sc as (select vec_id, grp, max(label) as label, u.config, u.seed, cls, sum(x * c)::bigint as score from u join sm on sm.config = u.config and sm.i = u.i group by vec_id, grp, u.config, u.seed, cls)"""
DET = SCORED + """, det as (select vec_id, config, cls, sum(score)::bigint as score, (max(label) = cls)::int as tp from sc group by vec_id, config, cls),
gt as (select config, cls, sum(tp)::bigint as n_gt from det group by 1, 2)"""
AP = DET + """, ds as (select config, cls, score, sum(tp) as t, count(*) as n from det group by 1, 2, 3),
cu as (select config, cls, sum(t) over w as ctp, sum(n) over w as cn from ds window w as (partition by config, cls order by score desc)),
pk as (select config, cls, (ctp * 100) // n_gt as k, max(ctp / cn::double) as p from cu join gt using (config, cls) group by 1, 2, 3),
ap as (select config, cls, avg(coalesce((select max(p) from pk where pk.config = g.config and pk.cls = g.cls and pk.k >= r.r), 0)) as ap from gt g, (select unnest(range(0, 101)) as r) r group by 1, 2)"""


@query("r1_greedy_match")
def r1(spark, d):
    """Order as item: shipped lines detect, open lines are truths, boxes of width 10 on the quantity.  Sequential within an item: tested by brute force."""
    shipped = F.col("l_linestatus") == "F"
    det = F.struct(F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("q"))
    it = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_list(F.when(shipped, det)).alias("dets"), F.sort_array(F.collect_list(F.when(~shipped, F.col("l_quantity")))).alias("truths"))
    gap = lambda a, t: F.abs(a["q"] - t)
    iou = lambda a, t: F.greatest(F.lit(0.0), 10 - gap(a, t)) / (10 + gap(a, t))
    m = r.greedy_match(it, "dets", "truths", iou)
    return m.select("item", "threshold", F.size("tp").cast("bigint").alias("n_det"), F.aggregate("tp", F.lit(0), lambda s, x: s + x).cast("bigint").alias("tp"), "n_gt")


@query("r2_average_precision", f"with {AP} select config, cls, n_gt, round(ap, 6) as ap from ap join gt using (config, cls)")
def r2(spark, d):
    dets = detections(spark, d)
    return r.average_precision(dets, truths(dets), ["config", "cls"]).select("config", "cls", "n_gt", R6("ap").alias("ap"))


@query("r3_map_summary", f"with {AP} select config, count(ap) as classes, round(avg(ap), 6) as map from ap group by 1")
def r3(spark, d):
    dets = detections(spark, d)
    return r.average_precision(dets, truths(dets), ["config", "cls"]).groupBy("config").agg(F.count("ap").alias("classes"), R6(F.avg("ap")).alias("map"))


@query("r4_precision_recall", f"with {DET}, x as (select config, cls, sum(tp) as tp, count(*) as n from det where score >= 8000 group by 1, 2), y as (select config, cls, coalesce(tp, 0) / nullif(n, 0)::double as p, coalesce(tp, 0) / nullif(n_gt, 0)::double as r from gt left join x using (config, cls)) select config, cls, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from y")
def r4(spark, d):
    dets = detections(spark, d)
    return r.prf(dets, truths(dets), ["config", "cls"], 8000).select("config", "cls", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"))


@query("r5_config_table", f"with {AP} select config, round(avg(ap), 6) as mean, round(stddev_samp(ap), 6) as sd, row_number() over (order by avg(ap) desc, config) as place from ap group by 1")
def r5(spark, d):
    from pyspark.sql import Window

    dets = detections(spark, d)
    t = r.average_precision(dets, truths(dets), ["config", "cls"]).groupBy("config").agg(F.avg("ap").alias("m"), F.stddev_samp("ap").alias("s"))
    return t.select("config", R6("m").alias("mean"), R6("s").alias("sd"), F.row_number().over(Window.orderBy(F.desc("m"), "config")).cast("bigint").alias("place"))  # a row a configuration


@query("r6_threshold_sweep", f"with {DET}, th as (select unnest([0, 2000, 4000, 8000, 16000])::double as threshold), x as (select config, cls, threshold, n_gt, coalesce(sum(tp) filter (score >= threshold), 0)::bigint as tp, count(*) filter (score >= threshold) as n from det join gt using (config, cls), th group by 1, 2, 3, 4) select config, cls, threshold, tp, n - tp as fp, n_gt - tp as fn, round(tp / nullif(n_gt, 0)::double, 6) as recall, round(tp / nullif(n, 0)::double, 6) as precision from x")
def r6(spark, d):
    dets = detections(spark, d)
    out = r.threshold_sweep(dets, truths(dets), ["config", "cls"], THRESHOLDS)
    return out.select("config", "cls", "threshold", "tp", "fp", "fn", R6("recall").alias("recall"), R6("precision").alias("precision"))


@query("r8_arm_summary", """with c as (select l_orderkey as k, l_partkey % 50 as cell, bool_or(l_linenumber <= 3) as a, bool_or(l_linenumber > 3) as b from lineitem group by 1, 2),
i as (select k, count(*) filter (a and b) / count(*)::double as iou, count(*) as size from c group by 1)
select o_orderpriority as arm, case when size < 3 then 'small' when size < 6 then 'medium' else 'large' end as band, count(*) as n, round(avg(iou), 6) as mean_iou, round(avg((iou > 0)::int), 6) as recall from i join orders on o_orderkey = k group by 1, 2""")
def r8(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("cell")).agg(F.max(F.col("l_linenumber") <= 3).alias("a"), F.max(F.col("l_linenumber") > 3).alias("b"))
    i = c.groupBy("k").agg((F.count_if(F.col("a") & F.col("b")) / F.count(F.lit(1))).alias("iou"), F.count(F.lit(1)).alias("size"))
    band = F.when(F.col("size") < 3, "small").when(F.col("size") < 6, "medium").otherwise("large")
    return i.join(table(spark, d, "orders"), F.col("k") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("arm"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg("iou")).alias("mean_iou"), R6(F.avg(F.when(F.col("iou") > 0, 1).otherwise(0))).alias("recall"))


def _limits(df, by, *more):
    return df.select(*by, *more, "valid", R6("lo").alias("lo"), R6("hi").alias("hi"))


LIMITS = "count(stat) as valid, round(quantile_cont(stat, 0.025), 6) as lo, round(quantile_cont(stat, 0.975), 6) as hi"
STEPS = 40  # the twin's Poisson table: enough for counts of up to a dozen equal rows
POISSON = f"""p as (select c, list_transform(range(0, {STEPS}), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(c) - c - lgamma(j + 1))))) as cdf from (select distinct c from k))"""
LINES = f"""l as (select rep, {hash52_sql(7, "'a'", 'rep')} % {resample.PRIME - 1} + 1 as a, {hash52_sql(7, "'z'", 'rep')} % {resample.PRIME} as z from (select unnest(range(0, {B})) as rep))"""
WEIGHT = " + ".join(f"(u >= s{k})::int" for k in range(STEPS))


@query("r9_bootstrap_items", f"""with k as (select event_type, value, count(*) as c from events where value is not null group by 1, 2), {POISSON}, {LINES},
x as (select event_type, value, {", ".join(f"cdf[{k + 1}] as s{k}" for k in range(STEPS))}, {hash52_sql(7, '(round_even(value * 1e6, 0)::bigint)', '(0::bigint)')} % {resample.PRIME} as x from k join p using (c)),
y as (select *, ((x * a + z) % {resample.PRIME}) / {resample.PRIME}::double as u from x, l),
s as (select event_type, rep, sum(({WEIGHT}) * value) / nullif(sum({WEIGHT}), 0) as stat from y group by 1, 2), o as (select event_type, round(avg(value), 6) as obs from events group by 1)
select event_type, any_value(obs) as obs, {LIMITS} from s join o using (event_type) group by 1""")
def r9(spark, d):
    return _limits(resample.bootstrap_mean(table(spark, d, "events"), ["event_type"], "value", B, 7), ["event_type"], R6("obs").alias("obs"))


def _best_sql(unit):
    """The runs' detections, one a vector, the draws of ``unit`` and the AP of each run and replicate."""
    return f"""{SCORED}, det as (select vec_id, grp, config, seed, score, (label = cls)::int as tp from (select *, row_number() over (partition by vec_id, config, seed order by score desc, cls) as rk from sc) where rk = 1),
{_ap_sql('', 'grp', 11)}, obs as (select config, seed, sum(p * (k - below)) / 101 as ap from (
  select config, seed, k, max(p) over w as p, lead(k, 1, -1) over w as below from (
    select config, seed, (ct * 100) // n as k, max(ct / cn::double) as p from (select config, seed, sum(tp) over w as ct, count(*) over w as cn, (select count(*) from e) as n from det window w as (partition by config, seed order by score desc)) group by 1, 2, 3
  ) window w as (partition by config, seed order by k desc)) group by 1, 2)""" + (f", {_ap_sql('i', 'vec_id', 13)}" if unit == "both" else "")


def _ap_sql(s, key, seed):
    return f"""g{s} as (select key, row_number() over (order by key) as no from (select distinct {key} as key from e)), n{s} as (select count(*) as n from g{s}),
w{s} as (select rep, key, count(*) as w from (select rep, {hash52_sql(seed, 'rep', '(no - 1)')} % n + 1 as no from g{s}, n{s}, (select unnest(range(0, {B})) as rep) r) d join g{s} using (no) group by 1, 2),
rd{s} as (select config, seed, rep, score, sum(w * tp) as t, sum(w) as n from det join w{s} on w{s}.key = det.{key} group by 1, 2, 3, 4),
cu{s} as (select config, seed, rep, sum(t) over w as ct, sum(n) over w as cn from rd{s} window w as (partition by config, seed, rep order by score desc)),
gt{s} as (select rep, sum(w * c) as g from w{s} join (select {key} as key, count(*) as c from e group by 1) using (key) group by 1),
pk{s} as (select config, seed, rep, (ct * 100) // g as k, max(ct / cn::double) as p from cu{s} join gt{s} using (rep) group by 1, 2, 3, 4),
ap{s} as (select config, seed, rep, sum(p * (k - below)) / 101 as ap from (select config, seed, rep, k, max(p) over w as p, lead(k, 1, -1) over w as below from pk{s} window w as (partition by config, seed, rep order by k desc)) group by 1, 2, 3)"""


def _replicates(spark, d, unit="grp", seed=11):
    """config, seed, rep, ap of the runs' detections, with the observed AP as ``obs``; ``unit`` is what is resampled."""
    dets = best_class(spark, d)
    owed = dets.groupBy("config", "seed", unit).agg(F.count(F.lit(1)).alias("n_gt"))
    reps = resample.replicated_ap(dets, owed, ["config", "seed"], unit, resample.draw_vectors(dets, unit, B, seed))
    obs = r.average_precision(dets, owed.groupBy("config", "seed").agg(F.sum("n_gt").alias("n_gt")), ["config", "seed"])
    return reps.join(obs.select("config", "seed", F.col("ap").alias("obs")), ["config", "seed"])


@query("r10_bootstrap_groups", f"with {_best_sql('grp')} select config, seed, round(any_value(obs.ap), 6) as obs, {LIMITS.replace('stat', 'ap.ap')} from ap join obs using (config, seed) group by 1, 2")
def r10(spark, d):
    """Average precision of each run, groups of vectors resampled."""
    reps = _replicates(spark, d)
    return _limits(resample.limits(reps.withColumn("obs", R6("obs")), ["config", "seed", "obs"], "ap"), ["config", "seed", "obs"])


@query("r11_bootstrap_config", f"""with {_best_sql('both')}, m as (select config, rep, avg(ap) as stat from ap group by 1, 2), mi as (select config, rep, avg(ap) as stat from api group by 1, 2),
a as (select config, {LIMITS}, quantile_cont(stat, 0.975) - quantile_cont(stat, 0.025) as width from m group by 1),
b as (select config, round(quantile_cont(stat, 0.025), 6) as naive_lo, round(quantile_cont(stat, 0.975), 6) as naive_hi, quantile_cont(stat, 0.975) - quantile_cont(stat, 0.025) as naive from mi group by 1)
select config, round(o, 6) as obs, valid, lo, hi, naive_lo, naive_hi, round(width / nullif(naive, 0), 6) as width_ratio from a join b using (config) join (select config, avg(ap) as o from obs group by 1) using (config)""")
def r11(spark, d):
    """Mean over the runs of a configuration: the same draws for all runs, beside the interval of resampled single vectors."""
    def mean(reps):
        return reps.groupBy("config", "rep").agg(F.avg("ap").alias("m"), F.avg("obs").alias("obs"))

    own = resample.limits(mean(_replicates(spark, d)), ["config", "obs"], "m").withColumn("width", F.col("hi") - F.col("lo"))
    naive = resample.limits(mean(_replicates(spark, d, "vec_id", 13)), ["config"], "m").select("config", F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
    ratio = F.col("width") / F.nullif(F.col("nhi") - F.col("nlo"), F.lit(0.0))
    return _limits(own.join(naive, "config"), ["config"], R6("obs").alias("obs"), R6("nlo").alias("naive_lo"), R6("nhi").alias("naive_hi"), R6(ratio).alias("width_ratio"))


@query("r12_bootstrap_difference", f"""with {_best_sql('grp')}, z as (select seed::varchar as run, rep, max(ap) filter (config = 'first') - max(ap) filter (config = 'second') as stat from ap group by 1, 2
  union all select 'mean', rep, avg(ap) filter (config = 'first') - avg(ap) filter (config = 'second') from ap group by 2),
o as (select seed::varchar as run, max(ap) filter (config = 'first') - max(ap) filter (config = 'second') as obs from obs group by 1 union all select 'mean', avg(ap) filter (config = 'first') - avg(ap) filter (config = 'second') from obs),
i as (select run, {LIMITS} from z group by 1) select run, round(obs, 6) as obs, valid, lo, hi, lo > 0 or hi < 0 as excludes_zero from i join o using (run)""")
def r12(spark, d):
    """First less second configuration, run by run and of their means; both arms share the draws and the difference is taken in each replicate."""
    reps = stored(_replicates(spark, d))
    both = reps.select(F.col("seed").cast("string").alias("run"), "config", "rep", "ap", "obs").unionByName(
        reps.groupBy("config", "rep").agg(F.avg("ap").alias("ap"), F.avg("obs").alias("obs")).withColumn("run", F.lit("mean"))
    )
    gap = lambda c: F.max(F.when(F.col("config") == "first", F.col(c))) - F.max(F.when(F.col("config") == "second", F.col(c)))
    diff = both.groupBy("run", "rep").agg(gap("ap").alias("stat"), gap("obs").alias("obs"))
    return _limits(resample.limits(diff, ["run", "obs"], "stat"), ["run"], R6("obs").alias("obs")).withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


DRAWS = f"""g as (select user_id, row_number() over (order by user_id) as no from (select distinct user_id from events)), n as (select count(*) as n from g),
w as (select rep, g.user_id, count(*) as w from (select rep, {hash52_sql(11, 'rep', '(no - 1)')} % n + 1 as no from g, n, (select unnest(range(0, {B})) as rep) r) p join g using (no) group by 1, 2)"""


@query("r13_bootstrap_pairs", f"""with {DRAWS}, o as (select user_id, round(quantile_cont(value, 0.5), 4) as x, round(avg(value), 4) as y from events group by 1), z as (select rep, x, y, unnest(range(0, w)) as i from o join w using (user_id)),
t as (select rep, quantile_cont(y - x, 0.5) as med, avg(y - x) as bias, 2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y))) as ccc from z group by 1)
select count(*) as valid, count(distinct round(med, 6))::bigint as medians, round(quantile_cont(med, 0.025), 6) as med_lo, round(quantile_cont(med, 0.975), 6) as med_hi, round(quantile_cont(bias, 0.025), 6) as bias_lo, round(quantile_cont(bias, 0.975), 6) as bias_hi, round(quantile_cont(ccc, 0.025), 6) as ccc_lo, round(quantile_cont(ccc, 0.975), 6) as ccc_hi from t""")
def r13(spark, d):
    """Weights instead of repeated rows: a weighted median and weighted moments a replicate, the replicates as vectors of bytes."""
    e = table(spark, d, "events")
    o = stored(e.groupBy("user_id").agg(rounded(F.percentile("value", 0.5), 4).alias("x"), rounded(F.avg("value"), 4).alias("y")))
    t = resample.replicated_pairs(o, "user_id", resample.draw_vectors(o, "user_id", B, 11))
    ends = [R6(F.percentile(c, p)).alias(f"{c}_{s}") for c in ("med", "bias", "ccc") for s, p in (("lo", 0.025), ("hi", 0.975))]
    return t.agg(F.count(F.lit(1)).alias("valid"), F.count_distinct(R6("med")).alias("medians"), *ends)
