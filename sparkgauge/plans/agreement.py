"""Queries for agreement statistics: weekly median (x) and mean (y) of ``events.value`` a user, five runs by event_id mod 5."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sparkgauge.functions import beta
from sparkgauge.functions.numbers import ordered_sum, quotient, rounded as rounded_to
from sparkgauge.operators import stats as st
from sparkgauge.operators.ordering import percentiles
from sparkgauge.plans.registry import query, table
from sparkgauge.session import stored

R6 = rounded_to
# a mean may lie on a tie of the sixth place, and sums in another order fall on either side of it
R96 = lambda c: R6(rounded_to(c, 9))


def rounded(df, keep, cols):
    return df.select(*keep, *[R6(c).alias(c) for c in cols])


def pairs(spark, d):
    """Median and mean of a unit's events of a week, the mean summed in the order of the events: x and y are compared bit by bit."""
    week = F.call_function("div", F.datediff(F.to_date("ts"), F.lit("2024-01-01")), F.lit(7)).cast("int")
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).alias("run"), F.col("user_id").alias("unit"), week.alias("tp"), "value")
    return e.groupBy("run", "unit", "tp").agg((F.percentile("value", 0.5) / 100).alias("x"), (ordered_sum("value", "event_id") / F.count("value") / 100).alias("y"))


OB = "ob as (select event_id % 5 as run, user_id as unit, (date_diff('day', timestamp '2024-01-01', ts) // 7)::int as tp, quantile_cont(value, 0.5) / 100 as x, avg(value) / 100 as y from events group by all)"


@query("d1_crosstab", "select source, lang, count(*) as n, count(distinct n_chars)::bigint as sizes from documents group by rollup (source, lang)")
def d1(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_chars").alias("sizes"))


@query("d2_profile", f"with {OB} select run, count(*) as n, " + ", ".join(f"round(round(quantile_cont(x, {p}), 9), 6) as p{int(100 * p)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(round(min(x), 9), 6) as lo, round(round(max(x), 9), 6) as hi from ob group by 1")
def d2(spark, d):
    p = pairs(spark, d)
    probs = {f"p{int(100 * q)}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    ends = p.groupBy("run").agg(F.count(F.lit(1)).alias("n"), R96(F.min("x")).alias("lo"), R96(F.max("x")).alias("hi"))
    return percentiles(p, ["run"], "x", probs).select("run", *[R96(c).alias(c) for c in probs]).join(ends, "run")


@query("d3_seed_summary", f"with {OB}, m as (select run, tp, avg(x) as v from ob group by 1, 2) select tp, count(*) as runs, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as lo, round(max(v), 6) as hi from m group by 1")
def d3(spark, d):
    m = pairs(spark, d).groupBy("run", "tp").agg(F.avg("x").alias("v"))
    return m.groupBy("tp").agg(F.count(F.lit(1)).alias("runs"), R6(F.avg("v")).alias("mean"), R6(F.stddev_samp("v")).alias("sd"), R6(F.min("v")).alias("lo"), R6(F.max("v")).alias("hi"))


@query("d4_pearson", f"with {OB}, m as (select run, count(*) as n, corr(x, y) as r from ob group by 1) select run, n, round(r, 6) as r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3.0)), 6) as lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3.0)), 6) as hi from m")
def d4(spark, d):
    return rounded(st.pearson_ci(pairs(spark, d), ["run"]), ["run", "n"], ["r", "lo", "hi"])


@query("d5_spearman", f"""with {OB}, r as (select run, rank() over (partition by run order by x) + (count(*) over (partition by run, x) - 1) / 2.0::double as rx, rank() over (partition by run order by y) + (count(*) over (partition by run, y) - 1) / 2.0::double as ry from ob)
select run, round(corr(rx, ry), 6) as rho from r group by 1""")
def d5(spark, d):
    return rounded(st.spearman(pairs(spark, d), ["run"]), ["run"], ["rho"])


CCC = "2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y)))"


@query("d6_concordance", f"with {OB} select run, round({CCC}, 6) as ccc from ob group by 1")
def d6(spark, d):
    return pairs(spark, d).groupBy("run").agg(R6(st.ccc("x", "y")).alias("ccc"))


@query("d7_latency_profile", """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, round(quantile_cont(value, 0.5), 6) as median, max(value) filter (i = least(floor(0.9::double * n), n - 1)) as p90, round(1000 / quantile_cont(value, 0.5), 6) as throughput from r group by 1""")
def d7(spark, d):
    e = table(spark, d, "events")
    m, p = percentiles(e, ["event_type"], "value", {"median": 0.5}), percentiles(e, ["event_type"], "value", {"p90": 0.9}, rule="index")
    return m.join(p, "event_type").select("event_type", R6("median").alias("median"), "p90", R6(1000 / F.col("median")).alias("throughput"))


BA = f"with {OB}, dd as (select *, y - x as d from ob), m as (select run, count(*) as n, avg(d) as bias, stddev_samp(d) as sd, avg(abs(d)) as mae from dd group by 1)"


@query("d8_bland_altman", BA + ", i as (select run, 100.0 * count(*) filter (d between bias - 1.96 * sd and bias + 1.96 * sd) / count(*) as inside from dd join m using (run) group by 1) select run, n, round(bias, 6) as bias, round(sd, 6) as sd, round(mae, 6) as mae, round(bias - 1.96 * sd, 6) as loa_lo, round(bias + 1.96 * sd, 6) as loa_hi, round(sd / sqrt(n), 6) as se, round(inside, 6) as inside from m join i using (run)")
def d8(spark, d):
    return rounded(st.bland_altman(pairs(spark, d), ["run"]), ["run", "n"], ["bias", "sd", "mae", "loa_lo", "loa_hi", "se", "inside"])


@query("d9_ols", f"with {OB} select run, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) as slope_se from ob group by 1")
def d9(spark, d):
    return rounded(st.ols(pairs(spark, d), ["run"]), ["run"], ["slope", "intercept", "slope_se"])


def _t_tail_sql(t, free):
    """P(T > t) for whole degrees of freedom: the finite sums in the angle atan(t / sqrt(free)), one for even and one for odd."""
    cos = f"sqrt({free} / ({free} + {t} * {t}))"
    even = f"list_sum(list_transform(range(0, {free}::bigint // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + 2 * k * ln({cos}))))"
    odd = f"coalesce(list_sum(list_transform(range(0, ({free}::bigint - 1) // 2), lambda k: exp(lgamma(k + 1.0) + lgamma(0.5) - lgamma(k + 1.5) + (2 * k + 1) * ln({cos})) / 2)), 0)"
    sin = f"({t} / sqrt({free} + {t} * {t}))"
    return f"((1 - case when {free}::bigint % 2 = 0 then {sin} * {even} else 2 / pi() * (atan({t} / sqrt({free})) + {sin} * {odd}) end) / 2)"


@query("d10_tost", f"""with {OB}, m as (select run, count(*) as n, avg(y - x) as mean, stddev_samp(y - x) / sqrt(count(*)) as se from ob group by 1),
g as (select *, unnest([0.05, 0.1, 0.2])::double as margin, (n - 1)::double as free from m), t as (select *, (mean + margin) / se as t1, (margin - mean) / se as t2 from g),
p as (select *, greatest({_t_tail_sql('t1', 'free')}, {_t_tail_sql('t2', 'free')}) as p from t)
select run, n, margin, p < 0.05 as equivalent, round(mean, 6) as mean, round(se, 6) as se, round(p, 6) as p from p""")
def d10(spark, d):
    return rounded(st.tost(pairs(spark, d), ["run"], [0.05, 0.1, 0.2], F.col("y") - F.col("x")), ["run", "n", "margin", "equivalent"], ["mean", "se", "p"])


@query("d11_paired_t", f"with {OB}, m as (select tp, run, avg(y - x) as mean, stddev_samp(y - x) as sd, count(*) as n from ob group by 1, 2) select tp, count(*) as runs, round(avg(mean / (sd / sqrt(n))), 6) as t, round(avg(mean / sd), 6) as dz from m group by 1")
def d11(spark, d):
    diff = F.col("y") - F.col("x")
    m = pairs(spark, d).groupBy("tp", "run").agg(F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("tp").agg(F.count(F.lit(1)).alias("runs"), R6(F.avg(F.col("mean") / (F.col("sd") / F.sqrt("n")))).alias("t"), R6(F.avg(F.col("mean") / F.col("sd"))).alias("dz"))


@query("d12_sign_test", f"""with {OB}, m as (select unit, count(*) filter (y > x) as pos, count(*) filter (y < x) as neg from ob group by 1),
t as (select unit, pos, neg, unnest(range(0, least(pos, neg) + 1)) as i from m)
select unit, pos, neg, round(least(1, 2 * sum(exp(lgamma(pos + neg + 1.0) - lgamma(i + 1.0) - lgamma(pos + neg - i + 1.0) - (pos + neg) * ln(2.0)))), 6) as p from t group by 1, 2, 3""")
def d12(spark, d):
    m = pairs(spark, d).groupBy("unit").agg(F.count_if(F.col("y") > F.col("x")).alias("pos"), F.count_if(F.col("y") < F.col("x")).alias("neg"))
    return m.withColumn("p", R6(beta.sign_test(F.col("pos"), F.col("neg"))))


POLY = "-1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277))))))))"


@query("d13_wilcoxon", f"""with {OB}, dd as (select run, y - x as d from ob where y <> x), r as (select run, d, rank() over (partition by run order by abs(d)) + (count(*) over (partition by run, abs(d)) - 1) / 2.0::double as rk from dd),
w as (select run, count(*)::double as n, coalesce(sum(rk) filter (d > 0), 0) as w_plus, coalesce(sum(rk) filter (d < 0), 0) as w_minus from r group by 1),
k as (select run, sum(c * c * c - c)::double as ties from (select run, count(*) as c from dd group by run, abs(d)) group by 1),
z as (select *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from w join k using (run)), u as (select *, abs(z) / sqrt(2.0) as x, 1 / (1 + 0.5 * abs(z) / sqrt(2.0)) as u from z)
select run, n::bigint as n, round(w_plus, 6) as w_plus, round(w_minus, 6) as w_minus, round(z, 6) as z, round(least(1, u * exp(-x * x + {POLY})), 6) as p, 'normal' as rule from u""")
def d13(spark, d):
    w = st.wilcoxon(pairs(spark, d).withColumn("d", F.col("y") - F.col("x")), ["run"], "d")
    return rounded(w, ["run", "n", "rule"], ["w_plus", "w_minus", "z", "p"])


@query("d14_error_report", f"""with {OB}, dd as (select run, x, y, y - x as d from ob) select run, count(*) as n, round(avg(d), 6) as bias, round(quantile_cont(abs(d), 0.5), 6) as mdae, round(max(abs(d)), 6) as worst, round(avg((d = 0)::int), 6) as unchanged, round(avg((abs(d) > 0.1)::int), 6) as over_10,
  count(*) filter (sign(x - 0.4) <> sign(y - 0.4)) as sign_changes, count(*) filter (y > 1) as off_scale, round(quantile_cont(d / x, 0.5), 6) as relative from dd group by 1""")
def d14(spark, d):
    p = stored(pairs(spark, d).withColumn("d", F.col("y") - F.col("x")).withColumns({"a": F.abs("d"), "rel": quotient(F.col("d"), F.col("x"))}))
    share = lambda c: R6(F.avg(F.when(c, 1).otherwise(0)))
    m = p.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), R6(F.avg("d")).alias("bias"), R6(F.max("a")).alias("worst"), share(F.col("d") == 0).alias("unchanged"), share(F.col("a") > 0.1).alias("over_10"),
        F.count_if(F.signum(F.col("x") - 0.4) != F.signum(F.col("y") - 0.4)).alias("sign_changes"), F.count_if(F.col("y") > 1).alias("off_scale"),
    )
    both = p.select("run", F.explode(F.array(F.struct(F.lit("mdae").alias("k"), F.col("a").alias("v")), F.struct(F.lit("relative").alias("k"), F.col("rel").alias("v")))).alias("x")).select("run", "x.k", "x.v")
    med = percentiles(both, ["run", "k"], "v", {"m": 0.5}).groupBy("run").agg(*[R6(F.max(F.when(F.col("k") == k, F.col("m")))).alias(k) for k in ("mdae", "relative")])
    return m.join(med, "run")


@query("d15_stratified_error", f"with {OB} select run, tp, count(*) as n, round(avg(y - x), 6) as bias, round(stddev_samp(y - x), 6) as sd from ob group by grouping sets ((run, tp), (run), ())")
def d15(spark, d):
    diff = F.col("y") - F.col("x")
    return pairs(spark, d).groupingSets([["run", "tp"], ["run"], []], "run", "tp").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(diff)).alias("bias"), R6(F.stddev_samp(diff)).alias("sd"))


NEG = f"with {OB}, g as (select run, unit, tp, x - 0.25 as x, y - 0.35 as y from ob)"


@query("d16_negatives", NEG + " select unit, tp, count(*) as n, round(min(y), 6) as lo, round(max(y), 6) as hi, count(*) filter (x * y > 0) as concordant, count(*) filter (x * y <= 0) as discordant from g where x < 0 or y < 0 group by 1, 2")
def d16(spark, d):
    g = pairs(spark, d).withColumns({"x": F.col("x") - 0.25, "y": F.col("y") - 0.35}).where("x < 0 or y < 0")
    return g.groupBy("unit", "tp").agg(F.count(F.lit(1)).alias("n"), R6(F.min("y")).alias("lo"), R6(F.max("y")).alias("hi"), F.count_if(F.col("x") * F.col("y") > 0).alias("concordant"), F.count_if(F.col("x") * F.col("y") <= 0).alias("discordant"))


@query("d17_systematic_series", NEG + """, q as (select unit, tp, x - y as d, x, y from g where run = 0 and (x < 0 or y < 0) and x * y <= 0), s as (select unit, count(*) as n, max(d) as hi, min(d) as lo, avg(d) as mean from q group by 1),
o as (select a.unit, max(b.hi) - min(b.lo) as others, sum(b.n) as m from s a join s b on b.unit <> a.unit group by 1),
l as (select unit, x > lag(x) over w and y > lag(y) over w as up from q window w as (partition by unit order by tp))
select s.unit, s.n, round(mean, 6) as mean, round(hi - lo, 6) as spread, round(others, 6) as others, coalesce(hi - lo > 1e-9 and m > 1 and others / (hi - lo) >= 5, false) as systematic, (select coalesce(bool_and(up), true) from l where l.unit = s.unit) as rising from s join o using (unit) where s.n >= 3""")
def d17(spark, d):
    """The others' range comes from the two largest and two smallest series, not from a self join."""
    q = pairs(spark, d).where("run = 0").withColumns({"x": F.col("x") - 0.25, "y": F.col("y") - 0.35}).where("(x < 0 or y < 0) and x * y <= 0").withColumn("d", F.col("x") - F.col("y"))
    w = Window.partitionBy("unit").orderBy("tp")
    q = q.withColumn("up", (F.col("x") > F.lag("x").over(w)) & (F.col("y") > F.lag("y").over(w)))
    s = q.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("hi"), F.min("d").alias("lo"), F.avg("d").alias("mean"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("rising"))
    best = s.agg(F.max(F.struct("hi", "unit")).alias("h1"), F.min(F.struct("lo", "unit")).alias("l1"), F.sum("n").alias("m"))
    s = s.crossJoin(best)  # one row
    second = s.agg(F.max(F.when(F.col("unit") != F.col("h1.unit"), F.col("hi"))).alias("h2"), F.min(F.when(F.col("unit") != F.col("l1.unit"), F.col("lo"))).alias("l2"))
    s = s.crossJoin(second)  # one row
    others = F.when(F.col("unit") == F.col("h1.unit"), F.col("h2")).otherwise(F.col("h1.hi")) - F.when(F.col("unit") == F.col("l1.unit"), F.col("l2")).otherwise(F.col("l1.lo"))
    spread = F.col("hi") - F.col("lo")
    s = s.withColumns({"others": others, "spread": spread})
    sys = F.coalesce((F.col("spread") > 1e-9) & (F.col("m") - F.col("n") > 1) & (F.col("others") / F.col("spread") >= 5), F.lit(False))
    return s.where("n >= 3").select("unit", "n", R6("mean").alias("mean"), R6("spread").alias("spread"), R6("others").alias("others"), sys.alias("systematic"), "rising")


@query("d18_sensitivity", f"with {OB}, k as (select unit, tp from ob group by 1, 2 having count(*) = 5 and bool_and(y between 0.05 and 1.05)) select run, count(*) as n, round({CCC}, 6) as ccc, round(avg(y - x), 6) as bias from ob join k using (unit, tp) group by 1")
def d18(spark, d):
    p = pairs(spark, d)
    k = p.groupBy("unit", "tp").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("y").between(0.05, 1.05)).alias("ok")).where("n = 5 and ok")
    return p.join(k, ["unit", "tp"], "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"), R6(st.ccc("x", "y")).alias("ccc"), R6(F.avg(F.col("y") - F.col("x"))).alias("bias"))


@query("d19_envelope", f"with {OB} select unit, tp, round(round(avg(y), 9), 6) as mean, round(round(min(y), 9), 6) as lo, round(round(max(y), 9), 6) as hi from ob group by 1, 2")
def d19(spark, d):
    return pairs(spark, d).groupBy("unit", "tp").agg(R96(F.avg("y")).alias("mean"), R96(F.min("y")).alias("lo"), R96(F.max("y")).alias("hi"))


CELLS = "c as (select distinct l_orderkey as k, l_partkey % 50 as cell, case when l_linenumber <= 3 then 'a' else 'b' end as side from lineitem), p as (select k, cell, bool_or(side = 'a') as a, bool_or(side = 'b') as b from c group by 1, 2)"


def _cells(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("cell"), F.when(F.col("l_linenumber") <= 3, "a").otherwise("b").alias("side"))


@query("d20_set_iou", f"with {CELLS} select k, count(*) filter (a and b) as inter, count(*) as union_size, round(count(*) filter (a and b) / count(*)::double, 6) as iou, count(*) filter (b) - count(*) filter (a) as delta from p group by 1")
def d20(spark, d):
    out = st.set_iou(_cells(spark, d), "k", "cell", "side", "a", "b")
    return out.select("k", "inter", "union_size", R6("iou").alias("iou"), (F.col("n_right") - F.col("n_left")).alias("delta"))


@query("d21_union_size", f"with {CELLS} select k, count(*) as area from p group by 1")
def d21(spark, d):
    return _cells(spark, d).groupBy("k").agg(F.count_distinct("cell").alias("area"))


@query("d22_label_agreement", "with j as (select case when quality = 1 then 'good' else 'bad' end as a, case when toxic = 1 then 'bad' else 'good' end as b from labels) select a, b, count(*) as n, a = b as agree from j group by 1, 2")
def d22(spark, d):
    a, b = F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when(F.col("toxic") == 1, "bad").otherwise("good")
    return table(spark, d, "labels").groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("agree", F.col("a") == F.col("b"))


@query("d23_clean_pairs", f"with {OB}, t as (select *, case when y = x then 'identical' when x < 0.05 then 'small' end as reason from ob) select s as sample, count(*) as n, round({CCC}, 6) as ccc, count(reason) as degenerate from (select 'all' as s, * from t union all select 'clean', * from t where reason is null) group by 1")
def d23(spark, d):
    reason = F.when(F.col("y") == F.col("x"), "identical").when(F.col("x") < 0.05, "small")
    t = pairs(spark, d).withColumn("reason", reason)
    tagged = t.withColumn("sample", F.explode(F.when(F.col("reason").isNull(), F.array(F.lit("all"), F.lit("clean"))).otherwise(F.array(F.lit("all")))))
    return tagged.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), R6(st.ccc("x", "y")).alias("ccc"), F.count("reason").alias("degenerate"))


@query("d23_band_matched", f"""with {OB}, clean as (select x from ob where run = 0 and y <> x and x >= 0.05), band as (select min(x) as lo, max(x) as hi from clean),
t as (select 'all' as sample, * from ob where run <> 0 union all select 'above_zero', * from ob where run <> 0 and x > 0 union all select 'band', ob.* from ob, band where run <> 0 and x between lo and hi)
select sample, run, count(*) as n, round(round(avg(abs(y - x)), 9), 6) as mae, round(round(avg(y - x), 9), 6) as bias, round((select lo from band), 6) as lo, round((select hi from band), 6) as hi from t group by 1, 2""")
def d23_band(spark, d):
    """Run 0 is the observer; the other runs are methods, compared on all rows, on those above zero and on the observer's own band."""
    return st.band_matched(stored(pairs(spark, d)), F.col("run") == 0, (F.col("y") != F.col("x")) & (F.col("x") >= 0.05), "x", "run").groupBy("sample", "run").agg(
        F.count(F.lit(1)).alias("n"), R96(F.avg(F.abs(F.col("y") - F.col("x")))).alias("mae"), R96(F.avg(F.col("y") - F.col("x"))).alias("bias"), R6(F.max("lo")).alias("lo"), R6(F.max("hi")).alias("hi")
    )


TAILS = {5: 0.05, 10: 0.1, 20: 0.2}
SETS = {"ab": "a and b", "ac": "a and c", "bc": "b and c", "abc": "a and b and c"}
EXPECTED = {"ab": "na * nb / n", "ac": "na * nc / n", "bc": "nb * nc / n", "abc": "na * nb * nc / (n * n)"}


@query("d24_enrichment", f"""with {OB}, q as ({" union all ".join(f"select run, {k} as tail, quantile_cont(x, {q}) as cut from ob group by 1" for k, q in TAILS.items())}),
t as (select run, tail, y < 0.3 as a, abs(y - x) > 0.1 as b, x <= cut as c from ob join q using (run)),
m as (select run, tail, count(*)::double as n, count(*) filter (a) as na, count(*) filter (b) as nb, count(*) filter (c) as nc, {", ".join(f"count(*) filter ({c}) as o_{k}" for k, c in SETS.items())} from t group by 1, 2)
""" + " union all ".join(f"select run, tail::int as tail, '{k}' as sets, o_{k} as observed, round({e}, 6) as expected, round(o_{k} / nullif({e}, 0), 6) as enrichment from m" for k, e in EXPECTED.items()))
def d24(spark, d):
    """Low values, disagreement and the lower tails of x at 5, 10 and 20 %: pairs and the triple, observed against chance."""
    p = stored(pairs(spark, d))
    t = p.join(percentiles(p, ["run"], "x", {f"c{k}": q for k, q in TAILS.items()}), "run")
    flags = {"a": F.col("y") < 0.3, "b": F.abs(F.col("y") - F.col("x")) > 0.1} | {f"c{k}": F.col("x") <= F.col(f"c{k}") for k in TAILS}
    sets = {(k, s): [f"c{k}" if c == "c" else c for c in s] for k in TAILS for s in SETS}
    out = st.flag_overlaps(t, ["run"], flags, {f"{k}:{s}": m for (k, s), m in sets.items()})
    part = F.split("sets", ":")
    return out.select("run", part[0].cast("int").alias("tail"), part[1].alias("sets"), "observed", R6("expected").alias("expected"), R6("enrichment").alias("enrichment"))


@query("d25_recurring_terms", "with w as (select unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as term from conversations) select term, count(*) as n from w where term not in ('that', 'with', 'this', 'from') group by 1 having count(*) >= 3 order by n desc, term limit 25")
def d25(spark, d):
    w = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    return w.where(~F.col("term").isin("that", "with", "this", "from")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "term").limit(25)


@query("d26_verdict", f"with {OB}, m as (select run, quantile_cont(abs(y - x), 0.5) as md, quantile_cont(abs(y - x), 0.9) as p9 from ob group by 1) select run, round(md, 6) as md, case when md <= 0.08 and p9 <= 0.4 then 'valid' when md <= 0.13 then 'grey' else 'bias' end as verdict from m")
def d26(spark, d):
    m = percentiles(pairs(spark, d).withColumn("a", F.abs(F.col("y") - F.col("x"))), ["run"], "a", {"md": 0.5, "p9": 0.9})
    return m.select("run", R6("md").alias("md"), F.when((F.col("md") <= 0.08) & (F.col("p9") <= 0.4), "valid").when(F.col("md") <= 0.13, "grey").otherwise("bias").alias("verdict"))


@query("d27_substitution_effect", f"""with {OB}, s as (select unit, tp, x as before_v, case when unit % 10 = 0 and tp in (0, 2) then y else x end as after_v from ob where run = 0), b as (select unit, max(before_v) filter (tp = 0) as b0, max(after_v) filter (tp = 0) as a0 from s group by 1)
select unit, round(max(abs((b0 - before_v) / b0 - (a0 - after_v) / a0)), 6) as shift, max(b0) <> max(a0) as baseline_changed from s join b using (unit) where b0 is not null group by 1 having max(abs(before_v - after_v)) > 0""")
def d27(spark, d):
    s = pairs(spark, d).where("run = 0").select("unit", "tp", F.col("x").alias("before"), F.when((F.col("unit") % 10 == 0) & F.col("tp").isin(0, 2), F.col("y")).otherwise(F.col("x")).alias("after"))
    base = s.where("tp = 0").select("unit", F.col("before").alias("b0"), F.col("after").alias("a0"))
    moved = s.join(base, "unit").groupBy("unit").agg(
        F.max(F.abs(quotient(F.col("b0") - F.col("before"), F.col("b0")) - quotient(F.col("a0") - F.col("after"), F.col("a0")))).alias("shift"),
        (F.max("b0") != F.max("a0")).alias("baseline_changed"), F.max(F.abs(F.col("before") - F.col("after"))).alias("moved"),
    )
    return moved.where("moved > 0").select("unit", R6("shift").alias("shift"), "baseline_changed")


@query("d28_identical_share", f"with {OB} select run, count(*) filter (x = y) as same, count(*) as n, round(count(*) filter (x = y) / count(*)::double, 6) as share from ob group by 1")
def d28(spark, d):
    m = pairs(spark, d).groupBy("run").agg(F.count_if(F.col("x") == F.col("y")).alias("same"), F.count(F.lit(1)).alias("n"))
    return m.withColumn("share", R6(F.col("same") / F.col("n")))


@query("d29_paired_ablation", f"with {OB}, m as (select run, avg(y) filter (unit % 2 = 0) as a, avg(y) filter (unit % 2 = 1) as b from ob group by 1) select count(*) as runs, round(avg(a - b), 6) as mean, round(stddev_samp(a - b), 6) as sd, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) as t, count(*) filter (a > b) as wins, round(max(a) - min(a), 6) as spread from m")
def d29(spark, d):
    arm = lambda k: F.avg(F.when(F.col("unit") % 2 == k, F.col("y")))
    m = pairs(spark, d).groupBy("run").agg(arm(0).alias("a"), arm(1).alias("b")).withColumn("d", F.col("a") - F.col("b"))
    t = F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))))
    return m.agg(F.count(F.lit(1)).alias("runs"), R6(F.avg("d")).alias("mean"), R6(F.stddev_samp("d")).alias("sd"), R6(t).alias("t"), F.count_if(F.col("a") > F.col("b")).alias("wins"), R6(F.max("a") - F.min("a")).alias("spread"))


@query("d30_guard", f"with {OB}, m as (select run, {CCC} as v from ob group by 1), w as (select {CCC} as v from ob) select run, round(m.v, 6) as value, abs(m.v - w.v) <= 0.05 as within from m, w")
def d30(spark, d):
    p = pairs(spark, d)
    m, whole = p.groupBy("run").agg(st.ccc("x", "y").alias("v")), p.agg(st.ccc("x", "y").alias("expected"))
    return m.crossJoin(whole).select("run", R6("v").alias("value"), (F.abs(F.col("v") - F.col("expected")) <= 0.05).alias("within"))  # one expected row
