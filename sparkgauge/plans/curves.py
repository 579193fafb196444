"""Queries for curves and quality control on ``events``: series (user, event type), week as timepoint, value / 5 as area."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from sparkgauge import vocabulary as v
from sparkgauge.functions.numbers import ordered_sum, rounded
from sparkgauge.operators import series as s
from sparkgauge.operators.ordering import percentiles, rank_rows
from sparkgauge.plans.registry import query, table
from sparkgauge.session import checkpoint_folder, stored
from sparkgauge.streaming.correction_log import follow, outcomes

R6 = rounded


def frames(spark, d):
    week = F.call_function("div", F.datediff(F.to_date("ts"), F.lit("2024-01-01")), F.lit(7)).cast("int")
    val = F.col("value")
    cat = F.when(val < 2, v.CATEGORY_INVALID).when(val < 15, v.CATEGORY_UNDER).when(val < 100, v.CATEGORY_OK).when(val < 150, v.CATEGORY_AMBIGUOUS).otherwise(v.CATEGORY_OVER)
    return table(spark, d, "events").select(
        F.col("event_id").alias("frame"), F.col("user_id").alias("unit"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("series"),
        F.col("event_type").alias("field"), week.alias("tp"), (val / 5).alias("area"), cat.alias("category"), "ts",
    )


FR = """fr as (select event_id as frame, user_id as unit, user_id || '-' || event_type as series, event_type as field, (date_diff('day', timestamp '2024-01-01', ts) // 7)::int as tp, value / 5 as area,
  case when value < 2 then 'IMG_INVALIDA' when value < 15 then 'SEG_sub' when value < 100 then 'OK' when value < 150 then 'AMBIGUO' else 'SEG_super' end as category, ts from events)"""
PTS = FR + ", pts as (select series, tp, quantile_cont(area, 0.5) as area from fr group by 1, 2)"
CURVE = PTS + """, b as (select series, max(area) filter (tp = 0) as a0, count(*) as n_tp from pts group by 1),
curve as (select pts.*, a0, n_tp, case when a0 > 0 then case when tp = 0 then 0.0 else (a0 - area) / a0 end end as closure from pts join b using (series))"""


def _plaus_sql(jump: bool, base: bool) -> str:
    return f""", l as (select *, lag(closure) over (partition by series order by tp) as prev from curve),
f as (select series, max(a0) as a0, max(n_tp) as n_tp, coalesce(bool_and(closure between -0.05 and 1.05) filter ({'true' if base else 'tp > 0'}), true) as r, coalesce(bool_and(closure >= prev - 0.1) filter (prev is not null), true) as m,
  {'coalesce(bool_and(abs(closure) <= 1.5) filter (tp > 0), true)' if jump else 'true'} as j from l group by 1),
plaus as (select series, case when a0 is null then 'sem_baseline' when n_tp < 2 then 'serie_1_ponto' when a0 <= 0 then 'baseline_zero' when r and m and j then 'plausivel'
  else concat_ws('+', case when not r then 'fora_[0,1]' end, case when not m then 'nao_monotonica' end, case when not j then 'salto_absurdo' end) end as reason from f)"""


@query("q1_series_points", f"with {PTS} select series, tp, round(area, 6) as area from pts")
def q1(spark, d):
    return s.points(frames(spark, d), "area").select("series", "tp", R6("area").alias("area"))


@query("j9_closure", f"with {CURVE} select series, tp, round(area, 6) as area, round(a0, 6) as a0, n_tp, round(closure, 6) as closure from curve")
def j9(spark, d):
    c = s.closure(s.points(frames(spark, d), "area"))
    return c.select("series", "tp", R6("area").alias("area"), R6("a0").alias("a0"), "n_tp", R6("closure").alias("closure"))


@query("q2_plausibility", f"with {CURVE}{_plaus_sql(True, False)} select series, reason, reason = 'plausivel' as plausible from plaus")
def q2(spark, d):
    return s.plausibility(s.closure(s.points(frames(spark, d), "area"))).select("series", "reason", "plausible")


@query("q2_plausibility_final", f"with {CURVE}{_plaus_sql(False, True)} select series, reason, reason = 'plausivel' as plausible from plaus")
def q2f(spark, d):
    return s.plausibility(s.closure(s.points(frames(spark, d), "area")), None, True).select("series", "reason", "plausible")


@query("q3_frame_flags", f"""with {FR}, lim as (select *, case when field = 'view' and tp in (0, 1, 2) then 3.0 when field <> 'view' and tp = 0 then 10.0 end as low from fr),
u as (select unit, tp, count(*) as n, max(area) filter (area > 0) as top, min(area) filter (area > 0) as bottom from fr group by 1, 2),
r as (select lim.*, coalesce(area < low, false) as sub, area > 85 as sup, coalesce(n >= 2 and top / bottom > 3, false) as dis from lim join u using (unit, tp)),
t as (select series, tp, max(area) as tp_top from fr group by 1, 2), p as (select series, tp, lag(tp_top) over (partition by series order by tp) as prev from t),
b as (select series, max(area) filter (tp = 0) as bt, bool_or(sub or sup or dis) filter (tp = 0) as bs, max(area) filter (tp > 0) as lt from r group by 1),
f as (select frame, concat_ws('+', case when dis then 'DISCORDANCIA_CAMPO' end, case when coalesce((tp > 0 and area > bt) or (tp = 0 and bs and lt > bt), false) then 'FALHA_CLOSURE_NEG' end,
  case when coalesce(area - prev > 5, false) then 'FALHA_NAO_MONOTONICO' end, case when sub then 'FALHA_SUB' end, case when sup then 'FALHA_SUPER' end) as flags from r join p using (series, tp) join b using (series))
select frame, case when flags = '' then 'OK' else flags end as flags, flags <> '' as needs_correction from f""")
def q3(spark, d):
    low = F.when((F.col("field") == "view") & F.col("tp").isin(0, 1, 2), 3.0).when((F.col("field") != "view") & (F.col("tp") == 0), 10.0)
    return s.frame_flags(frames(spark, d), low)


PATTERN = """pat as (select series, case when bool_and(category = 'IMG_INVALIDA') then 'TODA_INVALIDA' else
  case list_sort(list(distinct category) filter (category not in ('AMBIGUO', 'IMG_INVALIDA'))) when ['OK'] then 'CONSISTENTE_OK' when ['SEG_super'] then 'CONSISTENTE_SUPER' when ['SEG_sub'] then 'CONSISTENTE_SUB'
  else case when count(*) filter (category not in ('AMBIGUO', 'IMG_INVALIDA')) = 0 then 'SO_AMBIGUO_INVALIDA' else 'MISTO' end end || case when bool_or(category = 'IMG_INVALIDA') then '+INVALIDA' else '' end end as pattern from fr group by 1)"""


@query("q4_series_pattern", f"with {FR}, {PATTERN} select series, pattern from pat")
def q4(spark, d):
    return s.pattern(frames(spark, d), "category")


@query("q5_series_decision", f"""with {CURVE.replace('from fr group by 1, 2)', "from fr where category <> 'IMG_INVALIDA' group by 1, 2)")}{_plaus_sql(True, False)}, {PATTERN}
select series, case when pattern = 'TODA_INVALIDA' then 'TODA_INVALIDA_fora' when reason is null or reason in ('sem_baseline', 'serie_1_ponto', 'baseline_zero') then 'SEM_BASELINE_fora_pareada'
  when pattern like 'CONSISTENTE%' and reason = 'plausivel' then 'USAVEL_sem_correcao' when pattern like '%MISTO%' then 'CORRIGIR_misto' else 'CORRIGIR_consistente_implausivel' end as decision from pat left join plaus using (series)""")
def q5(spark, d):
    f = frames(spark, d)
    judged = s.plausibility(s.closure(s.points(f.where(F.col("category") != v.CATEGORY_INVALID), "area")))
    return s.decision(s.pattern(f, "category"), judged)


@query("j10_borrowed_baseline", f"""with {FR}, ok as (select unit, field, series, tp, quantile_cont(area, 0.5) as area from fr where category <> 'IMG_INVALIDA' group by all),
lost as (select unit, field, series from fr group by all having bool_or(tp = 0) and not coalesce(bool_or(tp = 0 and category <> 'IMG_INVALIDA'), false) and bool_or(category <> 'IMG_INVALIDA')),
c as (select l.series, o.field, o.area, row_number() over (partition by l.series order by o.field) as rk from lost l join ok o on o.unit = l.unit and o.field <> l.field and o.tp = 0)
select l.series, c.field as lender, round(c.area, 6) as area from lost l left join c on c.series = l.series and rk = 1""")
def j10(spark, d):
    f = frames(spark, d)
    good = F.col("category") != v.CATEGORY_INVALID
    zero = F.col("tp") == 0
    lost = f.groupBy("unit", "field", "series").agg(F.max(zero).alias("had"), F.coalesce(F.max(zero & good), F.lit(False)).alias("has"), F.max(good).alias("any")).where("had and not has and `any`").select("unit", "field", "series")
    lend = f.where(good & zero).groupBy("unit", F.col("field").alias("lender")).agg(F.percentile("area", 0.5).alias("area"))
    best = lost.join(lend, "unit").where("lender <> field").groupBy("series").agg(F.min_by(F.struct("lender", "area"), "lender").alias("b"))
    return lost.join(best, "series", "left").select("series", "b.lender", R6(F.col("b.area")).alias("area"))


TIERS = f"""with {FR}, ok as (select * from fr where category = 'OK'), t as (select * from fr where category = 'SEG_super'),
t1 as (select t.frame, quantile_cont(ok.area, 0.5) as m from t join ok on ok.unit = t.unit and ok.tp = t.tp and ok.field <> t.field group by 1),
t2 as (select field, tp, quantile_cont(area, 0.5) as m from ok group by 1, 2), t3 as (select tp, quantile_cont(area, 0.5) as m from ok group by 1),
r as (select t.frame, t.area, coalesce(t1.m, t2.m, t3.m) as ref, case when t1.m is not null then 'irmao_campo' when t2.m is not null then 'cond_ok' when t3.m is not null then 'lote_ok' else 'sem_referencia' end as tier
  from t left join t1 using (frame) left join t2 on t2.field = t.field and t2.tp = t.tp left join t3 on t3.tp = t.tp)"""


def _tiered(spark, d):
    f = frames(spark, d)
    ok, t = f.where(F.col("category") == v.CATEGORY_OK), f.where(F.col("category") == v.CATEGORY_OVER).select("frame", "unit", "field", "tp", "area")
    wanted = t.select("unit", "tp", F.col("field").alias("own")).distinct()
    t1 = wanted.join(ok.select("unit", "tp", "field", F.col("area").alias("a")), ["unit", "tp"]).where("field <> own").groupBy("unit", "tp", F.col("own").alias("field")).agg(F.percentile("a", 0.5).alias("m1"))
    t2 = percentiles(ok, ["field", "tp"], "area", {"m2": 0.5})
    t3 = percentiles(ok, ["tp"], "area", {"m3": 0.5})
    tier = F.when(F.col("m1").isNotNull(), "irmao_campo").when(F.col("m2").isNotNull(), "cond_ok").when(F.col("m3").isNotNull(), "lote_ok").otherwise("sem_referencia")
    return t.join(t1, ["unit", "tp", "field"], "left").join(t2, ["field", "tp"], "left").join(t3, "tp", "left").select("frame", "area", F.coalesce("m1", "m2", "m3").alias("ref"), tier.alias("tier"))


@query("j11_tiered_reference", TIERS + " select frame, round(ref, 6) as ref, tier from r")
def j11(spark, d):
    return _tiered(spark, d).select("frame", R6("ref").alias("ref"), "tier")


@query("q6_excess", TIERS + " select frame, round(area / ref - 1, 6) as excess, case when area / ref - 1 < 0 then 'negativo' when area / ref - 1 < 0.2 then 'leve' when area / ref - 1 <= 0.5 then 'moderado' when ref > 0 then 'severo' end as band from r")
def q6(spark, d):
    e = F.col("area") / F.col("ref") - 1
    return _tiered(spark, d).select("frame", R6(e).alias("excess"), F.when(e < 0, "negativo").when(e < 0.2, "leve").when(e <= 0.5, "moderado").when(F.col("ref") > 0, "severo").alias("band"))


@query("q7_rising_runs", f"""with {PTS}, l as (select *, lag(area) over (partition by series order by tp) as prev from pts), g as (select series, tp, sum((prev is null or area <= prev)::int) over (partition by series order by tp) as run from l)
select series, max(n)::bigint as longest, max(n) >= 3 as rising from (select series, run, count(*) as n from g group by 1, 2) group by 1""")
def q7(spark, d):
    w = Window.partitionBy("series").orderBy("tp")
    new = F.when(F.lag("area").over(w).isNull() | (F.col("area") <= F.lag("area").over(w)), 1).otherwise(0)
    runs = s.points(frames(spark, d), "area").withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("series", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("series").agg(F.max("n").alias("longest"), (F.max("n") >= 3).alias("rising"))


@query("q8_annotation_flags", f"with {FR} select frame, case when area = 0 then 'vazia' when area < case when tp = 0 then 3.0 when tp = 1 then 2.0 else 1.0 end then 'area_baixa' else 'ok' end as flag from fr")
def q8(spark, d):
    low = F.when(F.col("tp") == 0, 3.0).when(F.col("tp") == 1, 2.0).otherwise(1.0)
    return frames(spark, d).select("frame", F.when(F.col("area") == 0, "vazia").when(F.col("area") < low, "area_baixa").otherwise("ok").alias("flag"))


PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query("q8_area_profile", f"with {FR} select field, tp, count(*) as n, round(min(area), 6) as lo, {', '.join(f'round(quantile_cont(area, {q}), 6) as {n}' for n, q in PROBS.items())}, round(max(area), 6) as hi, count(*) filter (area < case when tp = 0 then 3.0 else 2.0 end) as suspect from fr where area > 0 group by 1, 2")
def q8_profile(spark, d):
    """Areas of the annotated frames by field and timepoint, and how many lie below the timepoint's limit."""
    f = stored(frames(spark, d).where("area > 0").select("field", "tp", "area"))
    low = F.when(F.col("tp") == 0, 3.0).otherwise(2.0)
    ends = f.groupBy("field", "tp").agg(F.count(F.lit(1)).alias("n"), R6(F.min("area")).alias("lo"), R6(F.max("area")).alias("hi"), F.count_if(F.col("area") < low).alias("suspect"))
    return percentiles(f, ["field", "tp"], "area", PROBS).select("field", "tp", *[R6(c).alias(c) for c in PROBS]).join(ends, ["field", "tp"])


@query("q9_ratio_qc", f"""with {FR}, m as (select unit, tp, sum(area) filter (field = 'view') as a, sum(area) filter (field = 'click') as b from fr group by 1, 2)
select unit, tp, case when a is null then 'sem_a' when b is null then 'sem_b' else 'ok' end as status, round(a / nullif(b, 0), 6) as ratio, coalesce(a / nullif(b, 0) not between 0.5 and 2, false) as flagged from m""")
def q9(spark, d):
    pick = lambda k: ordered_sum(F.when(F.col("field") == k, F.col("area")), "frame")
    m = frames(spark, d).groupBy("unit", "tp").agg(pick("view").alias("a"), pick("click").alias("b"))
    ratio = F.col("a") / F.nullif(F.col("b"), F.lit(0.0))
    return m.select("unit", "tp", F.when(F.col("a").isNull(), "sem_a").when(F.col("b").isNull(), "sem_b").otherwise("ok").alias("status"), R6(ratio).alias("ratio"), F.coalesce(~ratio.between(0.5, 2), F.lit(False)).alias("flagged"))


@query("q10_order_stability", f"""with {FR}, f as (select unit, tp, field, min(ts) as seen from fr group by all), r as (select *, row_number() over (partition by unit, tp order by seen, field) as pos from f)
select unit, pos, count(distinct field)::bigint as kinds, count(distinct field) = 1 as stable from r group by 1, 2""")
def q10(spark, d):
    f = frames(spark, d).groupBy("unit", "tp", "field").agg(F.min("ts").alias("seen"))
    r = f.withColumn("pos", F.row_number().over(Window.partitionBy("unit", "tp").orderBy("seen", "field")).cast("bigint"))
    return r.groupBy("unit", "pos").agg(F.count_distinct("field").alias("kinds"), (F.count_distinct("field") == 1).alias("stable"))


@query("q10_numeric_order", f"""with {FR}, f as (select unit, tp, ascii(field) as snap, min(ts) as seen from fr group by all), r as (select *, row_number() over w as pos, lag(snap) over w as last from f window w as (partition by unit, tp order by seen, snap)),
p as (select unit, tp, max(pos) as n, bool_and(coalesce(last <= snap, true)) as rising from r group by 1, 2), u as (select unit, count(*) as timepoints, min(n) as least, bool_and(rising) as temporal_equals_numeric from p group by 1 having count(*) >= 2),
k as (select unit, max(k) = 1 as pos_consistent from (select unit, pos, count(distinct snap) as k from r join u using (unit) where pos <= least group by 1, 2) group by 1)
select unit, timepoints, pos_consistent, temporal_equals_numeric from u join k using (unit)""")
def q10_numeric(spark, d):
    f = frames(spark, d).groupBy("unit", "tp", F.ascii("field").alias("snap")).agg(F.min("ts").alias("seen"))
    return s.numeric_order(f, "unit", "tp", "seen", "snap")


@query("q11_session_span", f"with {FR} select unit, tp, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from fr group by 1, 2")
def q11(spark, d):
    return frames(spark, d).groupBy("unit", "tp").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("q12_failure_mode", """with l as (select l_orderkey as k, (l_partkey % 25) as cell, l_linenumber <= 2 as base, l_quantity as q from lineitem), z as (select distinct k, cell from l where base),
c as (select distinct k, cell from l where not base), t as (select k, sum(q) as area from l where not base group by 1), n as (select c.k, count(*) as n, count(z.cell) as inside from c left join z on z.k = c.k and z.cell = c.cell group by 1)
select t.k, case when t.k not in (select k from z) then 'nao_avaliavel' when inside / n::double >= 0.5 then 'excesso' when area < 20 then 'espuria_fechada' else 'deslocada' end as mode from t join n using (k)""")
def q12(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 25).alias("cell"), (F.col("l_linenumber") <= 2).alias("base"), F.col("l_quantity").alias("q"))
    per = rows.groupBy("k", "cell").agg(F.max("base").alias("in_base"), F.max(~F.col("base")).alias("later"), F.sum(F.when(~F.col("base"), F.col("q")).otherwise(0.0)).alias("q"))
    n = per.groupBy("k").agg(F.count_if("later").alias("n"), F.count_if(F.col("later") & F.col("in_base")).alias("inside"), F.count_if("in_base").alias("reference"), F.sum("q").alias("area")).where("n > 0")
    mode = F.when(F.col("reference") == 0, "nao_avaliavel").when(F.col("inside") / F.col("n") >= 0.5, "excesso").when(F.col("area") < 20, "espuria_fechada").otherwise("deslocada")
    return n.select("k", mode.alias("mode"))


@query("q13_run_log", f"""with {PTS}, l as (select series, tp, area, area < 5 as bad, lag(area < 5) over (partition by series order by tp) as prev from pts), g as (select *, sum((prev is distinct from bad)::int) over (partition by series order by tp) as run from l)
select series, count(*)::bigint as rows, count(*) = 5 as complete, min(tp) filter (bad) as first_bad, coalesce(max(n) filter (bad), 0)::bigint as worst, coalesce(max(n) filter (bad), 0) >= 3 as rejected from (select *, count(*) over (partition by series, run) as n from g) group by 1""")
def q13(spark, d):
    w = Window.partitionBy("series").orderBy("tp")
    p = s.points(frames(spark, d), "area").withColumn("bad", F.col("area") < 5)
    p = p.withColumn("new", F.when(F.lag("bad").over(w).eqNullSafe(F.col("bad")), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = p.groupBy("series", "run").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad"), F.min("tp").alias("tp"))
    worst = F.coalesce(F.max(F.when(F.col("bad"), F.col("n"))), F.lit(0))
    return runs.groupBy("series").agg(F.sum("n").alias("rows"), (F.sum("n") == 5).alias("complete"), F.min(F.when(F.col("bad"), F.col("tp"))).alias("first_bad"), worst.alias("worst"), (worst >= 3).alias("rejected"))


EPOCHS = 12
LOSS = "case when event_type = 'error' and event_id % 3 = 0 then 'nan'::double else value end"


@query("q13_run_check", f"""with l as (select user_id % 700 as run, row_number() over (partition by user_id % 700 order by event_id) as epoch, {LOSS} as loss, value / 200 as iou, case when event_type in ('view', 'click') then value / 200 else value / 100 end as dice from events),
m as (select *, not isfinite(loss) as bad, abs(iou - dice) < 1e-9 and iou > 0 and iou < 1 as mark from l), n as (select *, lag(mark) over (partition by run order by epoch) is distinct from mark as fresh from m),
r as (select *, sum(fresh::int) over (partition by run order by epoch) as stretch from n), g as (select run, stretch, count(*) as n, bool_or(mark) as mark, count(*) filter (bad) as bad, min(epoch) filter (bad) as first from r group by 1, 2),
o as (select run, sum(n)::bigint as rows, sum(bad)::bigint as nonfinite, min(first)::bigint as first_nonfinite, coalesce(sum(n) filter (mark and n >= 3), 0)::bigint as degenerate from g group by 1),
z as (select run, rows, rows < {EPOCHS} as stopped_early, nonfinite, first_nonfinite, degenerate, rows < {EPOCHS} or nonfinite > 0 or degenerate > 0 as rejected from o)
select *, case when run % 5 = 0 then 'failed' else 'ok' end as said, (run % 5 = 0) <> rejected as contradicted from z""")
def q13_check(spark, d):
    """A user's events as the log of a training run, beside the status that a sentinel has written for it."""
    e = table(spark, d, "events").withColumn("run", F.col("user_id") % 700)
    same = F.col("event_type").isin("view", "click")
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    log = e.select(
        "run", F.row_number().over(Window.partitionBy("run").orderBy("event_id")).cast("bigint").alias("epoch"), F.when(lost, float("nan")).otherwise(F.col("value")).alias("loss"),
        (F.col("value") / 200).alias("iou"), F.when(same, F.col("value") / 200).otherwise(F.col("value") / 100).alias("dice"),
    )
    said = F.when(F.col("run") % 5 == 0, "failed").otherwise("ok")
    out = s.run_log(log, "run", "epoch", ["loss"], ("iou", "dice"), EPOCHS)
    return out.withColumn("said", said).withColumn("contradicted", (F.col("said") == "failed") != F.col("rejected"))


@query("q14_provenance_class", f"with {FR} select series, case when bool_and(frame % 3 = 0) then 'corrigida' when not bool_or(frame % 3 = 0) then 'automatica' else 'mista' end as provenance from fr group by 1")
def q14(spark, d):
    fixed = F.col("frame") % 3 == 0
    return frames(spark, d).groupBy("series").agg(F.when(F.bool_and(fixed), v.PROVENANCE_CORRECTED).when(~F.bool_or(fixed), v.PROVENANCE_AUTO).otherwise(v.PROVENANCE_MIXED).alias("provenance"))


@query("q15_otsu_eta", """with h as (select l_returnflag as g, l_quantity as x, count(*)::double as n from lineitem group by 1, 2), t as (select *, sum(n) over (partition by g) as tn, sum(n * x) over (partition by g) as ts, sum(n * x * x) over (partition by g) as tq,
  sum(n) over (partition by g order by x) as cn, sum(n * x) over (partition by g order by x) as cs from h)
select g, round(max(tq / tn - (ts / tn) * (ts / tn)), 6) as variance, round(max(case when cn < tn then cn * (tn - cn) / (tn * tn) * (cs / cn - (ts - cs) / (tn - cn)) * (cs / cn - (ts - cs) / (tn - cn)) end / (tq / tn - (ts / tn) * (ts / tn))), 6) as eta from t group by 1""")
def q15(spark, d):
    """The histogram has one row a distinct value; running sums over it are small."""
    h = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    all_, up = Window.partitionBy("g"), Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    n, x = F.col("n"), F.col("x")
    t = h.select("g", F.sum(n).over(all_).alias("tn"), F.sum(n * x).over(all_).alias("ts"), F.sum(n * x * x).over(all_).alias("tq"), F.sum(n).over(up).alias("cn"), F.sum(n * x).over(up).alias("cs"))
    tn, ts, cn, cs = (F.col(c) for c in ("tn", "ts", "cn", "cs"))
    var = F.col("tq") / tn - (ts / tn) * (ts / tn)
    gap = cs / cn - (ts - cs) / F.nullif(tn - cn, F.lit(0.0))
    return t.groupBy("g").agg(R6(F.max(var)).alias("variance"), R6(F.max(F.when(cn < tn, cn * (tn - cn) / (tn * tn) * gap * gap) / var)).alias("eta"))


@query("q16_best_variant", f"with {FR}, m as (select unit, field, avg(area) as score from fr group by 1, 2) select unit, arg_max(field, (score, field)) as variant, round(max(score), 6) as score from m group by 1")
def q16(spark, d):
    m = frames(spark, d).groupBy("unit", "field").agg(F.avg("area").alias("score"))
    return m.groupBy("unit").agg(F.max_by("field", F.struct("score", "field")).alias("variant"), R6(F.max("score")).alias("score"))


LOG = """log as (select event_id as seq, user_id as key, case event_type when 'view' then 'ok' when 'click' then 'fechada' when 'error' then 'invalida' else 'pulada' end as status, value as corrected, (date_diff('day', timestamp '2024-01-01', ts) // 7)::int as pass from events)"""


def _log(spark, d):
    return _named_log(table(spark, d, "events"))


def _named_log(events):
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "fechada").when(F.col("event_type") == "error", "invalida").otherwise("pulada")
    week = F.call_function("div", F.datediff(F.to_date("ts"), F.lit("2024-01-01")), F.lit(7)).cast("int")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), status.alias("status"), F.col("value").alias("corrected"), week.alias("pass"))


W1 = "select key, seq, status, corrected from (select *, row_number() over (partition by key{more} order by case status when 'ok' then 3 when 'fechada' then 3 when 'invalida' then 2 else 1 end desc, seq desc) as rk from log) where rk = 1"


@query("w1_latest_wins", f"with {LOG} {W1.format(more='')}")
def w1(spark, d):
    return s.latest(_log(spark, d), "key", "status", "seq", ["corrected"])


@query("x1_log_stream", f"with {LOG} {W1.format(more='')}")
def x1(spark, d):
    """The same outcomes from the log as a stream; its state and changes lie in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream's plain path must be a folder
    follow(_named_log(stream), "key", "status", "seq", ["corrected"], folder)
    return outcomes(spark, "key", folder)


@query("j20_merged_passes", f"with {LOG.replace('user_id as key', '(user_id * 7 + event_id % 7) as key')}, one as (select key, pass, seq, status, corrected from (select *, row_number() over (partition by key, pass order by case status when 'ok' then 3 when 'fechada' then 3 when 'invalida' then 2 else 1 end desc, seq desc) as rk from log where pass <> 1) where rk = 1) select key, pass, seq, status from (select *, row_number() over (partition by key order by pass) as rk from one) where rk = 1")
def j20(spark, d):
    """Pass 1 is the blind repeat and is left out; the earliest pass that has the key counts."""
    log = _log(spark, d).withColumn("key", F.col("key") * 7 + F.col("seq") % 7).where("pass <> 1")
    per = s.latest(log.withColumn("k", F.struct("key", "pass")), "k", "status", "seq", ["corrected"])
    best = per.groupBy("k.key").agg(F.min_by(F.struct("k.pass", "seq", "status"), "k.pass").alias("r"))
    return best.select("key", "r.pass", "r.seq", "r.status")


@query("j19_resolved_final", f"""with {FR}, {LOG}, w as ({W1.format(more='')}), f as (select frame, area as auto, case when frame % 11 = 0 then 'NAO_TRIADA' else category end as category, case when frame % 4 <> 0 then w.status end as status, w.corrected from fr join w on w.key = fr.unit),
g as (select frame, auto, corrected, status, case when status = 'invalida' then 'IMG_INVALIDA' when status in ('ok', 'fechada') and category in ('IMG_INVALIDA', 'NAO_TRIADA') then 'OK' else category end as category from f),
h as (select *, case when category = 'IMG_INVALIDA' then case when status = 'invalida' then 'invalida' else 'invalida_triagem' end when category = 'NAO_TRIADA' then 'pendente_correcao' when status is null then 'automatica' when status = 'ok' then 'corrigida' when status = 'fechada' then 'corrigida_fechada' else 'automatica_PENDENTE' end as source from g)
select frame, category, source, round(case when source like 'automatica%' then auto when source = 'corrigida' then corrected when source = 'corrigida_fechada' then 0 end, 6) as final from h""")
def j19(spark, d):
    f = frames(spark, d).withColumn("category", F.when(F.col("frame") % 11 == 0, v.CATEGORY_UNTRIAGED).otherwise(F.col("category")))
    w = s.latest(_log(spark, d), "key", "status", "seq", ["corrected"])
    j = f.join(w, F.col("unit") == F.col("key")).select("frame", F.col("area").alias("auto"), "category", F.when(F.col("frame") % 4 != 0, F.col("status")).alias("status"), "corrected")
    return s.resolve_final(j).select("frame", "category", "source", R6("final").alias("final"))
