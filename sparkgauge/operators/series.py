"""Time-series curves and their quality control (Q, J9-J11, W1, J19, J20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge import vocabulary as v

SERIES = ["series"]


def points(df: DataFrame, value: str) -> DataFrame:
    """Q1: one row a (series, tp), the median of its duplicates."""
    return df.groupBy("series", "tp").agg(F.percentile(value, 0.5).alias("area"))


def closure(pts: DataFrame) -> DataFrame:
    """``pts`` (series, tp, area) with a0 (null without a baseline), n_tp and closure (a0 - a) / a0 where a0 > 0."""
    base = pts.groupBy("series").agg(F.max(F.when(F.col("tp") == 0, F.col("area"))).alias("a0"), F.count(F.lit(1)).alias("n_tp"))
    c = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise((F.col("a0") - F.col("area")) / F.col("a0"))
    return pts.join(base, "series").withColumn("closure", F.when(F.col("a0") > 0, c))


def plausibility(curve: DataFrame, jump_limit: float | None = v.JUMP_LIMIT, from_baseline: bool = False) -> DataFrame:
    """Q2: plausible and reason of each series.

    ``from_baseline`` also holds the baseline against the range; ``jump_limit`` None switches the jump rule off.
    """
    step = Window.partitionBy("series").orderBy("tp")  # the timepoints of one series
    c = F.col("closure")
    judged = F.lit(True) if from_baseline else F.col("tp") > 0
    rows = curve.withColumn("prev", F.lag("closure").over(step))
    flags = rows.groupBy("series").agg(
        F.max("a0").alias("a0"), F.max("n_tp").alias("n_tp"),
        F.coalesce(F.bool_and(F.when(judged, c.between(v.RANGE_LOW, v.RANGE_HIGH))), F.lit(True)).alias("range_ok"),
        F.coalesce(F.bool_and(F.when(F.col("prev").isNotNull(), c >= F.col("prev") - v.MONOTONE_TOLERANCE)), F.lit(True)).alias("mono_ok"),
        F.coalesce(F.bool_and(F.when(F.col("tp") > 0, F.abs(c) <= jump_limit)), F.lit(True)).alias("jump_ok") if jump_limit is not None else F.lit(True).alias("jump_ok"),
    )
    said = F.concat_ws("+", F.when(~F.col("range_ok"), v.REASON_RANGE), F.when(~F.col("mono_ok"), v.REASON_MONOTONE), F.when(~F.col("jump_ok"), v.REASON_JUMP))
    reason = (
        F.when(F.col("a0").isNull(), v.REASON_NO_BASELINE).when(F.col("n_tp") < 2, v.REASON_ONE_POINT).when(F.col("a0") <= 0, v.REASON_ZERO_BASELINE)
        .when(said == "", v.REASON_PLAUSIBLE).otherwise(said)
    )
    return flags.withColumn("reason", reason).withColumn("plausible", F.col("reason") == v.REASON_PLAUSIBLE).select("series", "plausible", "reason")


def frame_flags(df: DataFrame, low: Column) -> DataFrame:
    """Q3: sorted flags of each frame (frame, unit, series, tp, area); ``low`` is the frame's small-area limit (null: none)."""
    a = F.col("area")
    per = df.groupBy("unit", "tp").agg(F.count(F.lit(1)).alias("fields"), F.max(F.when(a > 0, a)).alias("top"), F.min(F.when(a > 0, a)).alias("bottom"))
    rows = df.join(per, ["unit", "tp"]).withColumns({
        "sub": F.coalesce(a < low, F.lit(False)), "super": a > v.FLAG_LARGE,
        "discord": F.coalesce((F.col("fields") >= 2) & (F.col("top") / F.col("bottom") > v.FLAG_DISCORD), F.lit(False)),
    }).withColumn("suspect", F.col("sub") | F.col("super") | F.col("discord"))
    tops = rows.groupBy("series", "tp").agg(F.max("area").alias("tp_top"))
    prev = tops.withColumn("prev_top", F.lag("tp_top").over(Window.partitionBy("series").orderBy("tp"))).drop("tp_top")
    base = rows.groupBy("series").agg(F.max(F.when(F.col("tp") == 0, a)).alias("base_top"), F.max(F.when(F.col("tp") == 0, F.col("suspect"))).alias("base_suspect"), F.max(F.when(F.col("tp") > 0, a)).alias("later_top"))
    rows = rows.join(prev, ["series", "tp"]).join(base, "series")
    grown = ((F.col("tp") > 0) & (a > F.col("base_top"))) | ((F.col("tp") == 0) & F.col("base_suspect") & (F.col("later_top") > F.col("base_top")))
    flags = F.concat_ws(
        "+", F.when(grown, "FALHA_CLOSURE_NEG"), F.when(a - F.col("prev_top") > v.FLAG_RISE, "FALHA_NAO_MONOTONICO"),
        F.when(F.col("sub"), "FALHA_SUB"), F.when(F.col("super"), "FALHA_SUPER"),
    )
    flags = F.concat_ws("+", F.when(F.col("discord"), "DISCORDANCIA_CAMPO"), F.nullif(flags, F.lit("")))
    return rows.select("frame", F.when(flags == "", v.CATEGORY_OK).otherwise(flags).alias("flags"), (flags != "").alias("needs_correction"))


def pattern(df: DataFrame, category: str) -> DataFrame:
    """Q4: pattern of each series from the categories of its frames."""
    has = lambda c: F.max(F.col(category) == c)
    known = [v.CATEGORY_OK, v.CATEGORY_OVER, v.CATEGORY_UNDER, v.CATEGORY_AMBIGUOUS, v.CATEGORY_INVALID]
    f = df.groupBy("series").agg(
        has(v.CATEGORY_OK).alias("ok"), has(v.CATEGORY_OVER).alias("over"), has(v.CATEGORY_UNDER).alias("under"), has(v.CATEGORY_INVALID).alias("invalid"),
        F.max(~F.col(category).isin(known)).alias("other"), F.min(F.col(category) == v.CATEGORY_INVALID).alias("all_invalid"),
    )
    ok, over, under, other = (F.col(c) for c in ("ok", "over", "under", "other"))
    base = (
        F.when(ok & ~over & ~under & ~other, "CONSISTENTE_OK").when(over & ~ok & ~under & ~other, "CONSISTENTE_SUPER").when(under & ~ok & ~over & ~other, "CONSISTENTE_SUB")
        .when(~ok & ~over & ~under & ~other, "SO_AMBIGUO_INVALIDA").otherwise("MISTO")
    )
    return f.select("series", F.when(F.col("all_invalid"), "TODA_INVALIDA").otherwise(F.concat(base, F.when(F.col("invalid"), "+INVALIDA").otherwise(""))).alias("pattern"))


def decision(patterns: DataFrame, judged: DataFrame) -> DataFrame:
    """Q5: decision of each series, by priority."""
    p = F.col("pattern")
    lost = F.col("reason").isNull() | F.col("reason").isin(v.REASON_NO_BASELINE, v.REASON_ONE_POINT, v.REASON_ZERO_BASELINE)
    name = (
        F.when(p == "TODA_INVALIDA", "TODA_INVALIDA_fora").when(lost, "SEM_BASELINE_fora_pareada").when(p.startswith("CONSISTENTE_") & F.col("plausible"), "USAVEL_sem_correcao")
        .when(p.contains("MISTO"), "CORRIGIR_misto").otherwise("CORRIGIR_consistente_implausivel")
    )
    return patterns.join(judged, "series", "left").select("series", name.alias("decision"))


def latest(log: DataFrame, key: str, status: str, seq: str, values: Sequence[str]) -> DataFrame:
    """The outcome that counts of an append-only log: highest priority, then last row."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in v.STATUS_PRIORITY.items() for x in pair])[F.col(status)], F.lit(0))
    best = log.groupBy(key).agg(F.max(F.struct(rank.alias("p"), F.col(seq), F.col(status), *[F.col(c) for c in values])).alias("r"))
    return best.select(key, f"r.{seq}", f"r.{status}", *[f"r.{c}" for c in values])


def resolve_final(frames: DataFrame) -> DataFrame:
    """Category, final area and its source of frames with auto, category, status and corrected (null status: untouched)."""
    s, cat = F.col("status"), F.col("category")
    new = F.when((s == "invalida") & (cat != v.CATEGORY_INVALID), v.CATEGORY_INVALID).when(s.isin("ok", "fechada") & cat.isin(v.CATEGORY_INVALID, v.CATEGORY_UNTRIAGED), v.CATEGORY_OK).otherwise(cat)
    rows = frames.withColumn("category", new)
    source = (
        F.when((cat == v.CATEGORY_INVALID) & (F.coalesce(s, F.lit("")) == "invalida"), v.SOURCE_INVALID).when(cat == v.CATEGORY_INVALID, v.SOURCE_INVALID_TRIAGE)
        .when(cat == v.CATEGORY_UNTRIAGED, v.SOURCE_PENDING).when(s.isNull(), v.SOURCE_AUTO).when(s == "ok", v.SOURCE_CORRECTED).when(s == "fechada", v.SOURCE_CLOSED)
        .when(s == "invalida", v.SOURCE_INVALID).otherwise(v.SOURCE_PENDING_AUTO)
    )
    rows = rows.withColumn("source", source)
    area = F.when(F.col("source").isin(v.SOURCE_AUTO, v.SOURCE_PENDING_AUTO), F.col("auto")).when(F.col("source") == v.SOURCE_CORRECTED, F.col("corrected")).when(F.col("source") == v.SOURCE_CLOSED, 0.0)
    return rows.withColumn("final", area)


def numeric_order(rows: DataFrame, unit: str, tp: str, seen: str, number: str) -> DataFrame:
    """Q10: unit, timepoints, pos_consistent, temporal_equals_numeric for units with two timepoints or more.

    In the order of ``seen`` (ties by ``number``) the rows of a timepoint have positions; they are consistent if each position that all
    timepoints have holds one number, and numeric if the numbers never fall in any timepoint.
    """
    w = Window.partitionBy(unit, tp).orderBy(seen, number)
    placed = rows.select(unit, tp, number, F.row_number().over(w).alias("_pos"), F.lag(number).over(w).alias("_last"))
    per = placed.groupBy(unit, tp).agg(F.max("_pos").alias("_n"), F.bool_and(F.coalesce(F.col("_last") <= F.col(number), F.lit(True))).alias("_rising"))
    units = per.groupBy(unit).agg(F.count(F.lit(1)).alias("timepoints"), F.min("_n").alias("_least"), F.bool_and("_rising").alias("temporal_equals_numeric")).where("timepoints >= 2")
    kinds = placed.join(units.select(unit, "_least"), unit).where(F.col("_pos") <= F.col("_least")).groupBy(unit, "_pos").agg(F.count_distinct(number).alias("_k"))
    same = kinds.groupBy(unit).agg((F.max("_k") == 1).alias("pos_consistent"))
    return units.join(same, unit).select(unit, "timepoints", "pos_consistent", "temporal_equals_numeric")


def run_log(log: DataFrame, run: str, epoch: str, measures: Sequence[str], pair: tuple[str, str], expected: int, least: int = 3) -> DataFrame:
    """Q13: run, rows, stopped_early, nonfinite, first_nonfinite, degenerate, rejected of each run's log.

    An epoch is non-finite if one of ``measures`` is null, NaN or infinite.  It is degenerate within a run of ``least`` or more epochs in
    a row whose ``pair`` of scores is equal and strictly between 0 and 1: two means may be equal once by chance.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf"))
    bad = F.lit(False)
    for c in measures:
        bad = bad | ~finite(c)
    a, b = (F.col(c) for c in pair)
    mark = F.coalesce(finite(pair[0]) & (F.abs(a - b) < 1e-9) & (a > 0) & (a < 1), F.lit(False))
    rows = log.select(run, epoch, bad.alias("_bad"), mark.alias("_mark"))
    rows = rows.withColumn("_new", F.when(F.lag("_mark").over(w).eqNullSafe(F.col("_mark")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy(run, "_run").agg(F.count(F.lit(1)).alias("_n"), F.max("_mark").alias("_mark"), F.count_if("_bad").alias("_bad"), F.min(F.when(F.col("_bad"), F.col(epoch))).alias("_first"))
    degenerate = F.sum(F.when(F.col("_mark") & (F.col("_n") >= least), F.col("_n")).otherwise(0))
    out = runs.groupBy(run).agg(F.sum("_n").alias("rows"), F.sum("_bad").alias("nonfinite"), F.min("_first").alias("first_nonfinite"), degenerate.alias("degenerate"))
    out = out.withColumn("stopped_early", F.col("rows") < expected)
    return out.withColumn("rejected", F.col("stopped_early") | (F.col("nonfinite") > 0) | (F.col("degenerate") > 0)).select(run, "rows", "stopped_early", "nonfinite", "first_nonfinite", "degenerate", "rejected")
