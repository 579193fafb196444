"""Ranking metrics (R1-R8) and the draw table of resampled groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge import vocabulary as v
from sparkgauge.functions.hashing import hash52
from sparkgauge.operators.ordering import rank_rows, running


def greedy_match(items: DataFrame, detections: str, truths: str, overlap, thresholds: Sequence[float] = tuple(v.OVERLAP_THRESHOLDS)) -> DataFrame:
    """Array ``tp`` a threshold and item: 1 where a detection, best score first, takes the best truth still free.

    ``detections`` is array<struct<score, id, ...>>, ``truths`` array<struct<...>>; ``overlap(d, t)`` is a column expression.
    An item without detections keeps its truths: n_gt counts them.
    """
    order = F.array_sort(detections, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(F.signum(a["id"] - b["id"]).cast("int")))
    # each overlap is found once, for all thresholds; what lies below the lowest can be no match
    lowest = F.lit(float(min(thresholds, default=0.0)))
    near = lambda d: F.filter(F.transform(F.col(truths), lambda t, i: F.struct(overlap(d, t).alias("o"), (-i).alias("i"))), lambda x: x["o"] >= lowest)
    rows = items.select("*", F.transform(order, near).alias("_near"), F.size(truths).cast("bigint").alias("n_gt"))
    zero = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("tp"))

    def at(limit: Column) -> Column:
        def step(s, found):
            best = F.array_max(F.filter(found, lambda x: (x["o"] >= limit) & ~F.array_contains(s["used"], x["i"])))
            hit = best.isNotNull()
            return F.struct(F.when(hit, F.concat(s["used"], F.array(best["i"]))).otherwise(s["used"]).alias("used"), F.concat(s["tp"], F.array(F.when(hit, 1).otherwise(0))).alias("tp"))

        return F.struct(limit.alias("threshold"), F.aggregate("_near", zero, step, lambda s: s["tp"]).alias("tp"))

    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    return rows.select("*", F.inline(F.transform(limits, at))).select(*items.columns, "threshold", "tp", "n_gt")


def average_precision(dets: DataFrame, truths: DataFrame, by: Sequence[str]) -> DataFrame:
    """R2: AP of detections (by, score, tp) against ``truths`` (by, n_gt): 101 recall points, precision envelope from the right.

    Equal scores count together.  Without truths AP is null, with truths and no detection 0.
    """
    dist = dets.groupBy(F.struct(*by).alias("_g"), (-F.col("score")).cast("double").alias("_v")).agg(F.sum("tp").alias("_tp"), F.count(F.lit(1)).alias("_c"))
    run = running(dist, {"ctp": F.col("_tp"), "cn": F.col("_c")})
    total = truths.select(F.struct(*by).alias("_g"), "n_gt")
    point = run.join(total.where("n_gt > 0"), "_g").withColumn("k", F.call_function("div", F.col("ctp") * 100, F.col("n_gt")))
    best = point.groupBy("_g", "k").agg(F.max(F.col("ctp") / F.col("cn")).alias("p"))  # 101 rows a group at most
    w = Window.partitionBy("_g").orderBy(F.desc("k"))
    env = best.withColumns({"p": F.max("p").over(w.rowsBetween(Window.unboundedPreceding, 0)), "lower": F.coalesce(F.lead("k").over(w), F.lit(-1))})
    ap = env.groupBy("_g").agg((F.sum(F.col("p") * (F.col("k") - F.col("lower"))) / 101).alias("ap"))
    return total.join(ap, "_g", "left").select(*[F.col("_g")[b].alias(b) for b in by], "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def prf(dets: DataFrame, truths: DataFrame, by: Sequence[str], conf: float) -> DataFrame:
    """Precision, recall and F1 of the detections that score ``conf`` or more."""
    hit = dets.where(F.col("score") >= conf).groupBy(*by).agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    j = truths.join(hit, list(by), "left").fillna(0, ["tp", "n"])
    p, r = F.col("tp") / F.nullif(F.col("n"), F.lit(0)), F.col("tp") / F.nullif(F.col("n_gt"), F.lit(0))
    return j.withColumns({"precision": p, "recall": r, "f1": 2 * p * r / F.nullif(p + r, F.lit(0.0))})


def threshold_sweep(dets: DataFrame, truths: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Tp, fp, fn, recall and precision at each threshold, from one histogram by threshold and its running sum."""
    steps = sorted(thresholds)
    index = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in steps[1:]), F.when(F.col("score") >= steps[0], 1).otherwise(0))
    hist = dets.groupBy(*by, index.alias("i")).agg(F.sum("tp").alias("t"), F.count(F.lit(1)).alias("n"))
    grid = truths.select(*by, "n_gt", F.posexplode(F.array(*[F.lit(float(t)) for t in steps])).alias("j", "threshold")).withColumn("i", F.col("j") + 1)
    w = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # a row a threshold
    out = grid.join(hist, [*by, "i"], "left").fillna(0, ["t", "n"]).withColumns({"tp": F.sum("t").over(w), "n": F.sum("n").over(w)})
    return out.select(*by, "threshold", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), (F.col("tp") / F.nullif(F.col("n_gt"), F.lit(0))).alias("recall"), (F.col("tp") / F.nullif(F.col("n"), F.lit(0))).alias("precision"))


def draws(groups: DataFrame, group: str, replicates: int, seed) -> DataFrame:
    """rep, group, w: multiplicities of groups drawn with replacement; shared by all runs and arms.

    Draw i of replicate b takes group number hash(seed, b, i) mod G; groups are numbered in the order of their key.
    """
    numbered = rank_rows(groups.select(group).distinct(), [], group, [], "_no")
    n = numbered.count()
    picks = numbered.select((F.col("_no") - 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    picks = picks.select("rep", (hash52(seed, "rep", "i") % n + 1).alias("_no")).groupBy("rep", "_no").agg(F.count(F.lit(1)).alias("w"))
    return picks.join(numbered, "_no").select("rep", group, "w")
