"""Duplicates, group keys, splits, samples, audits (G)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.functions.hashing import hash52
from sparkgauge.operators.components import components
from sparkgauge.operators.ordering import rank_rows
from sparkgauge.session import stored


def split_groups(groups: DataFrame, key: str, stratum: str, seed, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """Partition of each group, by quotas within its stratum (half-even, 1 each from three groups on)."""
    drawn = rank_rows(groups.withColumn("_u", hash52(seed, key)), [stratum], "_u", [key], "_rank")
    sizes = groups.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(stratum, "_stratum")
    n = F.col("_n")
    some = lambda share: F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("bigint"))
    n_test = F.when(n >= 3, F.least(some(test), n - 2)).when(n == 2, 1).otherwise(0)
    n_val = F.when(n >= 3, F.least(some(val), n - 1 - n_test)).otherwise(0)
    out = drawn.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
    part = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return out.withColumn("partition", part).drop("_u", "_rank", "_n", "_stratum")


def fused_keys(df: DataFrame, key: str, content: str) -> DataFrame:
    """Key -> smallest key of all groups that are chained by shared content (a star of edges for each content)."""
    pairs = df.select(F.concat(F.lit("g:"), F.col(key)).alias("a"), F.concat(F.lit("h:"), F.col(content)).alias("b")).distinct()
    found = components(pairs)
    keys = df.select(F.col(key)).distinct()
    named = found.where(F.col("node").startswith("g:")).select(F.substr("node", F.lit(3)).alias("_k"), F.substr("component", F.lit(3)).alias("fused"))
    return keys.join(named, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("fused", key).alias("fused"))


def crossing(df: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that occur in more than one partition or context, with the smallest and the largest."""
    return df.groupBy(key).agg(F.count_distinct(part).alias("parts"), F.min(part).alias("first_part"), F.max(part).alias("last_part"), F.count(F.lit(1)).alias("rows")).where("parts > 1")


def audit(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """For each key the number of its values, of those in several partitions, of rows without it, and the verdict."""
    out = None
    for key in keys:
        per = df.groupBy(key).agg(F.count_distinct(part).alias("p"), F.count(F.lit(1)).alias("n"))
        row = per.agg(
            F.lit(key).alias("key_name"), F.count(key).alias("n_values"), F.coalesce(F.sum(F.when(F.col(key).isNotNull() & (F.col("p") > 1), 1).otherwise(0)), F.lit(0)).alias("overlapping"),
            F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias("missing"),
        ).withColumn("verdict", F.when((F.col("overlapping") == 0) & (F.col("missing") == 0), "ok").otherwise("leak"))
        out = row if out is None else out.unionByName(row)
    return out


def representatives(df: DataFrame, cluster: str, order: Sequence[Column], id_col: str) -> DataFrame:
    """The best row of each cluster by ``order`` (largest first, then smallest id), keep flag, reason and size.

    The best is an aggregate, so a large cluster is never sorted in one task.
    """
    best = df.groupBy(cluster).agg(F.max_by(id_col, F.struct(*order, (-F.col(id_col)).alias("_tie"))).alias("kept_id"), F.count(F.lit(1)).alias("cluster_size"))
    out = df.join(best, cluster).withColumn("keep", F.col(id_col) == F.col("kept_id"))
    reason = F.when(F.col("cluster_size") == 1, "single").when(F.col("keep"), "representative").otherwise("duplicate")
    return out.withColumns({"reason": reason, "dup_of": F.when(~F.col("keep"), F.col("kept_id"))})


def measured_key(df: DataFrame, name: str, keys: Sequence[str], unit: str) -> DataFrame:
    """Groups of a candidate key, their sizes, singletons, and units that it splits."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    split = df.select(unit, *keys).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("split_units"))
    stats = sizes.agg(
        F.lit(name).alias("key_name"), F.count(F.lit(1)).alias("groups"), F.min("n").alias("smallest"), F.percentile("n", 0.5).alias("median"),
        F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"),
    )
    return stats.crossJoin(split)  # one row each


def quotas(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """Stratum -> quota: proportional (half-even), 1 at least, then the largest is trimmed or the largest shortfall filled until the sum is n.

    ``counts`` has one row a stratum, with column ``n``.
    """
    w = Window.partitionBy()
    total = F.sum("n").over(w)
    raw = counts.withColumn("exact", F.col("n") * n / total).withColumn("q", F.least(F.greatest(F.lit(1), F.bround("exact").cast("bigint")), F.col("n")))
    gap = raw.withColumn("gap", F.lit(n) - F.sum("q").over(w))
    # one unit at a time, in the order of how far a stratum lies from its exact share
    by_far = F.row_number().over(Window.orderBy(F.when(F.col("gap") > 0, F.col("q") - F.col("exact")).otherwise(F.col("exact") - F.col("q")), stratum))
    step = F.when(F.col("gap") > 0, F.least(F.when(by_far <= F.col("gap"), 1).otherwise(0), F.col("n") - F.col("q"))).otherwise(-F.when((by_far <= -F.col("gap")) & (F.col("q") > 1), 1).otherwise(0))
    return gap.withColumn("quota", (F.col("q") + step).cast("bigint")).select(stratum, "quota")


def stratified_sample(df: DataFrame, stratum: str, quota: DataFrame, seed, key: str) -> DataFrame:
    """The first rows of each stratum in hash order, as many as its quota."""
    ranked = rank_rows(df.withColumn("_u", hash52(seed, key)), [stratum], "_u", [key], "draw")
    q = quota.select(F.col(stratum).alias("_s"), "quota")
    return ranked.join(q, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("draw") <= F.col("quota")).drop("_u", "_s", "quota")


def diverse_topk(df: DataFrame, score: str, by: str, id_col: str, spread: int, k: int) -> DataFrame:
    """The best rows, the first ``spread`` from different groups, then whatever scores best, k in all.

    The first step needs the best row of each group only; the fill needs the best k rows.
    """
    best = df.groupBy(by).agg(F.max_by(F.struct(*df.columns), F.struct(score, (-F.col(id_col)).alias("t"))).alias("r")).select("r.*")
    first = best.orderBy(F.desc(score), id_col).limit(spread).withColumn("step", F.lit(1))
    rest = df.join(first.select(id_col), id_col, "left_anti").orderBy(F.desc(score), id_col).limit(k - spread).withColumn("step", F.lit(2))
    return first.unionByName(rest)


WORD = 62  # facet values a word of bits holds


def seed_search(rows: DataFrame, key: str, facets: Sequence[str], seeds: int, shares: dict[str, float], first_seed: int = 0) -> DataFrame:
    """Seed, incomplete, missing, error of every seed's split of the groups ``key``.

    A seed sends a group to the part its hash falls in; ``shares`` gives each part's share of the rows, in the order of the hash.  ``missing``
    counts the facet values that a part lacks, over all parts and facets; ``error`` is the sum of the shares' deviations.  The best seed is
    the least (incomplete, error, seed).

    The facet values of a group are words of bits, so a seed costs the groups' bits: they are or-ed by part before and after the shuffle
    and counted, and no row is sent once a seed.  Null keys and facet values are values of their own.
    """
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("k"), *[F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("null")).alias(f"_{i}") for i, f in enumerate(facets)])
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    held = rows.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("facet"), F.col(f"_{i}").alias("value")) for i in range(len(facets))])).alias("x")).select("k", "x.facet", "x.value").distinct()
    held = stored(held)
    ids = stored(rank_rows(held.select("facet", "value").distinct().withColumn("_u", hash52("facet", "value")), ["facet"], "_u", ["value"], "_id").select("facet", "value", "_id"))
    values = ids.count()
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_id") % WORD).cast("int"))
    words = held.join(ids, ["facet", "value"]).groupBy("k", "facet", F.call_function("div", F.col("_id"), F.lit(WORD)).alias("word")).agg(F.bit_or(bit).alias("bits"))
    groups = stored(sizes.join(words.groupBy("k").agg(F.collect_list(F.struct("facet", "word", "bits")).alias("words")), "k", "left"))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    drawn = groups.withColumn("seed", F.explode(F.sequence(F.lit(first_seed).cast("bigint"), F.lit(first_seed + seeds - 1).cast("bigint"))))
    u, part, low = hash52(F.col("seed"), "k") / float(2**52), F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        low += share
        part = F.coalesce(part, F.when(u < low, name))
    drawn = drawn.withColumn("part", F.coalesce(part, F.lit(list(shares)[-1])))
    deviation = [F.abs(F.sum(F.when(F.col("part") == name, F.col("n")).otherwise(0)) / total - share) for name, share in shares.items()]
    error = drawn.groupBy("seed").agg(sum(deviation[1:], deviation[0]).alias("error"))
    seen = drawn.select("seed", "part", F.explode("words").alias("w")).groupBy("seed", "part", "w.facet", "w.word").agg(F.bit_or("w.bits").alias("bits"))
    covered = seen.groupBy("seed").agg(F.sum(F.bit_count("bits")).alias("covered"))
    missing = F.lit(values * len(shares)) - F.coalesce("covered", F.lit(0))
    out = error.join(covered, "seed", "left").withColumn("missing", missing.cast("bigint"))
    return out.select("seed", F.when(F.col("missing") > 0, 1).otherwise(0).alias("incomplete"), "missing", "error")


def conservation(total: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """One row: total, labelled, excluded, labels, orphan_labels, label_ids, conserved.

    Each count comes from a join of its own, so that the sums can fail: rows of ``total`` that ``used`` has or lacks, rows of ``used``
    that ``total`` lacks, and keys that ``used`` has twice.
    """
    counts = {
        "total": total, "labelled": total.join(used.select(key).distinct(), key, "left_semi"), "excluded": total.join(used.select(key).distinct(), key, "left_anti"),
        "labels": used, "orphan_labels": used.join(total.select(key).distinct(), key, "left_anti"), "label_ids": used.where(F.col(key).isNotNull()).select(key).distinct(),
    }
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    good = (F.col("total") == F.col("labelled") + F.col("excluded")) & (F.col("orphan_labels") == 0) & (F.col("labels") == F.col("label_ids"))
    return out.withColumn("conserved", good)
