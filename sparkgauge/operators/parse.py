"""Column functions: names, keys, classes, bands, geometry, vectors (P)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def norm_key(c: Column) -> Column:
    """Name without extension and collision suffix, lower case, blanks for underscores, single blanks.

    A snap, its number set off by blanks, underscores or hyphens, is ``snap-N`` with N as a number, whatever stands around it.
    """
    base = F.trim(F.lower(F.regexp_replace(c, r"\.[A-Za-z]{2,4}$", "")))
    base = F.regexp_replace(base, r"\s*\([0-9]+\)\s*$", "")
    snap = F.regexp_extract(base, r"snap[\s_-]*0*([0-9]+)", 1)
    flat = F.trim(F.regexp_replace(F.regexp_replace(base, "_", " "), r"\s+", " "))
    return F.when(snap != "", F.concat(F.lit("snap-"), snap)).otherwise(flat)


def normalise_coords(coords: Column, width: Column, height: Column) -> Column:
    """Struct of ``coords`` (x by the width, y by the height, clamped to [0, 1]) and ``clamped``, how many lay outside.

    Coordinates alternate x, y; a null one stays null and does not count.
    """
    share = F.transform(coords, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height))
    inside = F.transform(share, lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))))
    return F.struct(inside.alias("coords"), F.size(F.filter(share, lambda x: (x < 0) | (x > 1))).alias("clamped"))


def classify(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The class of the first pattern that is found."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def fold(c: Column) -> Column:
    """Lower case, accents dropped, only letters and digits."""
    return F.regexp_replace(F.translate(F.lower(c), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"), "[^a-z0-9]", "")


def band(c: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of edges below the value; ``closed`` says whether [lo, hi) or (lo, hi] are the bands."""
    if closed not in ("left", "right"):
        raise ValueError(closed)
    hits = [F.when(c >= e if closed == "left" else c > e, 1).otherwise(0) for e in edges]
    return F.when(c.isNotNull(), sum(hits[1:], hits[0])).cast("bigint")


def extract_ts(c: Column) -> Column:
    """First day-first timestamp in a document."""
    found = F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("dd/MM/yyyy HH:mm:ss"))


def shoelace(x: Column, y: Column) -> Column:
    """Polygon area from coordinate arrays; fewer than three points have none."""
    n = F.size(x)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: x[i] * y[(i + 1) % n] - x[(i + 1) % n] * y[i])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2.0).otherwise(F.lit(0.0))


def zscored(df: DataFrame, column: str, name: str) -> DataFrame:
    """Vector minus its mean, divided by its population deviation (by 1e-6 at least)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("_mean", total(F.col(column)) / F.size(column))
    df = df.withColumn("_centred", F.transform(column, lambda x: x - F.col("_mean")))
    df = df.withColumn("_sd", F.greatest(F.sqrt(total(F.transform("_centred", lambda x: x * x)) / F.size(column)), F.lit(1e-6)))
    return df.withColumn(name, F.transform("_centred", lambda x: x / F.col("_sd"))).drop("_mean", "_centred", "_sd")


def vec_corr(a: Column, b: Column) -> Column:
    """Correlation of two z-scored vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def canonicalise(df: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    """``mapping`` has columns label and canonical; labels that it lacks stand for themselves."""
    m = mapping.select(F.col("label").alias("_label"), F.col("canonical").alias("_canonical"))
    return df.join(m, F.col(column) == F.col("_label"), "left").withColumn(name, F.coalesce("_canonical", column)).drop("_label", "_canonical")
